"""Exact dedup by distributed MSD radix partitioning; no digest decides equality.

The normalised texts (white space deleted) are split into groups by their leading bytes,
each group by the next bytes, and so on, until a group is one document or its texts have
ended.  Each round looks at a run of bytes eight times as long as the last, so texts of
any length need few rounds; the rounds that compare much text have few documents left.

A round counts the documents of each (group, run of bytes) with partial aggregation, keeps
the runs shared by two or more as the new groups, and gives every document its group by a
join that the engine can split where one group is large.  The plan is the same at every
size: the first round exchanges the texts, and most prove to be alone in it.  What each
round decides is written to the shared folder; the text compared so far is not carried on.

Cases: null counts as the empty text, and texts of nothing but white space are equal to
it; of equal texts the longest original (code points) stays, then the smallest doc_id, so
rows with the same doc_id and text are kept together; a null doc_id is larger than any
other; an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.staging import cut

WHITE = " \t\n\x0b\x0c\r"
#: Bytes that the first round looks at, and how much longer each next run is.
FIRST, GROWTH = 64, 8


def dedup_exact(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs(doc_id, text)``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.char_length(text).alias("points"), F.encode(F.translate(text, WHITE, ""), "UTF-8").alias("rest"))
    rows = rows.select("doc_id", "points", F.unhex(F.sha2("rest", 256)).alias("sha"), F.lit(0).cast("long").alias("group"), "rest")
    done, width = [], FIRST
    while True:
        # One run of bytes: (group, run) -> new group, for runs of two or more documents.
        run = F.substring("rest", 1, width)
        runs = rows.groupBy("group", run.alias("run")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        named = cut(runs.select(F.col("group").alias("was"), "run", F.monotonically_increasing_id().alias("next")), "runs").hint("merge")
        split = rows.withColumn("head", run).join(named, (F.col("group") == F.col("was")) & (F.col("head") == F.col("run")), "left")
        ended = F.octet_length("head") < width
        split = split.select("doc_id", "points", "sha", F.col("next").alias("group"), F.coalesce(ended | F.col("next").isNull(), F.lit(True)).alias("ended"), F.when(F.col("next").isNotNull() & ~ended, F.expr(f"substring(rest, {width + 1})")).alias("rest"))
        split = cut(split, "split")
        single = split.filter("group is null")
        done.append(single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha"))
        done.append(_settled(split.filter("group is not null and ended")))
        rows = split.filter("not ended").select("doc_id", "points", "sha", "group", "rest")
        if rows.isEmpty():
            break
        width *= GROWTH
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _settled(rows: DataFrame) -> DataFrame:
    """Documents of groups whose texts have ended, with the one that stays."""
    rank = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    best = rows.groupBy(F.col("group").alias("g")).agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(best, F.col("group") == F.col("g")).select("doc_id", F.col("best.id").alias("keep_id"), "group_size", "sha")
