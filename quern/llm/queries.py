"""Registered queries of this subpackage, each over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.decontaminate import find_contaminated
from quern.llm.exact_dedup import dedup_exact
from quern.llm.line_dedup import dedup_lines
from quern.llm.pieces import digest_pieces
from quern.llm.quality import score_quality
from quern.llm.sharding import shard_documents
from quern.llm.simhash import near_groups
from quern.llm.token_counts import count_tokens
from quern.llm.token_files import read_token_files, write_token_files
from quern.llm.toxicity import score_toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _held_out(folds: int, held: int):
    return F.crc32(F.col("doc_id").cast("string")) % folds == held


def _classified(scored: DataFrame, folds: int, held: int, *more: str) -> DataFrame:
    return scored.select("doc_id", F.coalesce(_held_out(folds, held), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), *more)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~_held_out(3, 1))
    return _classified(score_toxicity(_documents(spark, sf_dir), labels), 3, 1, "windows", "toxic_windows")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~_held_out(4, 2))
    return _classified(score_quality(_documents(spark, sf_dir), labels), 4, 2, "log_ratio")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_pieces(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(_documents(spark, sf_dir).select("doc_id", "text"), shards=8)
    crc = F.crc32(F.coalesce("text", F.lit("")))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), least_chars=20, least_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_documents(spark, sf_dir))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(_documents(spark, sf_dir))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op3_quality": op3_quality,
    "op2_token_counts": op2_token_counts,
    "op4_pieces": op4_pieces,
    "op5_sharding": op5_sharding,
    "op6_token_files": op6_token_files,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_decontaminate": op9_decontaminate,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL = {
    "op7_line_dedup": r"""
        with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
             k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
             f as (select key, max(doc_id) as owner from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
             j as (select k.*, f.owner is not null and f.owner <> k.doc_id as lost from k left join f on k.key = f.key)
        select doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
        from j group by doc_id
    """,
    "op10_exact_dedup": r"""
        with t as (select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as body from documents),
             g as (select body, count(*) as group_size, arg_min(doc_id, (-points, doc_id)) as keep_id from t group by body)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t.body) as text_sha256
        from t join g on t.body = g.body
    """,
}
