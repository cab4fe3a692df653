"""All pairs of texts with a similarity of their word shingles of at least a given share, by SimHash and by prefix filtering.

A text is the set of the 64-bit hashes of its shingles; equal sets are one node.  The exact
Jaccard similarity of the texts decides each link, in three rounds.

The first is the search of SimHash fingerprints by multi-index hashing (:mod:`quern.llm.simhash`).
It joins most of what is similar, but fingerprints of similar texts may lie farther apart than a
search of segments reaches.  The other two are the exact way for those pairs.  All sets
are put in one order, shingles that a sample shows in many texts last.  Two sets as similar
as asked must share a shingle among the first few of both (the prefix: for 4/5, a fifth of
the set and one more), so texts meet on the shingles of their prefixes and no pair is
missed; the sample decides only how many meet in vain.  What meets is bounded by sizes and
places.  The second round compares each text on a shingle with the one next to it by the number
of shared shingles and with that of the largest number, so that variants of one text meet that text, in
proportion to the rows.  The third compares all pairs that are not in one group by then
and were not compared before.

Cases: texts with fewer words than a shingle have one shingle of all of them; null, empty and
white texts are one node; rows with the same doc_id are one node; a null doc_id takes part
as the least number; an empty table gives an empty table.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import emit, slices, spark_ddl, texts
from quern.plans.staging import cut, release

NONE = -(1 << 63)
#: The sample that counts shingles holds one text in so many.
SAMPLE_PART = 4
#: A shingle in so many texts of the sample is listed as common, up to so many shingles.
COMMON, LISTED = 2, 2_000_000
#: Candidate pairs formed at once, rows packed at once, and rows of one part of the keys on average.
PAIRS, PACKED, PART = 1_000_000, 100_000, 1_000_000
#: Most bits by which texts that take part in no comparison are told before they are exchanged.
BITS = 1 << 26

HASHES = pa.schema([("key", pa.int64())])
SETS = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("size", pa.int64()), ("prefix", pa.binary()), ("search", pa.binary()), ("sketch", pa.binary())])
ROWS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("size", pa.int64()), ("place", pa.int64())])
MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("size_a", pa.int64()), ("size_b", pa.int64()), ("place_a", pa.int64()), ("place_b", pa.int64())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
COUNTS = pa.schema([("key", pa.int64()), ("n", pa.int64())])
PACKS = pa.schema([("part", pa.int32()), ("cells", pa.binary())])

Batches = Iterator[pa.RecordBatch]


@dataclass(frozen=True)
class Similar:
    """Texts that are linked: Jaccard similarity of their shingles of at least ``part`` / ``whole``."""

    shingle: int = 5
    part: int = 4
    whole: int = 5

    def prefix(self, size: int) -> int:
        """Shingles of a set of which a similar set must hold one."""
        return size + (-self.part * size) // self.whole + 1 if size else 0

    def common(self, sizes):
        """Shingles that similar sets with these sizes together share at least."""
        return -(-self.part * sizes // (self.part + self.whole))


def shingle_set(text: str, n: int) -> np.ndarray:
    """Sorted hashes of the different shingles of ``n`` words of a text."""
    words = text.encode("utf-8", "replace").lower().split()
    parts = map(b" ".join, zip(*(words[i:] for i in range(n)))) if len(words) > n else [b" ".join(words)] if words else []
    return np.unique(np.array(list(map(xxhash.xxh3_64_intdigest, parts)), np.uint64))


def sketch(hashes: np.ndarray) -> bytes:
    """Parities of how many of the hashes end in each bit pattern, as many bits as hashes or up to twice as many: two sets differ in as many elements at least as their sketches in bits."""
    bits = max(64, 1 << (len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Least number of elements in which the sets of two sketches differ; the longer sketch is folded."""
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(u) < len(v):
        u, v = v, u
    return int(np.bitwise_count(np.bitwise_xor.reduce(u.reshape(-1, len(v)), axis=0) ^ v).sum())


def _hashing(form: Similar) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for part in slices(batches):
            sets = [shingle_set(t, form.shingle) for t in texts(part)]
            yield emit({"key": np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)}, HASHES)

    return run


def _packing(schema: pa.Schema, parts: int) -> Callable[[Batches], Batches]:
    """Rows of longs as one binary for each part of the keys, byte by byte of all rows, so that their high zeros compress."""

    def packed(rows: np.ndarray) -> pa.RecordBatch:
        part = (rows[:, 0].view(np.uint64) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        rows, part = rows[order], part[order]
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        cells = [np.ascontiguousarray(r).view(np.uint8).reshape(len(r), -1).T.tobytes() for r in np.split(rows, start[1:])]
        return emit({"part": part[start], "cells": cells}, PACKS)

    def run(batches: Batches) -> Batches:
        held, n = [], 0
        for batch in batches:
            held.append(_table(batch, schema.names))
            n += batch.num_rows
            if n >= PACKED:
                yield packed(np.concatenate(held))
                held, n = [], 0
        if n:
            yield packed(np.concatenate(held))

    return run


def _unpacked(batches: Batches, columns: int) -> Iterator[np.ndarray]:
    """The rows of packs, many at once, sorted by key."""
    held, n = [], 0
    for batch in batches:
        for cells in batch.column("cells"):
            planes = np.frombuffer(cells.as_buffer(), np.uint8).reshape(8 * columns, -1)
            held.append(np.ascontiguousarray(planes.T).view(np.int64))
            n += len(held[-1])
            if n >= 2 * PACKED:
                rows, held, n = np.concatenate(held), [], 0
                yield rows[np.argsort(rows[:, 0], kind="stable")]
    if n:
        rows = np.concatenate(held)
        yield rows[np.argsort(rows[:, 0], kind="stable")]


def _met_before(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted ``known`` has each of ``keys``, and whether it does."""
    at = np.searchsorted(known, keys)
    inside = np.minimum(at, max(len(known) - 1, 0))
    return inside, known[inside] == keys if len(known) else np.zeros(len(keys), bool)


def _together(df: DataFrame, made: Callable[[Batches], Batches], schema: pa.Schema, rows: int) -> DataFrame:
    """About so many ``rows`` made from ``df``, exchanged in packs so that those of one key are in one partition."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // PART))
    pack = _packing(schema, parts)
    return df.mapInArrow(lambda batches: pack(made(batches)), spark_ddl(PACKS)).repartitionById(parts, "part")


def _counted(batches: Batches) -> Batches:
    """Keys that occur often enough, with their number; a task holds the different keys of its part."""
    known = counts = np.zeros(0, np.int64)
    for rows in _unpacked(batches, len(HASHES)):
        keys, n = np.unique(rows[:, 0], return_counts=True)
        at, old = _met_before(known, keys)
        counts[at[old]] += n[old]
        known, counts = np.concatenate([known, keys[~old]]), np.concatenate([counts, n[~old]])
        order = np.argsort(known, kind="stable")
        known, counts = known[order], counts[order]
    yield emit({"key": known[counts >= COMMON], "n": counts[counts >= COMMON]}, COUNTS)


def common_shingles(docs: DataFrame, form: Similar) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes that a sample of ``docs`` has in many texts, and how many."""
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_PART)) == 0).select("text")
    n = sample.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    counted = _together(sample, _hashing(form), HASHES, n // 4).mapInArrow(_counted, spark_ddl(COUNTS))
    found = counted.orderBy(F.desc("n"), "key").limit(LISTED).toArrow()
    keys = np.asarray(found.column("key").combine_chunks()).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.asarray(found.column("n").combine_chunks())[order]


def _setting(form: Similar, fingerprint: Callable[[np.ndarray], bytes], sent) -> Callable[[Batches], Batches]:
    """Digest, size, prefix, SimHash fingerprint and sketch of the shingle set of each text."""

    def run(batches: Batches) -> Batches:
        keys, counts = sent.value
        for part in slices(batches):
            digest, size, prefix, search, parities = [], [], [], [], []
            for text in texts(part):
                s = shingle_set(text, form.shingle)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                size.append(len(s))
                search.append(fingerprint(s))
                parities.append(sketch(s))
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    ordered = s[np.argsort(np.where(keys[at] == s, counts[at], 0), kind="stable")]
                else:
                    ordered = s
                prefix.append(ordered[: form.prefix(len(s))].tobytes())
            yield emit({"doc_id": part.column("doc_id").fill_null(NONE), "digest": digest, "size": size, "prefix": prefix, "search": search, "sketch": parities}, SETS)

    return run


def _entering(batches: Batches) -> Batches:
    """A row for each shingle of a node's prefix."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            raw = batch.column("prefix").to_pylist()
            n = np.array([len(x) // 8 for x in raw], np.int64)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(np.arange(len(n)), n)
            yield emit({"key": np.frombuffer(b"".join(raw), np.int64), "node": np.asarray(batch.column("node"))[row], "size": np.asarray(batch.column("size"))[row], "place": place}, ROWS)


def _table(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in names], axis=1)


def _shared(batches: Batches) -> Batches:
    """Rows whose key another row has too; a task holds the first row of each key of its part."""
    first, told = np.zeros((0, len(ROWS)), np.int64), np.zeros(0, bool)
    for rows in _unpacked(batches, len(ROWS)):
        new = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
        alone = new & np.append(new[1:], True)
        at, old = _met_before(first[:, 0], rows[:, 0])
        late = np.unique(at[old])
        late = late[~told[late]]
        told[late] = True
        yield emit(dict(zip(ROWS.names, np.concatenate([first[late], rows[old | ~alone]]).T)), ROWS)
        fresh = new & ~old
        first, told = np.concatenate([first, rows[fresh]]), np.concatenate([told, ~alone[fresh]])
        order = np.argsort(first[:, 0], kind="stable")
        first, told = first[order], told[order]


def _neighbours(form: Similar, names: list[str]) -> Callable[[Batches], Batches]:
    """Of rows sorted by key and a rank: each with the one before it and with the first of its key; ``root`` tells groups apart where it is among ``names``."""

    def run(batches: Batches) -> Batches:
        first = last = np.zeros((0, len(names)), np.int64)
        for batch in batches:
            rows = np.concatenate([first, last, _table(batch, names)])
            if not len(rows):
                continue
            new = np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])
            head = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
            a, b = np.concatenate([head, np.arange(len(rows) - 1)]), np.concatenate([np.arange(len(rows)), np.arange(1, len(rows))])
            good = rows[a, 0] == rows[b, 0]
            yield _met(rows, a[good], b[good], names.index("root") if "root" in names else 1, form)
            first, last = rows[head[-1]][None, :], rows[-1:]

    return run


def _met(rows: np.ndarray, a: np.ndarray, b: np.ndarray, group: int, form: Similar) -> pa.RecordBatch:
    """Pairs of rows (key, node, size, place, ...) that sizes and places allow, and whose ``group`` column differs."""
    size_a, size_b, place_a, place_b = rows[a, 2], rows[b, 2], rows[a, 3], rows[b, 3]
    good = np.minimum(size_a - place_a, size_b - place_b) >= form.common(size_a + size_b)
    good &= rows[a, group] != rows[b, group]
    swap = rows[a, 1] > rows[b, 1]
    a, b = np.where(swap, b, a)[good], np.where(swap, a, b)[good]
    return emit({"a": rows[a, 1], "b": rows[b, 1], "size_a": rows[a, 2], "size_b": rows[b, 2], "place_a": rows[a, 3], "place_b": rows[b, 3]}, MET)


def _pairing(form: Similar) -> Callable[[Batches], Batches]:
    """All pairs on each key of rows sorted by (key, size) whose roots differ."""
    names = [*ROWS.names, "root"]

    def pairs(rows: np.ndarray) -> Batches:
        new = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        end = np.repeat(np.append(new[1:], len(rows)), np.diff(new, append=len(rows)))
        n = end - np.arange(len(rows)) - 1
        upto = np.cumsum(n)
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
            k = n[at:to]
            a = np.repeat(np.arange(at, to), k)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)
            yield _met(rows, a, b, 4, form)
            at = to

    def run(batches: Batches) -> Batches:
        held = []  # rows of the last key so far
        for batch in batches:
            rows = _table(batch, names)
            if not len(rows):
                continue
            if held and rows[-1, 0] == held[0][0, 0]:
                held.append(rows)
                continue
            whole = np.concatenate([*held, rows])
            start = int(np.searchsorted(whole[:, 0], whole[-1, 0], "left"))
            held = [whole[start:]]
            if start:
                yield from pairs(whole[:start])
        if held:
            yield from pairs(np.concatenate(held))

    return run


def _confirming(form: Similar) -> Callable[[Batches], Batches]:
    """Links among rows sorted by (a, b), with the texts of ``b``; rows without a ``b`` bring those of ``a``."""

    def run(batches: Batches) -> Batches:
        a, own = None, []
        for part in slices(batches):
            out = {"a": [], "b": []}
            for x, y, text in zip(part.column("a").to_pylist(), part.column("b").to_pylist(), texts(part), strict=True):
                s = shingle_set(text, form.shingle)
                if x != a:
                    a, own = x, []
                if y is None:
                    own.append(s)
                    continue
                for o in own:
                    if len(np.intersect1d(o, s, assume_unique=True)) >= form.common(len(o) + len(s)):
                        out["a"].append(x)
                        out["b"].append(y)
                        break
            yield emit(out, LINKS)

    return run


def _possible(form: Similar) -> Callable[[Batches], Batches]:
    """Of rows (a, b) with sizes and sketches those whose sets may be as similar as asked."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            both = np.asarray(batch.column("size_a")) + np.asarray(batch.column("size_b"))
            least = np.array([apart(x, y) for x, y in zip(batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist(), strict=True)], np.int64)
            yield batch.select(PAIR.names).filter(pa.array(least <= both - 2 * form.common(both)))

    return run


def _confirmed(met: DataFrame, docs: DataFrame, sets: DataFrame, form: Similar, tried: list[DataFrame]) -> DataFrame:
    """Links of the candidates ``met`` whose texts are as similar as asked; those ``tried`` before are left out, and these are added.

    Shared shingles of both prefixes are counted; those not counted come after the last of
    them in both sets, which bounds the overlap.
    """
    pairs = met.groupBy("a", "b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("n"), F.max("place_a").alias("pa"), F.max("place_b").alias("pb"))
    most = F.col("n") + F.least(F.col("size_a") - F.col("pa"), F.col("size_b") - F.col("pb")) - 1
    least = F.ceil(F.lit(form.part) * (F.col("size_a") + F.col("size_b")) / F.lit(form.part + form.whole) - F.lit(1e-6))
    return _linked(pairs.filter(most >= least).select("a", "b").distinct(), docs, sets, form, tried)


def _linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, form: Similar, tried: list[DataFrame]) -> DataFrame:
    """Links of the candidates ``pairs(a, b)`` whose texts are as similar as asked, but for those ``tried``.

    Only texts whose sketches do not rule that out are exchanged.
    """
    for before in tried:
        pairs = pairs.join(before, ["a", "b"], "left_anti")
    pairs = cut(pairs, "near-pairs")
    tried.append(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = _among(sets.select(F.col("doc_id").alias("id"), "size", "sketch"), ids, 2 * pairs.count())
    one = lambda c: own.select(F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    pairs = cut(pairs.join(one("a"), "a").join(one("b"), "b").mapInArrow(_possible(form), spark_ddl(PAIR)).distinct(), "possible-pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    own = _among(docs.select(F.coalesce("doc_id", F.lit(NONE)).alias("id"), "text"), ids, 2 * pairs.count())
    left = own.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "text")
    right = pairs.join(own, F.col("b") == F.col("id")).select("a", "b", "text")
    both = left.unionByName(right).repartition("a").sortWithinPartitions("a", F.col("b").asc_nulls_first())
    links = cut(both.mapInArrow(_confirming(form), spark_ddl(LINKS)), "near-links")
    release(pairs)
    return links


def _among(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The ``rows`` whose id is one of the ``ids``, about ``n``, and few others: one bit for each hash of an id, sent to all executors."""
    at = F.pmod(F.xxhash64("id"), F.lit(min(BITS, max(64, 1 << (16 * n).bit_length()))))
    words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    return rows.withColumn("at", at).join(F.broadcast(words), F.shiftright("at", 6) == F.col("word")).filter("getbit(bits, cast(at & 63 as int)) = 1").select(*rows.columns)


def similar_groups(docs: DataFrame, form: Similar, fingerprint: Callable[[np.ndarray], bytes], search: Callable[[DataFrame], DataFrame], components: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, fingerprint (hex of the verified one) and component_id of every row of ``docs(doc_id, text)``.

    ``search`` gives candidates ``(a, b)`` among ``(search, verify, node)``, where ``search`` is a set's ``fingerprint`` and ``verify`` its first word.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, form))
    sets = cut(docs.mapInArrow(_setting(form, fingerprint, sent), spark_ddl(SETS)), "shingle-sets")
    tried: list[DataFrame] = []

    prints = cut(sets.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("search").alias("search")), "near-prints")
    met = search(prints.select("search", F.substring("search", 1, 8).alias("verify"), "node")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    roots = cut(components(_linked(met, docs, sets, form, tried)), "near-roots")

    nodes = sets.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    n = sets.agg(F.sum(F.lit(1) + F.col("size") * F.lit(form.whole - form.part) / F.lit(form.whole))).first()[0] or 0
    rows = _together(nodes.select("node", "size", "prefix"), _entering, ROWS, int(n))
    shared = cut(rows.mapInArrow(_shared, spark_ddl(ROWS)), "shared-shingles")
    hubs = shared.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    rooted = _rooted(shared, roots).join(hubs, "node")
    met = rooted.repartition("key").sortWithinPartitions("key", F.desc("n"), "node").mapInArrow(_neighbours(form, [*ROWS.names, "root"]), spark_ddl(MET))
    roots = cut(components(_confirmed(met, docs, sets, form, tried).unionByName(_as_links(roots))), "near-roots")

    met = _rooted(shared, roots).repartition("key").sortWithinPartitions("key", "size", "node").mapInArrow(_pairing(form), spark_ddl(MET))
    roots = components(_confirmed(met, docs, sets, form, tried).unionByName(_as_links(roots)))
    for done in (shared, *tried):
        release(done)
    named = prints.join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    doc_id = F.when(F.col("doc_id") != NONE, F.col("doc_id")).alias("doc_id")
    out = cut(sets.select("doc_id", "digest", "search").join(named, "digest").select(doc_id, F.lower(F.hex(F.substring("search", 1, 8))).alias("fingerprint"), "component_id"), "near-groups")
    for done in (sets, prints):
        release(done)
    return out


def _rooted(shared: DataFrame, roots: DataFrame) -> DataFrame:
    return shared.join(roots, "node", "left").select(*ROWS.names, F.coalesce("root", "node").alias("root"))


def _as_links(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
