"""SimHash near-dedup by multi-index hashing.

Each text has a fingerprint: bit i is set if it is set in over half of the hashes of its
word shingles.  Equal fingerprints are taken together first.  The distinct ones are
entered in one table for each segment of their bits, and each enumerates the small Hamming
ball around its segment: the segment itself and every value with one of its set bits
cleared (of two values one bit apart, one clears a bit to reach the other).  Entries and
probes with the same value meet, complete distances are verified there, and what is linked
comes out as a spanning forest of each meeting, so a group of n near copies costs no n*n
links.  With s segments and a ball of 1, every pair within 2s-1 bits is found.

A value of a segment that very many fingerprints share is dealt to blocks of entries; each
block meets all probes of the value, streamed past it, so no task holds more than a block.

Links become groups by alternating large-star and small-star steps, each written to the
shared folder.

``NEAR`` is for near copies at a similarity of 0.8 or more on five-word shingles.  Their
fingerprints are searched as above, in the form ``SEARCH``, and the exact similarity of the
texts confirms each pair.  About 15 % of the bits of two fingerprints differ at 0.8, where
no search of segments is complete, so :mod:`quern.llm.near_copies` adds an exact way for
the pairs whose fingerprints lie too far apart.

Cases: texts with fewer words than a shingle have one shingle of all of them; null, empty
and white texts have fingerprint zero and are linked like any other; repeated rows have
equal fingerprints; rows with the same doc_id are one node; a null doc_id takes part as
the least number; an empty table gives an empty table; other columns are ignored.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import emit, slices, spark_ddl, texts
from quern.llm.near_copies import Similar, similar_groups
from quern.plans.staging import cut, release

NONE = -(1 << 63)
#: Entries of one value of a segment that one task holds.
BLOCK = 4096
#: Candidate pairs verified at once.
PAIRS = 1_000_000

PRINTS = pa.schema([("doc_id", pa.int64()), ("search", pa.binary()), ("verify", pa.binary())])
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


@dataclass(frozen=True)
class Form:
    """How fingerprints are made and compared."""

    shingle: int = 3  # words of a shingle of the verified fingerprint
    words: int = 1  # 64-bit words of it
    distance: int = 2  # most differing bits of linked fingerprints
    segments: int = 2
    bits: int = 32  # of a segment
    search_shingle: int = 0  # words of a shingle of the searched fingerprint; 0: search the verified one
    ball: int = 1  # bits by which segments that meet may differ
    direct: bool = False  # links are compared pairs, for a check to follow, and not a spanning forest

    @property
    def search_words(self) -> int:
        return -(-self.segments * self.bits // 64)


EXACT = Form()
NEAR = Similar(shingle=5, part=4, whole=5)
#: Of the pairs at 0.8 one in 500 differs in more of the 64 bits, of unlike texts one pair in 3,000 in no more.
SEARCH = Form(shingle=5, words=1, distance=18, segments=12, bits=20, search_shingle=5, ball=0, direct=True)


def shingles(words: list[bytes], n: int) -> list[bytes]:
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(n)))))


def simhash(parts: list[bytes], words: int) -> bytes:
    """Fingerprint of 64 * ``words`` bits, big-endian; the first word hashes with seed 42."""
    if not parts:
        return bytes(8 * words)
    n = len(parts)
    out = []
    for k in range(words):
        seed = 42 + k
        ones = np.zeros(64, np.int64)
        for at in range(0, n, 65_536):
            h = np.array([xxhash.xxh64_intdigest(p, seed) for p in parts[at : at + 65_536]], dtype=">u8")
            ones += _bit_sums(h)
        out.append(np.packbits(2 * ones > n).tobytes())
    return b"".join(out)


def set_fingerprint(hashes: np.ndarray) -> bytes:
    """Fingerprint to search in the form ``SEARCH`` of a set of shingles, from their 64-bit hashes; its first word is the verified one."""
    out = []
    for k in range(SEARCH.search_words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65_536):
            ones += _bit_sums(_mixed(hashes[at : at + 65_536], k).astype(">u8"))
        out.append(np.packbits(2 * ones > len(hashes)).tobytes())
    return b"".join(out)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of what has the hashes ``h``."""
    x = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _bit_sums(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, first bit highest."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):  # sums of 255 bits fit a byte
        out += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return out


def fingerprint(text: str, form: Form) -> tuple[bytes, bytes]:
    """The searched and the verified fingerprint of a text."""
    words = text.encode("utf-8", "replace").lower().split()
    verify = simhash(shingles(words, form.shingle), form.words)
    return (simhash(shingles(words, form.search_shingle), form.search_words) if form.search_shingle else verify), verify


def fingerprints(docs: DataFrame, form: Form = EXACT) -> DataFrame:
    """doc_id, search and verify of every row of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_printing(form), spark_ddl(PRINTS))


def _printing(form: Form) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            both = [fingerprint(t, form) for t in texts(part)]
            yield emit({"doc_id": part.column("doc_id").fill_null(NONE), "search": [x for x, _ in both], "verify": [y for _, y in both]}, PRINTS)

    return run


def _segments(search: pa.Array, form: Form) -> np.ndarray:
    """Value of each segment of each fingerprint, with the segment's number above its bits."""
    rows = np.frombuffer(b"".join(search.to_pylist()), np.uint8).reshape(len(search), -1)
    bits = np.unpackbits(rows, axis=1)[:, : form.segments * form.bits].reshape(len(search), form.segments, form.bits)
    weights = 1 << np.arange(form.bits - 1, -1, -1, dtype=np.int64)
    return bits @ weights + (np.arange(form.segments, dtype=np.int64) << 32)


def _meeting_schema(form: Form) -> pa.Schema:
    return pa.schema([("key", pa.int64()), ("probe", pa.int32()), ("node", pa.int64()), *((f"v{k}", pa.int64()) for k in range(form.words))])


def _entering(form: Form, probes: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Entries of fingerprints in the tables of their segments, and their probes."""
    schema = _meeting_schema(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                node = np.asarray(batch.column("node"))
                verify = np.frombuffer(b"".join(batch.column("verify").to_pylist()), ">i8").astype(np.int64).reshape(len(node), form.words)
                keys = _segments(batch.column("search"), form)
                row, _ = np.indices(keys.shape)
                found = [(keys.ravel(), 0, row.ravel())]
                if probes:
                    found.append((keys.ravel(), 1, row.ravel()))
                    for bit in range(form.bits if form.ball else 0):
                        r, s = np.nonzero(keys >> bit & 1)
                        found.append((keys[r, s] - (1 << bit), 1, r))
                for key, probe, r in found:
                    yield emit({"key": key, "probe": np.full(len(key), probe), "node": node[r], **{f"v{k}": verify[r, k] for k in range(form.words)}}, schema)

    return run


def _linking(form: Form) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Verify entries against probes of the same value in rows sorted by (key, block, probe)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "block", "probe", "node", *(f"v{k}" for k in range(form.words))]
        kept = np.zeros((0, len(names)), np.int64)  # entries of the last value so far
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in names], axis=1)
            if not len(rows):
                continue
            rows = np.concatenate([kept, rows]) if len(kept) and (kept[0, :2] == rows[0, :2]).all() else rows
            new = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]))
            group = np.repeat(np.arange(len(new)), np.diff(new, append=len(rows)))
            entry = rows[:, 2] == 0
            count = np.bincount(group[entry], minlength=len(new))
            probe = np.flatnonzero(~entry & (count[group] > 0))
            cost = np.cumsum(count[group[probe]])
            parts = np.searchsorted(cost, np.arange(0, cost[-1] if len(cost) else 0, PAIRS), "left")
            for lo, hi in zip(parts, [*parts[1:], len(probe)]):
                p = probe[lo:hi]
                n = count[group[p]]
                left = np.repeat(p, n)
                right = np.repeat(new[group[p]], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
                apart = sum(_differ(rows[left, 4 + k], rows[right, 4 + k]) for k in range(form.words))
                near = (apart <= form.distance) & (rows[left, 3] != rows[right, 3])
                a, b = rows[left[near], 3], rows[right[near], 3]
                if len(a):
                    yield emit(dict(zip("ab", (direct if form.direct else forest)(a, b))), LINKS)
            kept = rows[new[-1] :][rows[new[-1] :, 2] == 0]

    return run


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)).astype(np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node to the least node of its group: as connected as the links given."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while (new != (jump := new[new])).any():
            new = jump
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def direct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links of each node those to its least lower and its least higher neighbour."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((low, high))
    least = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
    order = np.lexsort((high, low))
    kept = np.unique(np.concatenate([least, order[np.concatenate([[True], low[order][1:] != low[order][:-1]])]]))
    return low[kept], high[kept]


def components(links: DataFrame) -> DataFrame:
    """node and root (least node reachable) of every node of ``links(a, b)`` that is not a root."""
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        large = both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = cut(large, "large-star")
        least = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        pairs = large.join(least, F.col("u") == F.col("w"))
        small = pairs.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()
        was, e = e, cut(small, "small-star")
        release(was)
        release(large)


def search(nodes: DataFrame, form: Form) -> DataFrame:
    """Links between ``nodes(search, verify, node)`` that meet on a segment and differ in few enough bits."""
    ddl = spark_ddl(_meeting_schema(form))
    entries = nodes.mapInArrow(_entering(form, probes=False), ddl)
    hot = cut(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK).select(F.col("key").alias("hot"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot")
    met = nodes.mapInArrow(_entering(form, probes=True), ddl)
    if hot.isEmpty():
        met = met.withColumn("block", F.lit(0))
    else:
        met = met.join(hot, F.col("key") == F.col("hot"), "left")
        own = F.array(F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"))
        all_ = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
        met = met.withColumn("block", F.explode(F.when(F.col("probe") == 0, own).otherwise(all_))).drop("hot", "blocks")
    return met.repartition("key", "block").sortWithinPartitions("key", "block", "probe").mapInArrow(_linking(form), spark_ddl(LINKS))


def near_groups(docs: DataFrame, form: Form | Similar = EXACT) -> DataFrame:
    """doc_id, fingerprint (hex of the verified one) and component_id of every row of ``docs(doc_id, text)``."""
    if isinstance(form, Similar):
        return similar_groups(docs, form, set_fingerprint, lambda nodes: search(nodes, SEARCH), components)
    prints = cut(fingerprints(docs, form), "prints")
    nodes = cut(prints.groupBy("search", "verify").agg(F.min("doc_id").alias("node")), "nodes")
    roots = components(search(nodes, form))
    named = nodes.join(roots, "node", "left").select("search", "verify", F.coalesce("root", "node").alias("component_id"))
    doc_id = F.when(F.col("doc_id") != NONE, F.col("doc_id")).alias("doc_id")
    return prints.join(named, ["search", "verify"]).select(doc_id, F.lower(F.hex("verify")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, form: Form | Similar = NEAR) -> DataFrame:
    """``docs`` with one document, that of the smallest doc_id, of each group of near copies."""
    groups = near_groups(docs, form)
    own = F.coalesce("doc_id", F.lit(NONE))
    gone = groups.filter(own != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
