"""Line dedup over minimal perfect hashes.

A line's key is its text without white space at the ends and with A-Z in lower case,
taken as two independent 64-bit hashes.  Keys are counted over documents (each document
names a key once) with partial aggregation, those found in enough documents are dealt to
shards by their first hash, and each shard becomes one file: a minimal perfect hash over
its keys that indexes arrays of fingerprints (the second hash), document counts and the
largest doc_id.  The documents' lines probe the arrays; lines are never joined.

A document needs the shards of all its lines.  When all files together are within
``PROBE_BYTES`` (their exact size is known), every worker holds them and documents are
read once more and written out.  Beyond that, only an index of the hot lines goes to every
worker, those with more than 1 / ``HOT_LINES`` of all places (so no more than that many);
the short hashes of the other lines travel to the shards, are probed there, and come back
as the keys each document loses.

The minimal perfect hash gives each key a place by its pilot: keys are thrown into small
buckets, the largest bucket first, and each bucket takes the first pilot that sends all
its keys to free places.

Cases: a null or empty text is one empty line; short lines and empty lines always stay;
a line repeated within one document counts once; rows with the same doc_id count as
separate documents, and all rows with the largest doc_id keep the line; null doc_ids count
as documents and never keep a line that another holds; an empty table gives an empty
table; all columns of the input are kept by :func:`dedup_lines` and a column of the same
name as an added one is replaced.
"""

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.arrow import emit, slices, spark_ddl, texts
from quern.plans.staging import cut

WHITE = " \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Files of all shards that a worker may hold at once.
PROBE_BYTES = 64_000_000
#: Lines with more than this part of all places are hot.
HOT_LINES = 10_000
#: Keys of one shard, about; and keys of a bucket of the perfect hash, about.
SHARD_KEYS, BUCKET_KEYS = 200_000, 4
NONE = -(1 << 63)

KEYS = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64())])
SHARDS = pa.schema([("shard", pa.int32()), ("file", pa.binary())])
LOST = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])


def mixed(keys: np.ndarray, pilots: np.ndarray | int) -> np.ndarray:
    """Well-mixed 64-bit values of keys under pilots."""
    with np.errstate(over="ignore"):
        x = keys ^ (np.asarray(pilots, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class LineIndex:
    """A minimal perfect hash over line hashes with arrays of fingerprint, count and owner."""

    def __init__(self, pilots: np.ndarray, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> None:
        self.pilots, self.prints, self.counts, self.owners = pilots, prints, counts, owners

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> "LineIndex":
        keys = h1.view(np.uint64)
        n = len(keys)
        buckets = n // BUCKET_KEYS + 1
        home = (mixed(keys, 0) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        ends = np.searchsorted(home[order], np.arange(buckets + 1))
        pilots, taken, place = np.zeros(buckets, np.uint32), np.zeros(n, bool), np.zeros(n, np.int64)
        tries = np.arange(1, 257, dtype=np.uint64)
        for b in np.argsort(ends[:-1] - ends[1:], kind="stable"):
            rows = order[ends[b] : ends[b + 1]]
            if not len(rows):
                break
            base = 0
            while True:  # 256 pilots at once
                spots = (mixed(keys[rows][None, :], (tries + np.uint64(base))[:, None]) % np.uint64(n)).astype(np.int64)
                good = ~taken[spots].any(axis=1)
                if len(rows) > 1:
                    s = np.sort(spots, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    pilots[b] = base + k + 1
                    place[rows] = spots[k]
                    taken[spots[k]] = True
                    break
                base += 256
        out = cls(pilots, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64))
        out.prints[place], out.counts[place], out.owners[place] = h2, counts, owners
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<QQ", len(self.pilots), len(self.prints)) + b"".join(x.tobytes() for x in (self.pilots, self.prints, self.counts, self.owners))

    @classmethod
    def from_bytes(cls, raw: bytes) -> "LineIndex":
        b, n = struct.unpack_from("<QQ", raw)
        at = 16 + 4 * b
        return cls(np.frombuffer(raw, np.uint32, b, 16), *(np.frombuffer(raw, np.int64, n, at + 8 * n * k) for k in range(3)))

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and owner of each key; count 0 for keys that are not there."""
        if not len(self.prints):
            return np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        keys = h1.view(np.uint64)
        pilots = self.pilots[(mixed(keys, 0) % np.uint64(len(self.pilots))).astype(np.int64)]
        at = (mixed(keys, pilots) % np.uint64(len(self.prints))).astype(np.int64)
        return np.where(self.prints[at] == h2, self.counts[at], 0), self.owners[at]


def _hashed(batch: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """Document, first and second hash of each line that is long enough, and the lines of each text."""
    docs, one, two, lines = [], [], [], []
    x64 = xxhash.xxh3_64_intdigest
    for k, text in enumerate(batch):
        parts = text.split("\n")
        lines.append(parts)
        for line in parts:
            key = line.strip(WHITE)
            if len(key) >= least:
                raw = key.encode("utf-8", "replace").translate(LOWER)
                docs.append(k)
                one.append(x64(raw))
                two.append(x64(raw, 0x5EED))
    return np.array(docs, np.int64), np.array(one, np.uint64).view(np.int64), np.array(two, np.uint64).view(np.int64), lines


def _line_keys(least: int, hot=None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The keys that each document names, without those of the ``hot`` index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            doc, h1, h2, _ = _hashed(texts(part), least)
            if hot is not None:
                rest = LineIndex.from_bytes(hot.value).probe(h1, h2)[0] == 0
                doc, h1, h2 = doc[rest], h1[rest], h2[rest]
            both = np.unique(np.stack([doc, h1, h2], axis=1), axis=0) if len(doc) else np.zeros((0, 3), np.int64)
            ids = part.column("doc_id").take(pa.array(both[:, 0]))
            yield emit({"doc_id": ids, "h1": both[:, 1], "h2": both[:, 2]}, KEYS)

    return run


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def build_index(docs: DataFrame, least_chars: int, least_docs: int) -> tuple[DataFrame, int, DataFrame]:
    """Files (shard, file) over the keys found in at least ``least_docs`` documents, the number of shards, and the keys."""
    keys = _own(docs).mapInArrow(_line_keys(least_chars), spark_ddl(KEYS))
    counted = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("doc_id"), F.lit(NONE)).alias("owner")).filter(F.col("n") >= least_docs)
    counted = cut(counted, "line-keys")
    shards = max(1, -(-counted.count() // SHARD_KEYS))
    dealt = counted.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard"))
    return cut(dealt.mapInArrow(_building(shards), spark_ddl(SHARDS)), "line-index"), shards, counted


def _building(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            index = LineIndex.build(*(np.asarray(t.column(c)) for c in ("h1", "h2", "n", "owner")))
            yield emit({"shard": [t.column("shard")[0].as_py()], "file": [index.to_bytes()]}, SHARDS)

    return run


def _probe_all(files: dict[int, LineIndex], shards: int, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    count, owner = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
    where = h1 % shards
    for s in np.unique(where):
        if (index := files.get(int(s))) is not None:
            rows = np.flatnonzero(where == s)
            count[rows], owner[rows] = index.probe(h1[rows], h2[rows])
    return count, owner


#: By the name that the driver gave them: a broadcast's address is used again once it is dropped.
_loaded: dict[str, dict[int, LineIndex]] = {}


def _rewrite(files, shards: int, least: int, out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents without the lines that the arrays say they lose."""
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _loaded:
            _loaded.clear()
            _loaded[key] = {s: LineIndex.from_bytes(raw) for s, raw in files.value}
        for part in slices(batches):
            doc, h1, h2, lines = _hashed(texts(part), least)
            count, owner = _probe_all(_loaded[key], shards, h1, h2)
            yield _kept(part, lines, (count > 0) & (owner != _ids(part)[doc]), least, out)

    return run


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return np.asarray(part.column("doc_id").cast(pa.int64()).fill_null(NONE))


def _kept(part: pa.RecordBatch, lines: list[list[str]], lost: np.ndarray, least: int, out: pa.Schema) -> pa.RecordBatch:
    text, total, dropped, at = [], [], [], 0
    for parts in lines:
        stay = []
        for line in parts:
            if len(line.strip(WHITE)) >= least:
                at += 1
                if lost[at - 1]:
                    continue
            stay.append(line)
        text.append("\n".join(stay))
        total.append(len(parts))
        dropped.append(len(parts) - len(stay))
    made = {"text": text, "n_lines": total, "n_dropped": dropped}
    return emit({f.name: made[f.name] if f.name in made else part.column(f.name) for f in out}, out)


def _routed(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Probe the line hashes that have come to a shard; the file comes first in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for batch in batches:
            file = batch.column("file")
            for k in np.flatnonzero(np.asarray(file.is_valid())):
                index = LineIndex.from_bytes(file[int(k)].as_py())
            rows = batch.filter(file.is_null())
            if index is None or not rows.num_rows:
                continue
            h1, h2 = (np.asarray(rows.column(c)) for c in ("h1", "h2"))
            count, owner = index.probe(h1, h2)
            lost = (count > 0) & (owner != _ids(rows))
            yield emit({"doc_id": rows.column("doc_id").filter(pa.array(lost)), "key": _whole(h1[lost], h2[lost])}, LOST)

    return run


def _whole(h1: np.ndarray, h2: np.ndarray) -> list[bytes]:
    raw = np.stack([h1, h2], axis=1).tobytes()
    return [raw[k : k + 16] for k in range(0, len(raw), 16)]


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, probe_bytes: int = PROBE_BYTES, hot_lines: int = HOT_LINES) -> DataFrame:
    """``docs`` with the lines that stay as ``text``, and n_lines and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    spark = docs.sparkSession
    files, shards, counted = build_index(docs, least_chars, least_docs)
    kept = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    out = pa.schema([*_arrow_schema(docs), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
    size = files.agg(F.sum(F.octet_length("file"))).first()[0] or 0
    if size <= probe_bytes:
        held = spark.sparkContext.broadcast([(r["shard"], bytes(r["file"])) for r in files.collect()])
        return docs.mapInArrow(_rewrite(held, shards, least_chars, out), kept)
    hot = spark.sparkContext.broadcast(_hot_index(counted, hot_lines).to_bytes())
    hashes = _own(docs).mapInArrow(_line_keys(least_chars, hot), spark_ddl(KEYS))
    hashes = hashes.select("doc_id", "h1", "h2", F.pmod("h1", F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("binary").alias("file"))
    both = hashes.unionByName(files, allowMissingColumns=True).repartitionById(shards, F.col("shard")).sortWithinPartitions(F.col("file").isNull())
    lost = both.mapInArrow(_routed(shards), spark_ddl(LOST)).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("key").alias("_lost"))
    joined = docs.join(lost, docs["doc_id"].eqNullSafe(lost["_id"]), "left").drop("_id")
    return joined.mapInArrow(_rewrite_lost(least_chars, hot, out), kept)


def _hot_index(counted: DataFrame, hot_lines: int) -> LineIndex:
    """An index of the at most ``hot_lines`` keys that have more than their part of all places."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.filter(F.col("n") * hot_lines > total).collect()
    return LineIndex.build(*(np.array([r[c] for r in rows], np.int64) for c in ("h1", "h2", "n", "owner")))


def _rewrite_lost(least: int, hot, out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LineIndex.from_bytes(hot.value)
        for part in slices(batches):
            doc, h1, h2, lines = _hashed(texts(part), least)
            count, owner = index.probe(h1, h2)
            lost = (count > 0) & (owner != _ids(part)[doc])
            gone = [set(x or ()) for x in part.column("_lost").to_pylist()]
            lost |= np.array([k in gone[d] for d, k in zip(doc.tolist(), _whole(h1, h2), strict=True)], bool)
            yield _kept(part, lines, lost, least, out)

    return run


def _arrow_schema(docs: DataFrame) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(docs.schema))
