"""Sharding by histogram sort.

Rows have a key of two numbers (a, b) and a size.  Splitters are found without sorting:
each round puts probe keys between the known ends of every open splitter, all partitions
count the exact bytes and rows below each probe, and the ends move together until the
bytes below a splitter are within the tolerance of its target or no key is left between.
Only then are the rows exchanged, once, each straight to its place.

For documents a is a hash of the text and b the doc_id, so equal texts are neighbours.  A
shard ends between two texts where that is within the tolerance, and inside a group of
copies only when the group is too large for that: a group of any size is dealt out.

Cases: a null text has no bytes and counts as the empty text; a null doc_id sorts first;
rows with equal keys are not torn apart by a splitter; more shards than rows leave shards
empty; an empty table gives an empty table.  The columns that are added replace columns
of the same names.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.arrow import emit, spark_ddl
from quern.plans.staging import cut, release

LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Probes between the ends of an open splitter, each round.
PROBES = 8
#: Pieces that are exchanged and numbered on their own: of about so many bytes, and how many there are at least and at most.
#: Beyond the most, pieces grow (and are sorted on disk where they must be), not what the driver holds.
PIECE_BYTES, PIECES, MOST_PIECES = 4_000_000, 512, 16_384

COUNTS = pa.schema([(c, pa.int64()) for c in ("bucket", "size", "rows", "a0", "a1", "b0", "b1")])


def locate(bounds_a: np.ndarray, bounds_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the sorted bounds are at or below each key."""
    out = np.searchsorted(bounds_a, a, "right")
    first = np.searchsorted(bounds_a, a, "left")
    for i in np.unique(first[first < out]):
        rows = np.flatnonzero((first == i) & (out > first))
        out[rows] = i + np.searchsorted(bounds_b[i : out[rows[0]]], b[rows], "right")
    return out


class Splitters:
    """Keys at which parts begin, with the exact bytes and rows below them."""

    def __init__(self, bounds: list[tuple[int, int]]) -> None:
        self.bounds = bounds
        self.a = np.array([x for x, _ in bounds], np.int64)
        self.b = np.array([y for _, y in bounds], np.int64)

    @property
    def parts(self) -> int:
        return len(self.bounds) + 1

    def locate(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return locate(self.a, self.b, a, b)

    @classmethod
    def by_size(cls, sizes: DataFrame, part_bytes: int, most: int) -> "Splitters":
        """Parts of about ``part_bytes`` of ``sizes(a, b, size)``, or ``most`` larger ones."""
        sizes = cut(sizes, "sizes")
        total = sizes.agg(F.sum("size")).first()[0] or 0
        n = min(most, max(1, -(-total // part_bytes)))
        bounds = cls(sorted(set(find(sizes, [total * k // n for k in range(1, n)], total / n / 20))))
        release(sizes)
        return bounds


def histogram(sizes: DataFrame, bounds: list[tuple[int, int]]) -> dict[int, tuple[int, ...]]:
    """Exact bytes and rows, and the least and largest a and b, of each bucket between sorted bounds."""
    at = Splitters(bounds)
    total = [f(c).alias(c) for f, c in ((F.sum, "size"), (F.sum, "rows"), (F.min, "a0"), (F.max, "a1"), (F.min, "b0"), (F.max, "b1"))]
    return {r[0]: tuple(r)[1:] for r in sizes.mapInArrow(_counting(at), spark_ddl(COUNTS)).groupBy("bucket").agg(*total).collect()}


def rows_below(sizes: DataFrame, bounds: list[tuple[int, int]]) -> list[int]:
    """Exact rows of keys below each of the sorted bounds."""
    found = histogram(sizes, bounds)
    return np.cumsum([found.get(k, (0, 0))[1] for k in range(len(bounds))], dtype=np.int64).tolist()


def _counting(at: Splitters) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((at.parts, 2), np.int64)
        least, most = np.full((at.parts, 2), MOST, np.int64), np.full((at.parts, 2), LEAST, np.int64)
        for batch in batches:
            a, b, size = (np.asarray(batch.column(c)) for c in ("a", "b", "size"))
            where = at.locate(a, b)
            total[:, 0] += np.bincount(where, weights=size, minlength=at.parts).astype(np.int64)
            total[:, 1] += np.bincount(where, minlength=at.parts)
            for k, column in enumerate((a, b)):
                np.minimum.at(least[:, k], where, column)
                np.maximum.at(most[:, k], where, column)
        used = np.flatnonzero(total[:, 1])
        ends = {"a0": least[used, 0], "a1": most[used, 0], "b0": least[used, 1], "b1": most[used, 1]}
        yield emit({"bucket": used, "size": total[used, 0], "rows": total[used, 1], **ends}, COUNTS)

    return run


class _Search:
    """Numbers lo <= x < hi between which one splitter lies, and the bytes below each.

    ``key`` makes a key of a number; ``part`` is the place of the number in a key.
    """

    def __init__(self, target: int, lo: int, hi: int, under: int, over: int, key: Callable[[int], tuple[int, int]], part: int) -> None:
        self.target, self.lo, self.hi, self.under, self.over, self.key, self.part = target, lo, hi, under, over, key, part

    def near(self, tolerance: float) -> bool:
        return min(self.target - self.under, self.over - self.target) <= tolerance

    def probes(self) -> list[int]:
        """The ends and the numbers between that are to be counted; a number past the last key needs no count."""
        between = {self.lo + (self.hi - self.lo) * k // (PROBES + 1) for k in range(1, PROBES + 1)}
        return sorted(between | {self.lo, self.hi} - {MOST + 1})

    def narrow(self, index: dict[tuple[int, int], int], sums: np.ndarray, found: dict[int, tuple[int, ...]], last: int) -> None:
        for x in self.probes():
            n = int(sums[index[self.key(x)]])
            if n <= self.target and x > self.lo:
                self.lo, self.under = x, n
            elif n > self.target and x < self.hi:
                self.hi, self.over = x, n
        end = index[self.key(self.hi)] if self.key(self.hi) in index else last
        inside = [found[k] for k in range(index[self.key(self.lo)] + 1, end + 1) if k in found]
        if inside:  # the keys that are there, not only those that could be
            self.lo = max(self.lo, min(f[2 + 2 * self.part] for f in inside))
            self.hi = min(self.hi, max(f[3 + 2 * self.part] for f in inside) + 1)
        else:
            self.hi = self.lo + 1

    def best(self) -> int:
        return self.lo if self.target - self.under <= self.over - self.target else self.hi


def _narrowed(sizes: DataFrame, searches: list[_Search], tolerance: float) -> None:
    while open_ := [s for s in searches if s.hi - s.lo > 1 and not s.near(tolerance)]:
        keys = sorted({s.key(x) for s in open_ for x in s.probes()})
        found = histogram(sizes, keys)
        sums = np.cumsum([found.get(k, (0,))[0] for k in range(len(keys))], dtype=np.int64)
        index = {k: i for i, k in enumerate(keys)}
        for s in open_:
            s.narrow(index, sums, found, len(keys))


def find(sizes: DataFrame, targets: list[int], tolerance: float, inside: bool = True) -> list[tuple[int, int]]:
    """A key for each target such that about that many bytes lie below it.

    ``inside``: where no value of ``a`` ends near a target, cut between values of ``b``.
    """
    if not targets:
        return []
    ends = sizes.agg(F.min("a"), F.max("a"), F.min("b"), F.max("b"), F.sum("size")).first()
    if ends[0] is None:
        return [(0, LEAST)] * len(targets)
    searches = [_Search(t, ends[0], ends[1] + 1, 0, ends[4], lambda x: (x, LEAST), 0) for t in targets]
    _narrowed(sizes, searches, tolerance / 10)
    deep = {}
    for i, s in enumerate(searches):
        if inside and s.hi - s.lo == 1 and not s.near(tolerance):
            deep[i] = _Search(s.target, ends[2], ends[3] + 1, s.under, s.over, lambda x, a=s.lo: (a, x), 1)
    _narrowed(sizes, list(deep.values()), 0)
    return [deep[i].key(min(deep[i].best(), MOST)) if i in deep else (min(s.best(), MOST), LEAST) for i, s in enumerate(searches)]


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = 0.01) -> DataFrame:
    """``docs(doc_id, text, ...)`` with size, shard and slot, in shards of near equal bytes.

    ``tolerance``: how far, as a part of a shard, its end may move to keep copies together.
    """
    docs = docs.drop("size", "shard", "slot")
    key = {"a": F.xxhash64(F.coalesce("text", F.lit(""))), "b": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), "size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")}
    sizes = cut(docs.select(*(c.alias(n) for n, c in key.items())), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    ends = find(sizes, [total * k // shards for k in range(1, shards)], tolerance * total / shards)
    pieces = min(MOST_PIECES, max(PIECES, total // PIECE_BYTES))
    inner = find(sizes, [total * k // pieces for k in range(1, pieces)], total / pieces / 4)
    bounds = sorted({*ends, *inner})
    rows = [0, *rows_below(sizes, bounds)]
    shard = [sum(e <= b for e in ends) for b in [(LEAST, LEAST), *bounds]]
    first = {s: rows[k] for k, s in reversed(list(enumerate(shard)))}
    place = _placing(Splitters(bounds), np.array(shard), np.array([r - first[s] for r, s in zip(rows, shard, strict=True)]))
    table = docs.withColumns({"_a": key["a"], "_b": key["b"], "size": key["size"]}).withColumn("_at", place("_a", "_b"))
    table = table.withColumns({"_piece": F.col("_at.piece"), "shard": F.col("_at.shard"), "_slot": F.col("_at.slot")}).drop("_at")
    order = Window.partitionBy("_piece").orderBy("_a", "_b")
    return table.withColumn("slot", F.row_number().over(order) - 1 + F.col("_slot")).drop("_a", "_b", "_piece", "_slot")


def _placing(at: Splitters, shards: np.ndarray, slots: np.ndarray):
    """The piece of a key, its shard, and the shard's rows before the piece."""
    import pandas as pd

    @F.pandas_udf("piece int, shard int, slot long")
    def place(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        piece = at.locate(a.to_numpy(), b.to_numpy())
        return pd.DataFrame({"piece": piece.astype(np.int32), "shard": shards[piece].astype(np.int32), "slot": slots[piece]})

    return place
