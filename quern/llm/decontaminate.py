"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits in lower case.  A benchmark item and a document that
share runs of ``LEAST_TILE`` words (found by running Karp-Rabin hashes over word numbers) are
tiled: again and again the longest match of unmarked words is marked as a tile, until no
match of ``LEAST_TILE`` words is left.  Tiles may stand in any order, so a passage whose
sentences were moved about is still found, also when they are short.  A document is contaminated by an item when
tiles cover at least ``coverage`` of the item's words.

Items are the query set.  They are taken in blocks of bounded bytes; a block is sent to
the workers and run against all documents.  Items and words are compared themselves after
a hash has matched.

Cases: items without words match nothing; items shorter than a least tile must occur whole, and
``least_words`` leaves out items that are too short to tell anything; null
and empty texts match nothing; repeated documents and repeated items are reported row by
row, equal pairs once for each item row; empty tables give empty tables; the columns of
the documents are untouched by :func:`drop_contaminated`.
"""

import heapq
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import emit, slices, spark_ddl, texts

WORD = re.compile(r"[^\W_]+")
#: Words of a least tile of an :class:`ItemBlock` that names none, and of one that is searched for contamination.
SEED, LEAST_TILE = 5, 3
#: Text bytes of the items in one block.
BLOCK_BYTES = 4_000_000
BASE = np.uint64(0x100000001B3)

FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int64()), ("longest", pa.int64()), ("covered_words", pa.int64()), ("item_words", pa.int64())])


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``n`` word numbers, modulo 2^64."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        for k in range(n):
            out = out * BASE + ids[k : k + len(out)].astype(np.uint64)
    return out


def tile(doc: list[int], item: list[int], seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Tiles (document position, item position, words), longest first, from shared seeds.

    Seeds on one diagonal that touch are one match.  A match that has lost words to a
    longer tile goes back with what is left of it.
    """
    by_diagonal = defaultdict(list)
    for d, i in seeds:
        if doc[d : d + least] == item[i : i + least]:
            by_diagonal[d - i].append(i)
    heap = []
    for diagonal, starts in by_diagonal.items():
        starts.sort()
        begin = prev = starts[0]
        for i in [*starts[1:], None]:
            if i is None or i > prev + 1:
                heap.append((-(prev + least - begin), begin + diagonal, begin))
                begin = i
            prev = i
    heapq.heapify(heap)
    marked_doc, marked_item, tiles = set(), set(), []
    while heap:
        size, d, i = heapq.heappop(heap)
        run, parts = 0, []
        for k in range(-size + 1):
            free = k < -size and d + k not in marked_doc and i + k not in marked_item
            if free:
                run += 1
            elif run:
                parts.append((run, k - run))
                run = 0
        if parts == [(-size, 0)]:
            tiles.append((d, i, -size))
            marked_doc.update(range(d, d - size))
            marked_item.update(range(i, i - size))
        else:
            for n, k in parts:
                if n >= least:
                    heapq.heappush(heap, (-n, d + k, i + k))
    return tiles


class ItemBlock:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], coverage: float, least: int = SEED) -> None:
        self.coverage, self.least = coverage, least
        self.numbers: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.items = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(t)] for _, t in items]
        #: By seed length: sorted hashes, and where each is (item, position).
        self.seeds = {}
        spots = defaultdict(lambda: defaultdict(list))
        for k, item in enumerate(self.items):
            n = min(least, len(item))
            if n:
                for i, h in enumerate(rolling(np.array(item), n).tolist()):
                    spots[n][h].append((k, i))
        for n, at in spots.items():
            self.seeds[n] = (np.array(sorted(at), np.uint64), at)

    def search(self, batch: list[str]) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(place of the text, place of the item, tiles) of contaminated texts."""
        number = self.numbers.get
        docs = [[number(w, 0) for w in words(t)] for t in batch]
        gap = [0] * self.least
        flat, starts = [], []
        for d in docs:
            starts.append(len(flat))
            flat += d
            flat += gap  # no seed reaches over it, as word 0 is in no item
        ids, begin = np.array(flat, np.int64), np.array(starts)
        hits: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
        for n, (hashes, at) in self.seeds.items():
            h = rolling(ids, n)
            known = np.ones(len(h), bool)
            for k in range(n):
                known &= ids[k : k + len(h)] > 0
            pos = np.flatnonzero(known)
            place = np.minimum(np.searchsorted(hashes, h[pos]), len(hashes) - 1)
            pos = pos[hashes[place] == h[pos]]
            doc = np.searchsorted(begin, pos, "right") - 1
            for p, d in zip(pos.tolist(), doc.tolist(), strict=True):
                for k, i in at[int(h[p])]:
                    hits[d, k, n].append((p - starts[d], i))
        for (d, k, n), seeds in hits.items():
            item = self.items[k]
            need = self.coverage * len(item)
            if len({i + j for _, i in seeds for j in range(n)}) < need:
                continue  # tiles cover no more than the seeds do
            tiles = tile(docs[d], item, seeds, n)
            if sum(t[2] for t in tiles) >= need:
                yield d, k, tiles


def _blocks(benchmark: DataFrame, coverage: float, block_bytes: int, least_words: int) -> Iterator:
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        rows = [(r[0], r[1]) for r in rows if len(words(r[1])) >= least_words]
        if rows:
            yield benchmark.sparkSession.sparkContext.broadcast((coverage, rows))


#: By the name that the driver gave them: a value's address is used again once it is dropped.
_built: dict[str, ItemBlock] = {}


def _block(sent, key: str) -> ItemBlock:
    if key not in _built:
        _built.clear()
        coverage, items = sent.value
        _built[key] = ItemBlock(items, coverage, LEAST_TILE)
    return _built[key]


def find_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, block_bytes: int = BLOCK_BYTES, least_words: int = 1) -> DataFrame:
    """A row for each document of ``docs(doc_id, text)`` and item of ``benchmark(item_id, text)`` that it holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for sent in _blocks(benchmark, coverage, block_bytes, least_words):
        part = docs.mapInArrow(_finding(sent), spark_ddl(FOUND))
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], spark_ddl(FOUND)) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.8, block_bytes: int = BLOCK_BYTES, least_words: int = 1) -> DataFrame:
    """``docs`` without the documents that hold an item of the benchmark."""
    schema = docs.schema
    for sent in _blocks(benchmark, coverage, block_bytes, least_words):
        docs = docs.mapInArrow(_dropping(sent), schema)
    return docs


def _finding(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            block = _block(sent, key)
            ids, out = part.column("doc_id").to_pylist(), {f.name: [] for f in FOUND}
            for d, k, tiles in block.search(texts(part)):
                covered, size = sum(t[2] for t in tiles), len(block.items[k])
                for name, x in zip(out, (ids[d], block.ids[k], covered / size, len(tiles), tiles[0][2], covered, size), strict=True):
                    out[name].append(x)
            yield emit(out, FOUND)

    return run


def _dropping(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            bad = {d for d, _, _ in _block(sent, key).search(texts(part))}
            yield part.filter(pa.array([k not in bad for k in range(part.num_rows)], pa.bool_()))

    return run
