"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on ordinary and on toxic text.  The ordinary one is
trained on ordinary texts as they are.  The toxic one is trained on what ordinary text does
not explain: the runs of toxic texts whose strings of ``GRAM`` bytes stand in many contexts
there and hardly anywhere in ordinary texts.  A text, in lower case, is cut at white space into
windows of up to ``WINDOW`` bytes of running text, which overlap by half, and each window is
compressed twice: after the ordinary dictionary alone, and after the toxic one followed by the ordinary one
(the same bytes at the same distance, so that only toxic matches can make a difference).
The gain of a window is how many bytes the toxic dictionary saves.

How many windows gain at least each of ``GAINS`` bytes, the mean and the largest gain make
a probability by a logistic curve, and a threshold on it calls a text toxic.  Both are
calibrated on labelled documents that the dictionaries were not trained on.

The dictionaries are trained on at most ``SAMPLE_DOCS`` labelled documents of each class, of
at most ``SAMPLE_BYTES`` each; the curve on the gains of as many others, measured by the
executors.

Cases: null, empty and white texts have one empty window without gain and get the score of
such texts; repeated rows are scored row by row; without labels of both kinds every score
is the share of toxic labels, or 0; other columns of the input, clashing or not, are
neither used nor returned.
"""

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import emit, slices, spark_ddl, texts

#: Labelled documents of each class that the dictionaries, and as many that the curve, are fitted on at most; and the bytes of each at most.
SAMPLE_DOCS, SAMPLE_BYTES = 4000, 32_768
#: Bytes of the windows.
WINDOW = 128
#: Bytes of the dictionaries, and of the segments that training takes.
ORDINARY_BYTES, ORDINARY_SEGMENT = 110_000, 32
TOXIC_BYTES, TOXIC_SEGMENT = 2048, 16
#: Bytes of a string that is compared between the kinds of text.
GRAM = 6
#: Contexts that a telling string has in toxic texts: so many, and so many for each text; their part of all its places, and by
#: how many standard deviations they exceed the share of toxic text.
LEAST_CONTEXTS, LEAST_PART, LEAST_RATIO, LEAST_EXCESS = 6, 0.03, 0.9, 3.5
#: Bytes that the windows counted gain at least.
GAINS = (1, 2, 3, 4, 5, 6, 8)
#: Score from which a text is called toxic.
CUT = 0.7

CUTS = re.compile(rb"(?s).{1,%d}(?:\s|\Z)|\S{1,%d}" % (WINDOW - 1, WINDOW))
HALF = re.compile(rb"(?s).{1,%d}\s" % (WINDOW // 2))
MEASURED = pa.schema([("doc_id", pa.int64()), ("windows", pa.int64()), ("toxic_windows", pa.int64()), ("gain", pa.int64()), ("most", pa.int64()), ("over", pa.list_(pa.int64()))])
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("windows", pa.int64()), ("toxic_windows", pa.int64())])


@dataclass(frozen=True)
class Dictionaries:
    ordinary: bytes
    toxic: bytes


@dataclass(frozen=True)
class Curve:
    """Weights of the columns of :func:`columns`."""

    weights: tuple[float, ...]

    def scores(self, gains: list[np.ndarray]) -> np.ndarray:
        return self.of(columns(*measures(gains)))

    def of(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


class Windows:
    """Compressed lengths of windows after the ordinary dictionary, and after both."""

    def __init__(self, made: Dictionaries) -> None:
        # The format does not look for matches in a dictionary's last bytes.
        end = b" " * 16
        self.plain = self._compressor(b" " * len(made.toxic) + made.ordinary + end)
        self.foul = self._compressor(made.toxic + made.ordinary + end)

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        how = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY, window_log=18, chain_log=17, hash_log=17, search_log=5, min_match=4, target_length=16,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)

    def lengths(self, window: bytes) -> tuple[int, int]:
        return len(self.plain.compress(window)), len(self.foul.compress(window))

    def gains(self, text: str) -> np.ndarray:
        plain, foul = self.plain.compress, self.foul.compress
        return np.array([len(plain(w)) - len(foul(w)) for w in cut_windows(text)], np.int64)


def lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def cut_windows(text: str) -> list[bytes]:
    """Windows from the start of a text, and again from half a window on."""
    raw = lowered(text)
    half = HALF.match(raw)
    return (CUTS.findall(raw) or [b""]) + (CUTS.findall(raw, half.end()) if half else [])


def grams(raw: bytes) -> np.ndarray:
    """The strings of ``GRAM`` bytes of a text, in order, as numbers."""
    a = np.frombuffer(raw, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(a) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        out = out << np.uint64(8) | a[k : k + len(out)]
    return out


def contexts(raw: bytes) -> np.ndarray:
    """Numbers of the bytes on both sides of each string of :func:`grams`."""
    a = np.frombuffer(b"    " + raw + b"    ", np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(raw) - GRAM + 1), np.uint64)
    for k in (0, 1, 2, 3, GRAM + 4, GRAM + 5, GRAM + 6, GRAM + 7):
        out = out << np.uint64(8) | a[k : k + len(out)]
    return out


def occurrences(texts_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The different strings of texts, sorted, and how often each occurs."""
    strings, many = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for at in range(0, len(texts_), 250):
        new, n = np.unique(np.concatenate([grams(t) for t in texts_[at : at + 250]]), return_counts=True)
        both = np.concatenate([strings, new])
        order = np.argsort(both, kind="stable")
        first = np.flatnonzero(np.diff(both[order], prepend=both[order][:1] + np.uint64(1)))
        strings, many = both[order][first], np.add.reduceat(np.concatenate([many, n])[order], first) if len(first) else many
    return strings, many


def unexplained(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The runs of toxic texts made of strings that stand in many contexts there and that ordinary texts hardly have.

    Copies of a text add no contexts.
    """
    strings, often = occurrences(toxic)
    known, plain = occurrences(ordinary)
    share = int(often.sum()) / max(1, int(often.sum() + plain.sum()))
    least = max(LEAST_CONTEXTS, LEAST_PART * len(toxic))
    place = np.minimum(np.searchsorted(known, strings), max(0, len(known) - 1))
    there = np.where(known[place] == strings, plain[place], 0) if len(known) else np.zeros(len(strings), np.int64)
    may = (often >= least) & (often >= LEAST_RATIO * (often + there))  # contexts are no more than occurrences
    strings, there = strings[may], there[may]
    held = []
    for raw in toxic:
        g = grams(raw)
        at = np.flatnonzero(np.isin(g, strings))
        held.append(np.unique(np.stack([g[at], contexts(raw)[at]], axis=1), axis=0))
    both = np.unique(np.concatenate([*held, np.zeros((0, 2), np.uint64)]), axis=0)
    many = np.bincount(np.searchsorted(strings, both[:, 0]), minlength=len(strings))
    all_ = many + there
    telling = strings[(many >= least) & (many >= LEAST_RATIO * all_) & (many - share * all_ >= LEAST_EXCESS * np.sqrt(all_ * share * (1 - share)))]
    runs = []
    for raw in toxic:
        at = np.flatnonzero(np.isin(grams(raw), telling))
        if len(at):
            cuts = np.flatnonzero(np.diff(at) > GRAM)
            runs += [raw[a : b + GRAM] for a, b in zip(at[np.append(0, cuts + 1)].tolist(), at[np.append(cuts, len(at) - 1)].tolist(), strict=True)]
    return runs


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary's content trained on samples; the samples themselves where they are too few to train on."""
    whole = b" ".join(samples)
    if len(whole) > 10 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
        except zstandard.ZstdError:
            pass
    return whole[-size:]


def train(toxic: list[str], ordinary: list[str]) -> Dictionaries:
    foul, plain = sorted({lowered(t) for t in toxic}), sorted({lowered(t) for t in ordinary})
    telling = trained(unexplained(foul, plain), TOXIC_BYTES, TOXIC_SEGMENT)
    return Dictionaries(trained([t[i : i + 256] for t in plain for i in range(0, len(t), 256)], ORDINARY_BYTES, ORDINARY_SEGMENT), telling)


def measures(gains: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Windows, bytes gained, largest gain, and windows over each of ``GAINS``, of each text."""
    over = np.array([[(g >= q).sum() for q in GAINS] for g in gains], np.int64).reshape(-1, len(GAINS))
    return tuple(np.array([f(g) for g in gains], np.int64) for f in (len, np.sum, np.max)) + (over,)


def columns(n: np.ndarray, gain: np.ndarray, most: np.ndarray, over: np.ndarray) -> np.ndarray:
    one, root = np.ones(len(n)), np.sqrt(n)
    return np.column_stack([one, np.log1p(n), gain / root, gain / n, most, np.log1p(over), over / root[:, None], over > 0]).astype(float)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression, the first column (the constant) not shrunk."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + keep, x.T @ (weight * (y - p)) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Curve:
    """The curve of measured documents, moved so that the cut with the best F1 lies at ``CUT``."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    middle[0], spread[0] = 0, 1
    w = logistic((x - middle) / spread, y, weight=weight / weight.mean()) / spread
    w[0] -= w[1:] @ middle[1:]
    p = Curve(tuple(w)).of(x)
    best = max(np.linspace(0.05, 0.95, 91), key=lambda c: (round(2 * weight[(p >= c) & (y > 0)].sum() / max(1e-9, weight[p >= c].sum() + weight[y > 0].sum()), 4), -abs(c - 0.5)))
    w[0] += np.log(CUT / (1 - CUT)) - np.log(best / (1 - best))
    return Curve(tuple(w.tolist()))


def constant(share: float) -> Curve:
    odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
    return Curve((float(np.clip(odds, -20, 20)), *(0.0,) * (4 + 3 * len(GAINS))))


def labelled(docs: DataFrame, labels: DataFrame, most: int, calibrating: bool) -> DataFrame:
    """doc_id, label and text of up to ``most`` documents of each class, by hash of doc_id: three in four train, the others calibrate."""
    picked = None
    pool = labels.filter((F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)) == 3) == calibrating)
    for value in (0, 1):
        part = pool.filter(F.col("toxic") == value).select(F.col("doc_id").alias("_id"), F.lit(value).alias("label")).distinct()
        part = part.orderBy(F.xxhash64("_id"), "_id").limit(most)
        picked = part if picked is None else picked.unionAll(part)
    short = docs.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES)
    rows = short.join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # however often a document is repeated


def score_toxicity(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, score, windows and toxic_windows of every row of ``docs(doc_id, text)``, learnt from ``labels(doc_id, toxic)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    total = dict(labels.groupBy("toxic").count().collect())
    sample = {0: [], 1: []}
    for r in labelled(docs, labels, sample_docs, False).collect():
        sample[r["label"]].append(r["text"] or "")
    made = train(sample[1], sample[0])
    share = total.get(1, 0) / max(1, total.get(0, 0) + total.get(1, 0))
    if sample[0] and sample[1] and made.toxic:
        rest = labelled(docs, labels, sample_docs, True)
        rows = measure(rest, made).collect()
        y = np.array([r["label"] for r in rows], float)
        curve = constant(share)
        if 0 < y.sum() < len(y):
            weight = np.where(y > 0, max(1, total.get(1, 0)) / y.sum(), max(1, total.get(0, 0)) / (len(y) - y.sum()))
            curve = calibrated(columns(*(np.array([r[c] for r in rows]) for c in ("windows", "gain", "most", "over"))), y, weight)
    else:
        curve = constant(share)
    return docs.mapInArrow(_scoring(made, curve), spark_ddl(SCORED))


def measure(docs: DataFrame, made: Dictionaries) -> DataFrame:
    """windows, toxic_windows, gain, most and over of every row of ``docs(doc_id, label, text)``, with its label."""
    return docs.mapInArrow(_measuring(made), spark_ddl(MEASURED) + ", label int")


_made: dict[str, Windows] = {}


def _windows(made: Dictionaries, key: str) -> Windows:
    if key not in _made:
        _made.clear()
        _made[key] = Windows(made)
    return _made[key]


def _measuring(made: Dictionaries) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    key = uuid.uuid4().hex
    schema = MEASURED.append(pa.field("label", pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n, gain, most, over = measures([_windows(made, key).gains(t) for t in texts(part)])
            yield emit({"doc_id": part.column("doc_id"), "windows": n, "toxic_windows": over[:, 0], "gain": gain, "most": most, "over": over.tolist(), "label": part.column("label")}, schema)

    return run


def _scoring(made: Dictionaries, curve: Curve) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = measures([_windows(made, key).gains(t) for t in texts(part)])
            yield emit({"doc_id": part.column("doc_id"), "score": curve.of(columns(*found)), "windows": found[0], "toxic_windows": found[3][:, 0]}, SCORED)

    return run
