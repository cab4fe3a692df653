"""Quality by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics (shares of symbols, capitals, digits,
repeated words and lines, lengths of words and lines).  Means and second moments of the
two classes are summed over all labelled rows on the cluster; on the driver they become
class covariances, shrunk towards their diagonal and towards the pooled covariance, and
their Cholesky factors, which workers keep.  A score is the difference of the classes'
log-densities, made a probability by a logistic curve fitted to a bounded sample of the
labelled rows.

Cases: null and empty texts have the statistics of no words and are scored by them;
repeated rows are scored row by row; a document with several labels counts for each;
without labels of both kinds every score is the share of good labels, or 0.5; other
columns of the input, clashing or not, are neither used nor returned.
"""

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.arrow import emit, slices, spark_ddl, texts
from quern.llm.toxicity import logistic
from quern.plans.staging import cut, release

#: Weight of the pooled covariance and of the diagonal in a class covariance.
POOL, DIAGONAL = 0.1, 0.05
#: Rows that the logistic curve is fitted on at most (those with the least hashes of their ids).
CURVE_ROWS = 20_000

LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
CAPITALS, DIGITS, SPACES, STOPS = bytes(range(65, 91)), b"0123456789", b" \t\n\x0b\x0c\r", b".,;:'\"-?()"
SYMBOLS = bytes(b for b in range(128) if b not in LETTERS + DIGITS + SPACES + STOPS)
NAMES = ("symbols", "capitals", "digits", "stops", "word_length", "long_words", "distinct_words", "top_word", "words", "lines", "distinct_lines")
FEATURES = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("log_ratio", pa.float64())])


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, in the order of ``NAMES``.

    Shares are drawn towards usual ones, as if the text had a few more usual words.
    """
    raw = text.encode("utf-8", "replace")
    part = lambda k, n, usual, weight: float(np.log((k + usual * weight) / (n + weight) + 0.002))
    share = lambda which, usual: part(len(raw) - len(raw.translate(None, which)), len(raw), usual, 60)
    words = raw.split()
    n = len(words)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        share(SYMBOLS, 0.0),
        share(CAPITALS, 0.03),
        share(DIGITS, 0.0),
        share(STOPS, 0.03),
        float(np.log((len(raw) - n + 60) / (n + 12))),
        part(sum([k for w, k in counts.items() if len(w) > 20]), n, 0.0, 12),
        part(n - len(counts), n, 0.2, 12),
        part(max(counts.values(), default=0), n, 0.08, 12),
        float(np.log1p(n)),
        float(np.log1p(len(lines))),
        part(len(lines) - len(set(lines)), len(lines), 0.0, 4),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of every row of ``docs(doc_id, text)``."""
    return docs.select("doc_id", "text").mapInArrow(_measuring, spark_ddl(FEATURES))


def _measuring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        yield emit({"doc_id": part.column("doc_id"), "x": [statistics(t) for t in texts(part)]}, FEATURES)


@dataclass
class Discriminant:
    means: list[np.ndarray]
    factors: list[np.ndarray]  # lower Cholesky factors of the class covariances
    constants: list[float]  # log prior less half the log determinant
    curve: tuple[float, float] = (0.0, 1.0)

    @classmethod
    def fit(cls, counts: list[float], sums: list[np.ndarray], squares: list[np.ndarray]) -> "Discriminant":
        """From each class's rows, sums and sums of outer products."""
        means = [s / n for n, s in zip(counts, sums, strict=True)]
        covariances = [q / n - np.outer(m, m) for n, q, m in zip(counts, squares, means, strict=True)]
        pooled = sum(n * c for n, c in zip(counts, covariances, strict=True)) / sum(counts)
        factors, constants = [], []
        for n, c in zip(counts, covariances, strict=True):
            c = (1 - POOL) * c + POOL * pooled
            c = (1 - DIAGONAL) * c + DIAGONAL * np.diag(np.diag(c)) + 1e-3 * np.eye(len(c))
            factor = np.linalg.cholesky(c)
            factors.append(factor)
            constants.append(float(np.log(n / sum(counts)) - np.log(np.diag(factor)).sum()))
        return cls(means, factors, constants)

    def log_ratio(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        low, high = (k - 0.5 * (np.linalg.solve(f, (x - m).T) ** 2).sum(axis=0) for m, f, k in zip(self.means, self.factors, self.constants, strict=True))
        return high - low

    def score(self, ratio: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * squash(ratio), -30, 30)))


def squash(ratio: np.ndarray) -> np.ndarray:
    """Log-ratios far out say little more than nearer ones."""
    return np.sign(ratio) * np.log1p(np.abs(ratio))


def fit_quality(measured: DataFrame, labels: DataFrame, curve_rows: int = CURVE_ROWS) -> Discriminant | float:
    """The discriminant of ``labels(doc_id, quality)``, or the share of good labels where there is but one class."""
    d = len(NAMES)
    rows = measured.join(labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("y")), "doc_id")
    x = [F.col("x")[i] for i in range(d)]
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    total = rows.groupBy("y").agg(F.count(F.lit(1)), *(F.sum(c) for c in x), *(F.sum(x[i] * x[j]) for i, j in pairs)).collect()
    by = {r[0]: r for r in total}
    if len(by) < 2:
        return float(next(iter(by))) if by else 0.5
    counts, sums, squares = [], [], []
    for y in (0, 1):
        counts.append(float(by[y][1]))
        sums.append(np.array(by[y][2 : 2 + d], float))
        q = np.zeros((d, d))
        for (i, j), v in zip(pairs, by[y][2 + d :], strict=True):
            q[i, j] = q[j, i] = v
        squares.append(q)
    model = Discriminant.fit(counts, sums, squares)
    sample = sorted(rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(curve_rows).select("doc_id", "x", "y").collect())
    ratio = model.log_ratio(np.array([r[1] for r in sample]))
    w = logistic(np.stack([np.ones(len(ratio)), squash(ratio)], axis=1), np.array([r[2] for r in sample], float))
    model.curve = (float(w[0]), float(w[1]))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, curve_rows: int = CURVE_ROWS) -> DataFrame:
    """doc_id, score and log_ratio of every row of ``docs(doc_id, text)``, learnt from ``labels(doc_id, quality)``."""
    measured = cut(features(docs), "features")
    model = fit_quality(measured, labels, curve_rows)
    return measured.mapInArrow(_scoring(model), spark_ddl(SCORED))


def keep_good(docs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Rows of ``docs`` whose text scores at least ``least``, as learnt from ``labels(doc_id, quality)``.

    Texts are measured for the fit and again to be kept or not: that takes less than moving
    them, once to their labels or once to their scores, and needs no exchange of texts.
    """
    measured = cut(features(docs), "features")
    model = fit_quality(measured, labels)
    release(measured)
    return docs.mapInArrow(_keeping(model, least), docs.schema)


def _ratios(model: Discriminant | float, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(model, float):
        return np.full(len(x), model), np.zeros(len(x))
    ratio = model.log_ratio(x)
    return model.score(ratio), ratio


def _scoring(model: Discriminant | float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, len(NAMES))
            score, ratio = _ratios(model, x)
            yield emit({"doc_id": batch.column("doc_id"), "score": score, "log_ratio": ratio}, SCORED)

    return run


def _keeping(model: Discriminant | float, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = np.array([statistics(t) for t in texts(part)]).reshape(part.num_rows, len(NAMES))
            yield part.filter(pa.array(_ratios(model, x)[0] >= least))

    return run
