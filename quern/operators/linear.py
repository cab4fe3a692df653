"""Linear maps, expressions over several tables, projections and clustering."""

from __future__ import annotations

import math
from functools import reduce as fold

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.elementwise import BINARY, UNARY
from quern.functions.expressions import translate


def linear_map(vectors: DataFrame, matrix: DataFrame, columns: list[str] | None = None, order: str = "_rid", rid: str = "_rid") -> DataFrame:
    """Row vectors times a matrix of as many rows as the vectors have columns.

    The matrix is a parameter of that many rows; it becomes constants of the expression.
    """
    columns = columns or [c for c in vectors.columns if c != rid]
    out = [c for c in matrix.columns if c != order]
    rows = matrix.orderBy(order).limit(len(columns) + 1).collect()
    if len(rows) != len(columns):
        raise ValueError(f"the matrix has not {len(columns)} rows")
    keep = [rid] if rid in vectors.columns else []
    return vectors.select(*keep, *(fold(lambda a, b: a + b, [F.col(c) * float(r[m]) for c, r in zip(columns, rows, strict=True)]).alias(m) for m in out))


def _aligned(tables: dict[str, DataFrame], rid: str) -> DataFrame:
    named = [t.select(rid, F.struct(*(c for c in t.columns if c != rid)).alias(n)) for n, t in tables.items()]
    return fold(lambda a, b: a.join(b, rid), named)


def expressions(tables: dict[str, DataFrame], outputs: dict[str, str], rid: str = "_rid") -> DataFrame:
    """Columns from expression strings over ``table.column`` of tables aligned by row id."""
    return _aligned(tables, rid).select(rid, *(translate(e)[1].alias(n) for n, e in outputs.items()))


def functions(tables: dict[str, DataFrame], outputs: dict[str, tuple], rid: str = "_rid") -> DataFrame:
    """Columns from (function, "table.column", ...) over tables aligned by row id."""
    made = {n: (UNARY if len(a) == 1 else BINARY)[f](*map(F.col, a)) for n, (f, *a) in outputs.items()}
    return _aligned(tables, rid).select(rid, *(c.alias(n) for n, c in made.items()))


def principal_components(df: DataFrame, columns: list[str], n: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, components (rows, each with its largest entry positive) and variances, from one pass of moments."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[: i + 1]]
    row = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.covar_samp(a, b).alias(f"c_{a}_{b}") for a, b in pairs)).first()
    mean = np.array([row[f"m_{c}"] for c in columns], float)
    cov = np.zeros((len(columns),) * 2)
    for a, b in pairs:
        i, j = columns.index(a), columns.index(b)
        cov[i, j] = cov[j, i] = row[f"c_{a}_{b}"] or 0.0
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:n]
    parts = vectors[:, order].T
    parts = parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None]
    return mean, parts, values[order]


def project(df: DataFrame, columns: list[str], n: int = 2) -> DataFrame:
    """The table with its first principal components as _pc1 .. _pcn."""
    mean, parts, _ = principal_components(df, columns, n)
    terms = lambda p: fold(lambda a, b: a + b, [(F.col(c) - float(m)) * float(w) for c, m, w in zip(columns, mean, p, strict=True)])
    return df.withColumns({f"_pc{k + 1}": terms(p) for k, p in enumerate(parts)})


def k_means(df: DataFrame, columns: list[str], k: int, seed: int = 1, rounds: int = 50, tolerance: float = 1e-6, centres: list[list[float]] | None = None) -> tuple[DataFrame, np.ndarray]:
    """The table with ``label`` (from 0), and the centres.  Centres may be given (and moved by a user)."""
    if centres is None:
        keyed = df.select(*columns).distinct()
        centres = [list(r) for r in keyed.orderBy(F.xxhash64(*columns, F.lit(seed)), *columns).limit(k).collect()]
    current = np.array(centres, float)

    def labelled(c: np.ndarray) -> DataFrame:
        far = [fold(lambda a, b: a + b, [(F.col(x) - float(v)) * (F.col(x) - float(v)) for x, v in zip(columns, row, strict=True)]) for row in c]
        nearest = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far))))
        return df.withColumn("_near", nearest).withColumn("label", F.col("_near.i")).withColumn("_d", F.col("_near.d")).drop("_near")

    for _ in range(rounds):
        got = {r["label"]: [r[c] for c in columns] for r in labelled(current).groupBy("label").agg(*(F.avg(c).alias(c) for c in columns)).collect()}
        new = np.array([got.get(i, current[i]) for i in range(len(current))], float)
        moved = float(np.abs(new - current).max())
        current = new
        if moved <= tolerance:
            break
    return labelled(current).drop("_d"), current


def inertia(df: DataFrame, columns: list[str], centres: np.ndarray) -> float:
    far = [fold(lambda a, b: a + b, [(F.col(x) - float(v)) * (F.col(x) - float(v)) for x, v in zip(columns, row, strict=True)]) for row in centres]
    return df.agg(F.sum(F.least(*far) if len(far) > 1 else far[0])).first()[0]


def cluster_rows(labelled: DataFrame, label: int) -> DataFrame:
    return labelled.filter(F.col("label") == label)


def kernel_density(df: DataFrame, points: DataFrame, columns: list[str], k: int = 100, bandwidth: float = 0.2, block: int = 1000) -> DataFrame:
    """density of each point (a bounded set of places) from its k nearest rows, by a Gaussian kernel.

    Points go to the rows in blocks; each task keeps its k nearest rows of each point, and
    the tasks' lists are merged by point.
    """
    places = points.select(*columns).limit(block + 1).collect()
    if len(places) > block:
        raise ValueError(f"more than {block} points; give them in blocks")
    at = np.array(places, float)

    def nearest(batches):
        import pandas as pd

        best = np.full((len(at), k), np.inf)
        for pdf in batches:
            rows = pdf[columns].to_numpy(float)
            for i in range(0, len(rows), 4096):
                d = np.sqrt(((at[:, None, :] - rows[None, i : i + 4096, :]) ** 2).sum(axis=2))
                best = np.sort(np.concatenate([best, d], axis=1), axis=1)[:, :k]
        p, j = np.nonzero(np.isfinite(best))
        yield pd.DataFrame({"point": p.astype(np.int64), "d": best[p, j]})

    near = df.select(*columns).mapInPandas(nearest, "point long, d double")
    near = near.groupBy("point").agg(F.slice(F.array_sort(F.collect_list("d")), 1, k).alias("d"))
    total = F.aggregate("d", F.lit(0.0), lambda s, d: s + F.exp(-0.5 * (d / bandwidth) * (d / bandwidth)))
    named = df.sparkSession.createDataFrame([(i, *map(float, p)) for i, p in enumerate(places)], "point long, " + ", ".join(f"`{c}` double" for c in columns))
    return named.join(near, "point").withColumn("density", total / (bandwidth * math.sqrt(2 * math.pi) * k)).drop("d")


def tsne(rows: np.ndarray, n: int = 2, perplexity: float = 30.0, steps: int = 300, seed: int = 1) -> np.ndarray:
    """t-SNE places of a bounded sample held on the driver."""
    rng, size = np.random.default_rng(seed), len(rows)
    d = ((rows[:, None] - rows[None]) ** 2).sum(axis=2)
    p = np.zeros((size, size))
    for i in range(size):
        lo, hi, beta = 0.0, np.inf, 1.0
        for _ in range(50):
            w = np.exp(-(d[i] - np.delete(d[i], i).min()) * beta)
            w[i] = 0
            w /= w.sum()
            entropy = -(w[w > 0] * np.log(w[w > 0])).sum()
            if abs(entropy - math.log(perplexity)) < 1e-4:
                break
            lo, hi = (beta, hi) if entropy > math.log(perplexity) else (lo, beta)
            beta = beta * 2 if hi == np.inf else (lo + hi) / 2
        p[i] = w
    p = np.maximum((p + p.T) / (2 * size), 1e-12)
    y, speed = rng.normal(0, 1e-4, (size, n)), np.zeros((size, n))
    for step in range(steps):
        q = 1 / (1 + ((y[:, None] - y[None]) ** 2).sum(axis=2))
        np.fill_diagonal(q, 0)
        force = ((p * (4 if step < 100 else 1) - q / q.sum()) * q)[:, :, None] * (y[:, None] - y[None])
        speed = (0.5 if step < 100 else 0.8) * speed - 100 * 4 * force.sum(axis=1)
        y = y + speed
        y -= y.mean(axis=0)
    return y
