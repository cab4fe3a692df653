"""Generated tables: random columns, Gaussian blobs, constants and the sample data sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def constant(spark: SparkSession, rows: list, schema=None) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def constant_dict(spark: SparkSession, values: dict) -> DataFrame:
    """One row of named values."""
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))


def random_table(spark: SparkSession, rows: int, columns: int | list[str], kind: str = "uniform", seed: int = 42) -> DataFrame:
    """_rid and columns of uniform or normal values."""
    names = [f"_{i + 1}" for i in range(columns)] if isinstance(columns, int) else columns
    f = F.rand if kind == "uniform" else F.randn
    return spark.range(rows).select(F.col("id").alias("_rid"), *(f(seed + i).alias(c) for i, c in enumerate(names)))


def random_stream(spark: SparkSession, rows_per_second: int, columns: int = 1, seed: int = 42) -> DataFrame:
    """An unbounded table of random values."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(F.col("value").alias("_rid"), "timestamp", *(((F.xxhash64("value", F.lit(seed + i)) & ((1 << 53) - 1)) / float(1 << 53)).alias(f"_{i + 1}") for i in range(columns)))


def random_dict(spark: SparkSession, columns: int, seed: int = 42) -> DataFrame:
    return random_table(spark, 1, columns, seed=seed).drop("_rid")


def blobs(spark: SparkSession, rows: int, centres: list[list[float]], sigma: float | list[list[float]] = 1.0, seed: int = 42) -> DataFrame:
    """_rid, coordinates and label of Gaussian blobs; ``sigma`` is a deviation or a covariance for all blobs."""
    at, size = np.array(centres, float), len(centres[0])
    factor = np.linalg.cholesky(np.array(sigma)) if isinstance(sigma, list) else np.eye(size) * sigma

    def made(batches):
        import pandas as pd

        for pdf in batches:
            ids = pdf["id"].to_numpy()
            if not len(ids):
                continue
            rng = np.random.default_rng([seed, int(ids[0])])
            label = rng.integers(0, len(at), len(ids))
            xy = at[label] + rng.normal(size=(len(ids), size)) @ factor.T
            yield pd.DataFrame({"_rid": ids, **{f"_{i + 1}": xy[:, i] for i in range(size)}, "label": label.astype(np.int32)})

    return spark.range(rows).mapInPandas(made, "_rid long, " + ", ".join(f"`_{i + 1}` double" for i in range(size)) + ", label int")


def dataset(spark: SparkSession, name: str) -> DataFrame:
    """bigfile, smallfile (normal columns), their multiscale forms, and three Gaussian clusters."""
    if name in ("bigfile", "smallfile"):
        rows, columns = (1_000_000, 30) if name == "bigfile" else (30_000, 10)
        t = random_table(spark, rows, columns, "normal", 1234)
        return t.select("_rid", *((F.col(c) * 0.8 + 0.5).alias(c) for c in t.columns[1:]))
    if name in ("bigfile_multiscale", "smallfile_multiscale"):
        rows = 5_000_000 if name.startswith("big") else 30_000
        scale = {"A": (0, 3), "B": (5, 2), "C": (-5, 4), "D": (5, 3)}
        t = spark.range(rows).select(F.col("id").alias("_rid"), *((F.randn(i) * s + m).alias(c) for i, (c, (m, s)) in enumerate(scale.items())))
        return t.withColumns({"I": F.floor(F.rand(9) * 10_000).cast("int"), "S": F.get(F.array(*map(F.lit, "ABCD")), F.floor(F.rand(10) * 4).cast("int"))})
    if name == "bigfile_mvn":
        return blobs(spark, 900_000, [[0, 0], [5, 5], [-4, 6]], [[1.0, 0.3], [0.3, 0.8]])
    raise KeyError(f"no such data set here: {name}")
