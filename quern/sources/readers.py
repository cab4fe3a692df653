"""Readers of CSV, Parquet, Arrow and sparse vector text, with the handling of bad and missing cells."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from urllib.parse import parse_qs, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def identifier(name: str) -> str:
    """A column name made a valid identifier."""
    out = re.sub(r"\W", "_", str(name).strip())
    return out if out and not out[0].isdigit() else f"_{out}"


def normalise_names(names: Iterable[str]) -> list[str]:
    """Valid and different column names."""
    seen: dict[str, int] = {}
    out = []
    for n in map(identifier, names):
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}_{k}" if k else n)
    return out


def generated_names(n: int) -> list[str]:
    """Names of the columns of a file without a header: _1 .. _n."""
    return [f"_{i + 1}" for i in range(n)]


def _finish(df: DataFrame, columns, filter_, fillvalues, as_array, nrows, order) -> DataFrame:
    if filter_ is not None:
        df = df.filter(filter_) if isinstance(filter_, Column | str) else df.mapInPandas(lambda it: (filter_(p) for p in it), df.schema)
    if columns:
        df = df.select(*columns)
    if fillvalues:
        df = df.na.fill(fillvalues["*"]) if "*" in fillvalues else df.na.fill(fillvalues)
    if as_array:
        for name, parts in ({as_array: df.columns} if isinstance(as_array, str) else as_array(df.columns) if callable(as_array) else as_array).items():
            df = df.withColumn(name, F.array(*parts)).drop(*(c for c in parts if c != name))
    return (df.orderBy(order) if order else df).limit(nrows) if nrows is not None else df


def finish(df: DataFrame, columns=None, filter_=None, fillvalues=None, as_array=None, nrows=None, order=None) -> DataFrame:
    """What every reader does with the rows it has read: filter, choose, fill, pack into arrays and stop."""
    return _finish(df, columns, filter_, fillvalues, as_array, nrows, order)


def read_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None, header: bool = False, columns: list[str] | None = None, filter_=None, fillvalues: dict | None = None, as_array=None, nrows: int | None = None, order: str | None = None, drop_na: bool = False, **options) -> DataFrame:
    """CSV files (plain, gz or bz2 by extension) with valid column names.

    Give a schema: without one the types are inferred, which reads the files twice.
    """
    reader = spark.read.options(header=header, **options)
    df = reader.schema(schema).csv(paths) if schema is not None else reader.csv(paths, inferSchema=True)
    if schema is None:
        df = df.toDF(*(normalise_names(df.columns) if header else generated_names(len(df.columns))))
    df = _finish(df, columns, filter_, fillvalues, as_array, None, None)
    df = df.na.drop("any") if drop_na else df
    return _finish(df, None, None, None, None, nrows, order)


def read_csv_checked(spark: SparkSession, paths: str | list[str], schema: T.StructType | str, header: bool = False, imputer: dict | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Rows with cells that cannot be read as null (or imputed), and the anomalies: row text, column, bad value."""
    wanted = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    raw = spark.read.options(header=header, **options).schema(T.StructType([T.StructField(f.name, T.StringType()) for f in wanted])).csv(paths)
    read = lambda f: F.col(f"`{f.name}`").try_cast(f.dataType)
    fill = imputer or {}
    rows = raw.select(*((F.coalesce(read(f), F.lit(fill[f.name])) if f.name in fill else read(f)).alias(f.name) for f in wanted))
    cells = F.array(*(F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("value"), read(f).isNull().alias("bad")) for f in wanted))
    anomalies = raw.select(F.to_json(F.struct(*raw.columns)).alias("row"), F.inline(cells)).filter("bad and value is not null").drop("bad")
    return rows, anomalies


def read_parquet(spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, filter_=None, drop_na: bool = True, **more) -> DataFrame:
    """Parquet files; rows with a null in a loaded column are dropped."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    df = _finish(df, columns, filter_, None, None, None, None)
    df = df.na.drop("any") if drop_na else df
    return _finish(df, None, None, more.get("fillvalues"), more.get("as_array"), more.get("nrows"), more.get("order"))


def missing_counts(df: DataFrame) -> DataFrame:
    """One row: how many cells of each column are null."""
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))


def read_arrow(spark: SparkSession, source: pa.Table | pa.RecordBatchReader, drop_na: bool = True) -> DataFrame:
    """A table or record batch reader of the driver's process."""
    table = source if isinstance(source, pa.Table) else source.read_all()
    df = spark.createDataFrame(table)
    return df.na.drop("any") if drop_na else df


def read_listed(spark: SparkSession, names: DataFrame, reader: Callable[..., DataFrame], column: str = "filename", **options) -> DataFrame:
    """The files that a (small) table names, one after another."""
    return reader(spark, [r[0] for r in names.select(column).collect()], **options)


def read_vectors(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sparse vectors in text, ``index:weight`` pairs on each line, as map<int, float>."""
    pairs = F.regexp_extract_all("value", F.lit(r"(\d+):([-+.\deE]+)"), F.lit(0))
    entry = lambda p: F.struct(F.split_part(p, F.lit(":"), F.lit(1)).cast("int"), F.split_part(p, F.lit(":"), F.lit(2)).cast("float"))
    return spark.read.text(paths).select(F.map_from_entries(F.transform(pairs, entry)).alias("vector"))


def read_url(spark: SparkSession, url: str, **options) -> DataFrame:
    """``buffer://name?cols=&rows=`` makes a table; other addresses go to the file systems of the cluster."""
    at = urlsplit(url)
    if at.scheme == "buffer":
        from quern.sources.generators import random_table

        query = {k: int(v[0]) for k, v in parse_qs(at.query).items()}
        return random_table(spark, query.get("rows", 1000), query.get("cols", 1))
    return (read_parquet if at.path.endswith(".parquet") else read_csv)(spark, url, **options)


def with_row_id(df: DataFrame, key: str | list[str], rid: str = "_rid") -> DataFrame:
    """Ids from 0 in the order of a natural key.

    Rows are numbered within range partitions, and the partitions' sizes are added up, so
    no task sees all rows.
    """
    keys = [key] if isinstance(key, str) else key
    from quern.plans.staging import cut

    dealt = cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "row-ids")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    return dealt.withColumn("_k", number).join(F.broadcast(before), "_part").withColumn(rid, F.col("_k") + F.col("_before")).drop("_part", "_k", "_before")


def fill_cells(df: DataFrame, values: dict) -> DataFrame:
    """Default cell values by column, or ``{"*": value}`` for all."""
    return df.na.fill(values["*"]) if "*" in values else df.na.fill(values)


def read_csv_archived(spark: SparkSession, paths: str | list[str], schema: str, **options) -> DataFrame:
    """CSV in zip or xz files, which the engine's own reader does not open: one task expands one file, line by line."""

    def expand(batches):
        import io
        import lzma
        import zipfile

        import pandas as pd

        for pdf in batches:
            for path, raw in zip(pdf["path"], pdf["content"]):
                if path.endswith(".zip"):
                    z = zipfile.ZipFile(io.BytesIO(raw))
                    opened = [z.open(n) for n in z.namelist()]
                else:
                    opened = [lzma.open(io.BytesIO(raw)) if path.endswith(".xz") else io.BytesIO(raw)]
                for f in opened:
                    held = []
                    for line in io.TextIOWrapper(f, "utf-8", newline="\n"):
                        held.append(line.rstrip("\r\n"))
                        if len(held) == 10_000:
                            yield pd.DataFrame({"line": held})
                            held = []
                    yield pd.DataFrame({"line": held}, dtype=object)

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(expand, "line string").filter("line <> ''").select(F.from_csv("line", schema, options).alias("r")).select("r.*")
