"""Readers, generators, progressive evaluation, change logs, sessions, pipelines."""

import bz2
import gzip
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.operators import stats
from quern.plans import pipeline
from quern.sources import generators, readers
from quern.streaming import changes, progressive, session


def test_names():
    assert readers.normalise_names(["a b", "a b", "1x", ""]) == ["a_b", "a_b_1", "_1x", "_"]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x\n2,y\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("3,z\n")
    with bz2.open(tmp_path / "c.csv.bz2", "wt") as f:
        f.write("4,\n")
    paths = [str(tmp_path / n) for n in ("a.csv", "b.csv.gz", "c.csv.bz2")]
    df = readers.read_csv(spark, paths)
    assert df.columns == ["_1", "_2"] and df.count() == 4
    assert readers.read_csv(spark, paths, schema="i int, s string", drop_na=True, filter_="i > 1").count() == 2
    assert readers.read_csv(spark, paths, schema="i int, s string", fillvalues={"s": "?"}, nrows=2, order="i").count() == 2
    assert readers.read_csv(spark, paths, schema="i int, j string", columns=["i"], as_array={"v": ["i"]}).columns == ["v"]
    names = spark.createDataFrame([(p,) for p in paths], "filename string")
    assert readers.read_listed(spark, names, readers.read_csv, schema="i int, s string").count() == 4


def test_bad_cells(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("1,x\noops,y\n,z\n")
    good, bad = readers.read_csv_checked(spark, str(tmp_path / "bad.csv"), "i int, s string", imputer={"i": -1})
    assert sorted(r["i"] for r in good.collect()) == [-1, -1, 1]
    assert [(r["column"], r["value"]) for r in bad.collect()] == [("i", "oops")]


def test_parquet_arrow_vectors(spark, tmp_path):
    t = pa.table({"a": [1, None, 3], "b": ["x", "y", None]})
    assert readers.read_arrow(spark, t).count() == 1 and readers.read_arrow(spark, t, drop_na=False).count() == 3
    spark.createDataFrame(t.to_pandas()).write.parquet(str(tmp_path / "p"))
    assert readers.read_parquet(spark, str(tmp_path / "p"), columns=["b"]).count() == 2
    assert readers.read_parquet(spark, str(tmp_path / "p"), drop_na=False, filter_=F.col("b") == "x").count() == 1
    assert tuple(readers.missing_counts(readers.read_arrow(spark, t, drop_na=False)).first()) == (1, 1)
    (tmp_path / "v.vec").write_text("0:1.5 3:-2e1\n\n7:0.25\n")
    assert [r["vector"] for r in readers.read_vectors(spark, str(tmp_path / "v.vec")).collect()] == [{0: 1.5, 3: -20.0}, {}, {7: 0.25}]
    assert readers.read_url(spark, "buffer://x?cols=3&rows=20").count() == 20


def test_row_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    got = {r["k"]: r["_rid"] for r in readers.with_row_id(df, "k").collect()}
    assert got == {k: k for k in range(1000)}


def test_generators(spark):
    t = generators.random_table(spark, 100, 2)
    assert t.columns == ["_rid", "_1", "_2"] and t.agg(F.max("_1")).first()[0] < 1
    b = generators.blobs(spark, 300, [[0, 0], [50, 50]], 1.0)
    assert b.groupBy("label").agg(F.avg("_1")).count() == 2
    assert generators.constant_dict(spark, {"a": 1, "b": "x"}).first().asDict() == {"a": 1, "b": "x"}
    assert generators.dataset(spark, "smallfile").count() == 30_000
    assert set(generators.dataset(spark, "smallfile_multiscale").columns) == set("ABCDIS") | {"_rid"}
    assert len(generators.random_dict(spark, 3).columns) == 3
    with pytest.raises(KeyError):
        generators.dataset(spark, "mnist")


@pytest.fixture
def parts(spark, tmp_path):
    for k in range(4):
        spark.range(k * 100, k * 100 + 100).select("id", (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v")).coalesce(1).write.mode("append").parquet(str(tmp_path / "parts"))
        time.sleep(0.02)
    return str(tmp_path / "parts")


@pytest.mark.parametrize("aggregates", [True, False])
def test_progressive(spark, parts, aggregates):
    schema = "id long, g long, v double"
    seen = []
    operator = (lambda df: df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))) if aggregates else lambda df: stats.quantiles(df, ["v"], [0.5]).withColumn("n", F.lit(0))
    trace = progressive.progressive(progressive.file_stream(spark, parts, schema), operator, lambda df, run: seen.append(df.collect()), aggregates)
    assert len(seen) == 4 == len(trace.rows)
    if aggregates:
        assert [sum(r["n"] for r in rows) for rows in seen] == [100, 200, 300, 400]
    else:
        assert seen[-1][0]["v"] == 199.5


def test_stop_early(spark, parts):
    seen = []

    def look(df, run):
        seen.append(run)
        raise progressive.StopEarly

    trace = progressive.progressive(progressive.file_stream(spark, parts, "id long, g long, v double"), lambda df: df.groupBy("g").count(), look)
    assert seen == [0] and trace.rows[-1]["state"] == "stopped"


def test_observers(spark, parts):
    stream = lambda: progressive.file_stream(spark, parts, "id long, g long, v double", files_per_batch=2)
    got, first = [], []
    q = progressive.every(stream(), lambda df, run: got.append(df.count()))
    assert progressive.wait(q, reads=400) and progressive.progress(q)[0] == 400
    q.stop()
    assert sum(got) == 400
    q = progressive.wait_for_data(stream(), lambda df: first.append(df.count()))
    q.processAllAvailable()
    q.stop()
    assert len(first) == 1
    q = progressive.sink(stream())
    assert progressive.wait(q, delay=0.1)
    q.stop()


def test_step_size_and_prefixes(spark):
    s = progressive.StepSize(quantum=0.5)
    assert s.steps() == 100
    s.ran(1000, 0.25)
    assert s.steps() == 2000
    assert [p.count() for p in progressive.prefixes(spark.range(100), "id", 4)][-1] == 100


def test_changes(spark):
    log = spark.createDataFrame([(1, "C", 1, 1.0), (1, "U", 2, 2.0), (2, "C", 1, 1.0), (2, "D", 3, None), (3, "D", 1, None), (3, "C", 2, 9.0), (4, "U", 1, 4.0), (4, "D", 2, None), (5, "U", 1, 5.0)], "_rid long, _op string, _run long, x double")
    small = changes.compact(log, ["x"])
    assert sorted((r["_rid"], r["_op"], r["x"]) for r in small.filter("_op <> 'D'").collect()) == [(1, "C", 2.0), (3, "U", 9.0), (5, "U", 5.0)]
    assert [r["_rid"] for r in small.filter("_op = 'D'").collect()] == [4]
    before = spark.createDataFrame([(3, 0.0), (4, 0.0), (5, 0.0), (6, 6.0)], "_rid long, x double")
    after = changes.apply(before, small, ["x"])
    assert sorted(tuple(r) for r in after.collect()) == [(1, 2.0), (3, 9.0), (5, 5.0), (6, 6.0)]
    again = changes.diff(before, after, ["x"])
    assert sorted((r["_rid"], r["_op"]) for r in again.collect()) == [(1, "C"), (3, "U"), (4, "D"), (5, "U")]
    delta = changes.signed(again, before, ["x"]).agg(F.sum(F.col("x") * F.col("_sign"))).first()[0]
    assert delta == 22.0 - 6.0
    assert changes.stir(before, delete=2).count() == 2 and changes.stir(before, delete="all").count() == 0 and changes.stir(before, delete=[3]).count() == 3
    assert changes.stir(before, update=([3, 4], {"x": -1.0})).agg(F.sum("x")).first()[0] == 4.0


def test_session(spark):
    v = session.Variable({"lo": 10}, translate={"low": "lo"})
    s = session.Interactive(spark)
    s.register("big", lambda: spark.range(100).filter(F.col("id") >= v["lo"]), v)
    assert len(s.collect("big")) == 90
    v.from_input({"low": 95})
    assert v["low"] == 95 and len(s.collect("big")) == 5
    s.forget("big")


def test_pipelines(spark):
    df = spark.createDataFrame([(0, 1.0, "a"), (1, 2.0, "b"), (2, 3.0, "a")], "_rid long, x double, s string")
    pipeline.operator("max")(stats.extrema)
    p = pipeline.step(lambda d, n: d.filter(F.col("x") < n), 3) | pipeline.step("max", ["x"])
    assert (df | p).first()[0] == 2.0 and p.fetch(df)[0][0] == 2.0
    assert [d.count() for d in pipeline.tee(p, p)(df)] == [1, 1]
    f = pipeline.Facade(df)
    assert f.max.first()["x"] == 3.0 and f.min.first()["x"] == 1.0
    f.configure("sample", "two", k=2)
    assert f.two.count() == 2
    f.register("rows", lambda d: stats.count(d))
    assert f.rows.first()[0] == 3
    with pytest.raises(AttributeError):
        pipeline.Facade(df).rows  # noqa: B018
    assert pipeline.last_row(df).first()["s"] == "a" and pipeline.page(df, 1, 2).first()["_rid"] == 1
    assert pipeline.paste(df, df.select("_rid", "s").withColumnRenamed("s", "t")).first().asDict() == {"x": 3.0, "t": "a"}
    one = generators.constant_dict(spark, {"a": 1, "b": 2})
    assert pipeline.merge_rows(one, generators.constant_dict(spark, {"b": 3})).first().asDict() == {"a": 1, "b": 3}
    assert [d.count() for d in pipeline.switch(df, lambda d: d.count() > 5)] == [0, 3]
    assert pipeline.expand(lambda a, b: a.unionAll(b), df, df, df).count() == 9
    assert pipeline.to_dict(df)["x"] == {0: 1.0, 1: 2.0, 2: 3.0} and pipeline.to_dict(df, "list")["s"] == ["a", "b", "a"]
    assert pipeline.to_dict(df, "split")["index"] == [0, 1, 2] and pipeline.to_dict(df, "records")[0] == {"x": 1.0, "s": "a"}
    assert pipeline.to_dict(df, "datatable")[1] == [1, 2.0, "b"] and pipeline.to_dict(df, "index")[2] == {"x": 3.0, "s": "a"}
    with pytest.raises(ValueError):
        pipeline.to_dict(df, limit=1)
