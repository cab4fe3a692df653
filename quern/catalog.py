"""Named queries over the TPC-H-like tables, each with SQL that returns the same rows.

Floating results are rounded in both, as the two engines add in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import dates
from quern.functions.elementwise import BINARY, UNARY, reduce_columns, zip_columns
from quern.functions.expressions import translate
from quern.operators import filters, groups, joins, linear, stats
from quern.operators.computed import UNCHANGED, Computed, if_else
from quern.operators.groups import Part
from quern.plans import pipeline
from quern.sources import readers
from quern.streaming import changes

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of (table reader, session) under its name."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda n: table(spark, sf_dir, n), spark)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def rid(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("_rid", F.col(key).cast("long"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heat of a 2-D histogram between the 3 % and 97 % quantiles of both axes."""
    t = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    q = stats.quantiles(t, ["l_quantity", "l_extendedprice"], [0.03, 0.97]).collect()
    extent = tuple((q[0][c], q[1][c]) for c in ("l_quantity", "l_extendedprice"))
    return stats.heat(stats.histogram_2d(t, "l_quantity", "l_extendedprice", 64, 64, extent=extent))


QUERIES["heatmap"] = flagship
ORACLE_SQL["heatmap"] = """
    with e as (select quantile_cont(l_quantity, 0.03) x0, quantile_cont(l_quantity, 0.97) x1, quantile_cont(l_extendedprice, 0.03) y0, quantile_cont(l_extendedprice, 0.97) y1 from lineitem),
         c as (select least(63, floor((l_quantity - x0) / ((x1 - x0) / 64)))::bigint bx, least(63, floor((l_extendedprice - y0) / ((y1 - y0) / 64)))::bigint "by"
               from lineitem, e where l_quantity between x0 and x1 and l_extendedprice between y0 and y1),
         n as (select bx, "by", count(*) n from c group by all),
         s as (select min(ln(1 + n)) lo, max(ln(1 + n)) hi from n)
    select bx, "by", n, floor((ln(1 + n) - lo) * 65535 / (hi - lo) + 0.499)::bigint heat from n, s
"""

# Sources and projections.


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_shipdate >= timestamp '1998-06-01'")
def parquet_filtered(t, spark):
    path = t("lineitem").inputFiles()
    return readers.read_parquet(spark, path, ["l_orderkey", "l_linenumber", "l_quantity"], "l_shipdate >= timestamp_ntz '1998-06-01'")


@query("select count(*) as n, count(*) filter (where o_orderstatus = 'F') as finished from orders")
def counts(t, spark):
    done = stats.count(t("orders").filter("o_orderstatus = 'F'")).withColumnRenamed("count", "finished")
    return stats.count(t("orders")).withColumnRenamed("count", "n").crossJoin(done)


@query("select o_orderkey, o_totalprice, cast(row_number() over (order by o_orderkey) - 1 as bigint) as _rid from orders")
def row_ids(t, spark):
    return readers.with_row_id(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("select c_custkey, round(c_acctbal, 2) as balance, cast(c_nationkey as double) as nation from customer")
def as_array(t, spark):
    flat = t("customer").select("c_custkey", F.round("c_acctbal", 2).alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    v = readers.finish(flat, as_array={"v": ["a", "b"]})
    return v.select("c_custkey", F.col("v")[0].alias("balance"), F.col("v")[1].alias("nation"))


@query("select p_partkey, p_size from part where p_partkey between 10 and 20")
def rows_by_id(t, spark):
    return filters.rows_at(t("part"), slice(10, 20), ["p_size"], rid="p_partkey")


@query("select o_orderkey, cast(isodow(o_orderdate) - 1 as int) as week_day_int, cast(dayofyear(o_orderdate) as int) as year_day, dayname(o_orderdate) as week_day, year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate) as ymd, isodow(o_orderdate) >= 6 as weekend from orders")
def date_parts(t, spark):
    d = "o_orderdate"
    return t("orders").select("o_orderkey", dates.week_day_int(d).alias("week_day_int"), dates.year_day_int(d).alias("year_day"), dates.week_day(d).alias("week_day"), dates.ymd_string(d).alias("ymd"), dates.is_weekend(d).alias("weekend"))


@query("select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax ** 2, 4) as net, case when l_quantity > 25 then 1 else 0 end as big, (l_quantity > 10) and not (l_tax > 0.05) as picked from lineitem")
def expression_columns(t, spark):
    e = lambda s: translate(s)[1]
    return rounded(t("lineitem").select("l_orderkey", "l_linenumber", e("l_extendedprice * (1 - l_discount) + l_tax ** 2").alias("net"), e("where(l_quantity > 25, 1, 0)").alias("big"), e("(l_quantity > 10) & ~(l_tax > 0.05)").alias("picked")))


# Filters.


@query("select l_orderkey, l_linenumber from lineitem where l_quantity > 45 and (l_discount < 0.02 or l_tax = 0.0)")
def filter_expression(t, spark):
    return filters.where(t("lineitem"), "(l_quantity > 45) & ((l_discount < 0.02) | (l_tax == 0.0))").select("l_orderkey", "l_linenumber")


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 200000")
def simple_filter(t, spark):
    return filters.compare(t("orders"), "o_totalprice", ">=", 200000).select("o_orderkey", "o_totalprice")


@query("select p_partkey, p_size from part where p_size > (select arg_max(p_size, p_partkey) from part)")
def compare_with_last(t, spark):
    p = t("part").select("p_partkey", "p_size")
    return filters.compare_last(p, p.select("p_partkey", "p_size"), ">", order="p_partkey")


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority in (select distinct o_orderpriority from orders where o_orderkey < 10)")
def categorical_query(t, spark):
    choice = t("orders").filter("o_orderkey < 10").select("o_orderpriority").distinct()
    return filters.categories(t("orders"), "o_orderpriority", choice).select("o_orderkey", "o_orderpriority")


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 100000 and o_totalprice < 150000")
def range_query(t, spark):
    return filters.range_query(t("orders"), "o_totalprice", 100000, 150000).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 100000")
def range_query_open(t, spark):
    return filters.range_query(t("orders"), "o_totalprice", 100000, 1e12).select("o_orderkey", "o_totalprice")


@query("select l_orderkey, l_linenumber from lineitem where l_quantity >= 10 and l_quantity < 20 and l_extendedprice >= 20000 and l_extendedprice < 30000")
def range_query_2d(t, spark):
    return filters.range_query_2d(t("lineitem"), "l_quantity", "l_extendedprice", (10, 20), (20000, 30000)).select("l_orderkey", "l_linenumber")


@query("with w as (select min(o_totalprice) o, (quantile_cont(o_totalprice, 0.95) - quantile_cont(o_totalprice, 0.05)) / 100 w from orders) select cast(floor((o_totalprice - o) / w) as bigint) as bin, count(*) as n, min(o_totalprice) as low, max(o_totalprice) as high from orders, w group by 1")
def binned_index(t, spark):
    return filters.bins(t("orders"), "o_totalprice")


@query("select s_suppkey, s_name from supplier where s_suppkey in (select l_suppkey from lineitem where l_quantity > 49.5)")
def select_by_ids(t, spark):
    ids = t("lineitem").filter("l_quantity > 49.5").select(F.col("l_suppkey").alias("s_suppkey"))
    return filters.select_ids(t("supplier"), ids, rid="s_suppkey").select("s_suppkey", "s_name")


# Joins and id sets.


@query("select o_orderkey, o_custkey, c_name, c_acctbal from orders join customer on o_custkey = c_custkey")
def join_inner(t, spark):
    return joins.join(t("orders"), t("customer"), primary_on="c_custkey", related_on="o_custkey", related_cols=["o_orderkey", "o_custkey"], primary_cols=["c_name", "c_acctbal"])


@query("select o_orderkey, o_custkey, coalesce(c_name, 'nobody') as c_name from orders left join (select * from customer where c_custkey % 3 <> 0) c on o_custkey = c_custkey")
def join_outer(t, spark):
    some = t("customer").filter("c_custkey % 3 <> 0")
    return joins.join(t("orders"), some, primary_on="c_custkey", related_on="o_custkey", related_cols=["o_orderkey", "o_custkey"], primary_cols=["c_name"], how="outer", fillna="nobody")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 50 = 1)")
def join_primary_outer(t, spark):
    return joins.primary_outer(t("orders").filter("o_orderkey % 50 = 1"), t("customer"), primary_on="c_custkey", related_on="o_custkey").select("c_custkey", "c_name")


@query("with d as (select year(o_orderdate) y, month(o_orderdate) m, count(*) as orders_of_month from orders group by all) select l_orderkey, l_linenumber, orders_of_month from lineitem join d on year(l_shipdate) = y and month(l_shipdate) = m")
def join_on_date_part(t, spark):
    months = t("orders").groupBy(F.date_trunc("month", F.col("o_orderdate")).cast("timestamp_ntz").alias("month")).agg(F.count(F.lit(1)).alias("orders_of_month"))
    return joins.join(t("lineitem"), months, primary_on="month", related_on="l_shipdate", related_cols=["l_orderkey", "l_linenumber"], primary_cols=["orders_of_month"], inv_mask="YM")


@query("select c.c_custkey, c.c_name, x.c_acctbal as balance from customer c left join (select * from customer where c_acctbal > 0) x on c.c_custkey = x.c_custkey")
def join_by_id(t, spark):
    c = t("customer")
    rich = c.filter("c_acctbal > 0").select("c_custkey", F.col("c_acctbal").alias("balance"))
    return joins.join_by_id(c.select("c_custkey", "c_name"), rich, rid="c_custkey")


@query("select a.p_partkey, a.p_size as p_size_x, b.p_size as p_size_y from part a join part b on a.p_partkey = b.p_partkey where a.p_size > 10 and b.p_size < 30")
def merge_by_id(t, spark):
    p = t("part").select("p_partkey", "p_size")
    return joins.merge(p.filter("p_size > 10"), p.filter("p_size < 30"), rid="p_partkey")


@query("select coalesce(a.s_suppkey, b.s_suppkey) as s_suppkey, coalesce(a.v, b.v) as v from (select s_suppkey, s_acctbal v from supplier where s_suppkey % 2 = 0) a full join (select s_suppkey, -1.0::double v from supplier where s_suppkey % 3 = 0) b on a.s_suppkey = b.s_suppkey")
def combine_first(t, spark):
    s = t("supplier")
    a = s.filter("s_suppkey % 2 = 0").select("s_suppkey", F.col("s_acctbal").alias("v"))
    return joins.combine_first(a, s.filter("s_suppkey % 3 = 0").select("s_suppkey", F.lit(-1.0).alias("v")), rid="s_suppkey")


@query("select p_partkey from part where p_size > 20 intersect select p_partkey from part where p_partkey % 3 <> 0 intersect select l_partkey from lineitem where l_quantity > 40")
def intersection(t, spark):
    p = t("part")
    hot = t("lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return joins.intersection(p.filter("p_size > 20").select("p_partkey"), p.filter("p_partkey % 3 <> 0"), hot, rid="p_partkey")


@query("select o_custkey as k, 'union' as s from (select o_custkey from orders where o_totalprice > 200000 union select c_custkey from customer where c_acctbal < 0) union all select c_custkey, 'minus' from (select c_custkey from customer where c_acctbal < 0 except select o_custkey from orders where o_totalprice > 200000) union all select k, 'xor' from ((select c_custkey k from customer where c_acctbal < 0 except select o_custkey from orders where o_totalprice > 200000) union all (select o_custkey from orders where o_totalprice > 200000 except select c_custkey from customer where c_acctbal < 0))")
def id_set_algebra(t, spark):
    a = t("orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("k")).distinct()
    b = t("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    named = lambda df, n: df.select("k", F.lit(n).alias("s"))
    return named(joins.union_ids(a, b, rid="k"), "union").unionAll(named(joins.difference(b, a, "k"), "minus")).unionAll(named(joins.symmetric_difference(a, b, "k"), "xor"))


@query("select n_nationkey as k, n_name as name from nation union all select r_regionkey, r_name from region")
def append_tables(t, spark):
    return joins.append(t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), t("region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("k")))


# Groups.


@query("select l_returnflag, l_linestatus, round(sum(l_quantity), 4) as l_quantity_sum, round(avg(l_extendedprice), 4) as l_extendedprice_mean, round(var_pop(l_discount), 4) as l_discount_variance, round(stddev_pop(l_tax), 4) as l_tax_stddev, count(*) as _count, count(distinct l_suppkey) as l_suppkey_nunique, min(l_quantity) as l_quantity_min, max(l_quantity) as l_quantity_max from lineitem group by all")
def group_aggregate(t, spark):
    wanted = [("l_quantity", "sum"), ("l_extendedprice", "mean"), ("l_discount", "variance"), ("l_tax", "stddev"), ("", "count"), ("l_suppkey", "nunique"), ("l_quantity", "min"), ("l_quantity", "max")]
    return rounded(groups.aggregate(t("lineitem"), ["l_returnflag", "l_linestatus"], wanted))


@query("select year(o_orderdate) as year, month(o_orderdate) as month, round(sum(o_totalprice), 2) as total from orders group by all")
def group_by_date_part(t, spark):
    out = groups.aggregate(t("orders"), Part("o_orderdate").dt["YM"], [("o_totalprice", "sum")])
    return rounded(out.select(F.col("o_orderdate_YM.year").cast("long").alias("year"), F.col("o_orderdate_YM.month").cast("long").alias("month"), F.col("o_totalprice_sum").alias("total")), 2)


@query("select n % 7 as by_col, count(*) as _count, round(avg(v), 4) as v_mean from (select o_orderkey n, o_totalprice v from orders) group by 1")
def group_by_function(t, spark):
    o = t("orders").select(F.col("o_orderkey").alias("n"), F.col("o_totalprice").alias("v"))
    return rounded(groups.aggregate(o, lambda: F.col("n") % 7, [("", "count"), ("v", "mean")]))


@query("select year(l_shipdate) as y, cast(l_linenumber as bigint) as line, count(*) as n from lineitem group by all")
def group_by_position(t, spark):
    v = t("lineitem").select(F.array(F.year("l_shipdate"), F.col("l_linenumber"), F.month("l_shipdate")).alias("v"), F.lit(1).alias("one"))
    out = groups.aggregate(v, Part("v").ix[0:2], [("one", "count")])
    return out.select(F.col("v_ix")[0].cast("long").alias("y"), F.col("v_ix")[1].cast("long").alias("line"), F.col("one_count").alias("n"))


@query("select a as first, b as second, round(v, 4) as value from (select 'l_quantity' a, 'l_quantity' b, var_samp(l_quantity) v from lineitem union all select 'l_extendedprice', 'l_quantity', covar_samp(l_extendedprice, l_quantity) from lineitem union all select 'l_extendedprice', 'l_extendedprice', var_samp(l_extendedprice) from lineitem)")
def covariance_matrix(t, spark):
    return rounded(groups.covariance_matrix(t("lineitem"), ["l_quantity", "l_extendedprice"]))


@query("select l_returnflag, 'l_tax' as first, 'l_discount' as second, round(corr(l_tax, l_discount), 6) as value from lineitem group by 1")
def correlation(t, spark):
    return rounded(groups.covariance_matrix(t("lineitem"), ["l_discount", "l_tax"], "corr", by=["l_returnflag"]).filter("first <> second"), 6)


# Statistics.


@query("select max(l_quantity) as l_quantity, max(l_extendedprice) as l_extendedprice, max(l_tax) as l_tax from lineitem")
def maximum(t, spark):
    return stats.extrema(t("lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], "max")


@query("select min(l_quantity) as l_quantity, min(l_extendedprice) as l_extendedprice from lineitem")
def minimum(t, spark):
    return stats.extrema(t("lineitem"), ["l_quantity", "l_extendedprice"], "min")


@query("select (select min(o_orderkey) from orders where o_totalprice = (select max(o_totalprice) from orders)) as o_totalprice_id, max(o_totalprice) as o_totalprice from orders")
def index_of_maximum(t, spark):
    return stats.index_of_extrema(t("orders"), ["o_totalprice"], "max", rid="o_orderkey")


@query("select (select min(o_orderkey) from orders where o_totalprice = (select min(o_totalprice) from orders)) as o_totalprice_id, min(o_totalprice) as o_totalprice from orders")
def index_of_minimum(t, spark):
    return stats.index_of_extrema(t("orders"), ["o_totalprice"], "min", rid="o_orderkey")


@query("select min(p_retailprice) as _p_retailprice_min, max(p_retailprice) as _p_retailprice_max from part")
def column_stats(t, spark):
    return stats.min_max(t("part"), "p_retailprice")


@query("select round(var_pop(l_quantity), 4) as l_quantity, round(var_pop(l_tax), 4) as l_tax from lineitem")
def variance(t, spark):
    return rounded(stats.variance(t("lineitem"), ["l_quantity", "l_tax"]))


@query("select 'min' as function, min(p_size)::double as p_size, round(min(p_retailprice), 4) as p_retailprice from part union all select 'max', max(p_size), round(max(p_retailprice), 4) from part union all select 'var', round(var_pop(p_size), 4), round(var_pop(p_retailprice), 4) from part")
def table_reducers(t, spark):
    return rounded(stats.reducers(t("part"), ["p_size", "p_retailprice"], ("min", "max", "var")))


@query("select (select string_agg(v, ',' order by v) from (select distinct l_returnflag v from lineitem)) as l_returnflag, true as too_many")
def distinct_values(t, spark):
    return stats.distinct(t("lineitem"), ["l_returnflag", "l_orderkey"]).select(F.array_join("l_returnflag", ",").alias("l_returnflag"), F.col("l_orderkey").isNull().alias("too_many"))


@query("with e as (select min(l_extendedprice) - (max(l_extendedprice) - min(l_extendedprice)) * 0.05 lo, max(l_extendedprice) + (max(l_extendedprice) - min(l_extendedprice)) * 0.05 hi from lineitem), c as (select least(127, floor((l_extendedprice - lo) / ((hi - lo) / 128)))::bigint as bin, count(*) n from lineitem, e group by 1) select b.bin, coalesce(n, 0) as n from (select unnest(range(128)) as bin) b left join c on b.bin = c.bin")
def histogram_1d(t, spark):
    return stats.histogram(t("lineitem"), "l_extendedprice").select("bin", "n")


@query("select l_shipmode as value, n from (select p_brand as l_shipmode, count(*) n from part group by 1)")
def histogram_categorical(t, spark):
    return stats.histogram_categorical(t("part"), "p_brand")


@query("select bx, \"by\", count(*) as n from (select least(15, floor((l_quantity - 0) / (50.0 / 16)))::bigint bx, least(15, floor((l_discount - 0) / (0.1 / 16)))::bigint \"by\" from lineitem where l_quantity between 0 and 50 and l_discount between 0 and 0.1) group by all")
def histogram_2d(t, spark):
    return stats.histogram_2d(t("lineitem"), "l_quantity", "l_discount", 16, 16, extent=((0.0, 50.0), (0.0, 0.1)))


@query("select l_returnflag, bx, \"by\", count(*) as n from (select l_returnflag, least(7, floor((l_quantity - 0) / (50.0 / 8)))::bigint bx, least(7, floor((l_discount - 0) / (0.1 / 8)))::bigint \"by\" from lineitem where l_quantity between 0 and 50 and l_discount between 0 and 0.1) group by all")
def histogram_2d_by_class(t, spark):
    return stats.histogram_2d_classes(t("lineitem"), "l_quantity", "l_discount", "l_returnflag", xbins=8, ybins=8, extent=((0.0, 50.0), (0.0, 0.1)))


@query("select unnest([0.25, 0.5, 0.9])::double as quantile, round(unnest(quantile_cont(l_extendedprice, [0.25, 0.5, 0.9])), 4) as l_extendedprice, round(unnest(quantile_cont(l_quantity, [0.25, 0.5, 0.9])), 4) as l_quantity from lineitem")
def quantiles(t, spark):
    return rounded(stats.quantiles(t("lineitem"), ["l_extendedprice", "l_quantity"], [0.25, 0.5, 0.9]))


@query()
def sketch_quantiles(t, spark):
    return stats.sketch_quantiles(stats.sketch(t("lineitem"), "l_extendedprice"), [0.25, 0.5, 0.9])


@query()
def sample(t, spark):
    return stats.sample(t("orders"), 50, key="o_orderkey")


@query("select p_partkey, coalesce(case when p_size > 10 then p_size end, (select cast(median(p_size) as double) from part where p_size > 10)) as size from part")
def imputed(t, spark):
    holes = t("part").select("p_partkey", F.when(F.col("p_size") > 10, F.col("p_size").cast("double")).alias("size"))
    return stats.imputed(holes, {"size": "median"})


@query("select o_orderkey, round((o_totalprice - (select min(o_totalprice) from orders)) / (select max(o_totalprice) - min(o_totalprice) from orders), 6) as o_totalprice from orders")
def min_max_scaled(t, spark):
    return rounded(stats.min_max_scaled(t("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]), 6)


@query("select 'p_size' as \"column\", min(p_size)::varchar as min, max(p_size)::varchar as max, count(distinct p_size) as \"distinct\" from part union all select 'p_brand', min(p_brand), max(p_brand), count(distinct p_brand) from part")
def profile(t, spark):
    return stats.profile(t("part"), ["p_size", "p_brand"], ("min", "max", "distinct"))


# Element-wise functions.

_U = ["absolute", "arctan", "arcsinh", "cbrt", "ceil", "cos", "cosh", "deg2rad", "degrees", "exp2", "floor", "isfinite", "isnan", "logical_not", "negative", "positive", "rint", "sign", "signbit", "sin", "sinh", "sqrt", "square", "tanh", "trunc", "conj", "fabs", "reciprocal", "log1p", "expm1"]
_U_SQL = {"absolute": "abs(a)", "arctan": "atan(a)", "arcsinh": "asinh(a)", "cbrt": "cbrt(a)", "ceil": "ceil(a)", "cos": "cos(a)", "cosh": "cosh(a)", "deg2rad": "radians(a)", "degrees": "degrees(a)", "exp2": "pow(2, a)", "floor": "floor(a)", "isfinite": "isfinite(a)", "isnan": "isnan(a)", "logical_not": "a = 0", "negative": "-a", "positive": "a", "rint": "round_even(a, 0)", "sign": "sign(a)::double", "signbit": "a < 0", "sin": "sin(a)", "sinh": "sinh(a)", "sqrt": "sqrt(abs(a))", "square": "a * a", "tanh": "tanh(a)", "trunc": "trunc(a)", "conj": "a", "fabs": "abs(a)", "reciprocal": "1 / a", "log1p": "ln(1 + abs(a))", "expm1": "exp(a) - 1"}
_BOOL = {"isfinite", "isnan", "logical_not", "signbit"}


@query("select l_orderkey, l_linenumber, " + ", ".join(f"{_U_SQL[u]} as {u}" if u in _BOOL else f"round({_U_SQL[u]}, 4) + 0.0 as {u}" for u in _U) + " from (select l_orderkey, l_linenumber, l_quantity / 10 - 2.55 as a from lineitem)")
def unary_functions(t, spark):
    base = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10 - 2.55).alias("a"))
    arg = lambda u: F.abs("a") if u in ("sqrt", "log1p") else F.col("a")
    return rounded(base.select("l_orderkey", "l_linenumber", *(UNARY[u](arg(u)).alias(u) for u in _U)))


@query("select l_orderkey, l_linenumber, " + ", ".join(f"round({s}, 6) + 0.0 as {n}" for n, s in (("arccos", "acos(a)"), ("arcsin", "asin(a)"), ("arctanh", "atanh(a)"), ("arccosh", "acosh(1 + a)"), ("log", "ln(a + 0.01)"), ("log2", "log2(a + 0.01)"), ("log10", "log10(a + 0.01)"), ("exp", "exp(a)"), ("tan", "tan(a)"))) + " from (select l_orderkey, l_linenumber, l_discount * 9 as a from lineitem)")
def unary_functions_bounded(t, spark):
    base = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 9).alias("a"))
    shift = {"arccosh": F.col("a") + 1, "log": F.col("a") + 0.01, "log2": F.col("a") + 0.01, "log10": F.col("a") + 0.01}
    return rounded(base.select("l_orderkey", "l_linenumber", *(UNARY[u](shift.get(u, F.col("a"))).alias(u) for u in ("arccos", "arcsin", "arctanh", "arccosh", "log", "log2", "log10", "exp", "tan"))), 6)


_B_SQL = {"add": "a + b", "arctan2": "atan2(a, b)", "divide": "a / b", "true_divide": "a / b", "floor_divide": "floor(a / b)", "fmax": "greatest(a, b)", "fmin": "least(a, b)", "fmod": "a - trunc(a / b) * b", "hypot": "sqrt(a * a + b * b)", "maximum": "greatest(a, b)", "minimum": "least(a, b)", "multiply": "a * b", "power": "pow(a, b)", "float_power": "pow(a, b)", "subtract": "a - b", "copysign": "case when b < 0 then -abs(a) else abs(a) end", "heaviside": "case when a < 0 then 0 when a = 0 then b else 1 end", "logaddexp": "ln(exp(a) + exp(b))", "ldexp": "a * pow(2, b)"}
_B_BOOL = {"equal": "a = b", "not_equal": "a <> b", "greater": "a > b", "greater_equal": "a >= b", "less": "a < b", "less_equal": "a <= b", "logical_and": "a <> 0 and b <> 0", "logical_or": "a <> 0 or b <> 0", "logical_xor": "(a <> 0) <> (b <> 0)"}
_B_IN = "(select l_orderkey, l_linenumber, l_quantity / 8 as a, l_linenumber + 0.5 as b from lineitem)"


@query("select l_orderkey, l_linenumber, " + ", ".join([f"round({s}, 4) + 0.0 as {n}" for n, s in _B_SQL.items()] + [f"{s} as {n}" for n, s in _B_BOOL.items()]) + f" from {_B_IN}")
def binary_functions(t, spark):
    base = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 8).alias("a"), (F.col("l_linenumber") + F.lit(0.5)).cast("double").alias("b"))
    return rounded(base.select("l_orderkey", "l_linenumber", *(BINARY[n](F.col("a"), F.col("b")).alias(n) for n in [*_B_SQL, *_B_BOOL])))


_I_SQL = {"bitwise_and": "a & b", "bitwise_or": "a | b", "bitwise_xor": "xor(a, b)", "gcd": "gcd(a, b)", "lcm": "lcm(a, b)", "left_shift": "a << b", "right_shift": "a >> b", "mod": "a % b", "remainder": "a % b"}


@query("select a, b, " + ", ".join(f"({s})::bigint as {n}" for n, s in _I_SQL.items()) + " from (select o_custkey as a, o_orderkey % 7 + 1 as b from orders)")
def integer_functions(t, spark):
    base = t("orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 7 + 1).alias("b"))
    return base.select("a", "b", *(BINARY[n](F.col("a"), F.col("b")).cast("long").alias(n) for n in _I_SQL))


@query("select round(l_quantity + l_discount, 4) as x, round(l_extendedprice + l_tax, 4) as y from lineitem")
def column_binary(t, spark):
    return rounded(zip_columns(t("lineitem"), "add", ["l_quantity", "l_extendedprice"], ["l_discount", "l_tax"], ["x", "y"]))


_R_SQL = {"add": "sum(x)", "hypot": "sqrt(sum(x * x))", "maximum": "max(x)", "minimum": "min(x)", "fmax": "max(x)", "fmin": "min(x)", "logaddexp": "max(x) + ln(sum(exp(x - (select max(p_size::double) from part))))", "logaddexp2": "max(x) + log2(sum(pow(2, x - (select max(p_size::double) from part))))"}


@query(" union all ".join(f"select '{n}' as function, round({s}, 4) as value from (select p_size::double as x from part)" for n, s in _R_SQL.items()))
def reductions(t, spark):
    x = t("part").select(F.col("p_size").cast("double").alias("x"))
    out = None
    for n in _R_SQL:
        one = reduce_columns(x, n, ["x"]).select(F.lit(n).alias("function"), F.col("x").cast("double").alias("value"))
        out = one if out is None else out.unionAll(one)
    return rounded(out)


_RI_SQL = {"bitwise_and": "bit_and(x)", "bitwise_or": "bit_or(x)", "bitwise_xor": "bit_xor(x)", "gcd": "list_reduce(list(x), lambda p, q: gcd(p, q))"}


@query(" union all ".join(f"select '{n}' as function, ({s})::bigint as value from (select (p_size * 6)::bigint as x from part)" for n, s in _RI_SQL.items()))
def integer_reductions(t, spark):
    x = t("part").select((F.col("p_size") * 6).cast("long").alias("x"))
    out = None
    for n in _RI_SQL:
        one = reduce_columns(x, n, ["x"]).select(F.lit(n).alias("function"), F.col("x").cast("long").alias("value"))
        out = one if out is None else out.unionAll(one)
    return out


@query("select round(list_reduce(list(n_regionkey::double + 1 order by n_nationkey), lambda a, b: a - b), 6) as subtract, round(list_reduce(list(n_regionkey::double + 1 order by n_nationkey), lambda a, b: a / b), 12) as divide from nation")
def ordered_reductions(t, spark):
    n = t("nation").select("n_nationkey", (F.col("n_regionkey").cast("double") + 1).alias("subtract"))
    a = reduce_columns(n, "subtract", ["subtract"], order="n_nationkey")
    b = reduce_columns(n.withColumnRenamed("subtract", "divide"), "divide", ["divide"], order="n_nationkey")
    return rounded(a, 6).crossJoin(rounded(b, 12))


@query("select l_orderkey, l_linenumber, round(2 * l_quantity + 0.5 * l_tax, 4) as a, round(-1 * l_quantity + 3 * l_tax, 4) as b from lineitem")
def linear_map(t, spark):
    m = spark.createDataFrame([(0, 2.0, -1.0), (1, 0.5, 3.0)], "_rid long, a double, b double")
    v = t("lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("_rid"), "l_quantity", "l_tax")
    return rounded(linear.linear_map(v, m).select("_rid.l_orderkey", "_rid.l_linenumber", "a", "b"))


@query("select c_custkey as _rid, round(c_acctbal + 2 * s_acctbal, 4) as x from customer join supplier on c_custkey = s_suppkey")
def expressions_over_tables(t, spark):
    first = t("customer").select(F.col("c_custkey").alias("_rid"), F.col("c_acctbal").alias("_2"))
    second = t("supplier").select(F.col("s_suppkey").alias("_rid"), F.col("s_acctbal").alias("_3"))
    return rounded(linear.expressions({"first": first, "second": second}, {"x": "first._2 + 2 * second._3"}))


@query()
def principal_components(t, spark):
    return rounded(linear.project(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax"), ["l_quantity", "l_extendedprice", "l_tax"], 2))


@query()
def k_means(t, spark):
    out, _ = linear.k_means(t("supplier").select("s_suppkey", F.col("s_acctbal"), F.col("s_nationkey").cast("double").alias("nation")), ["s_acctbal", "nation"], 3, rounds=20)
    return out


# Small tables and change logs.


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 10 offset 20")
def page(t, spark):
    return pipeline.page(t("orders").select("o_orderkey", "o_totalprice"), 20, 30, order="o_orderkey")


@query("select * from supplier where s_suppkey = (select max(s_suppkey) from supplier)")
def last_row(t, spark):
    return pipeline.last_row(t("supplier"), order="s_suppkey")


@query("with log as (select event_id % 100 as _rid, case when event_id % 17 = 0 then 'D' when event_id < 100 then 'C' else 'U' end as _op, event_id as _run, value from events), f as (select _rid, arg_min(_op, _run) fo, arg_max(_op, _run) lo, max(_run) _run, arg_max(value, _run) as value from log group by 1) select _rid, case when fo = 'C' then 'C' when lo = 'D' then 'D' else 'U' end as _op, _run, value from f where not (fo = 'C' and lo = 'D')")
def compacted_changes(t, spark):
    op = F.when(F.col("event_id") % 17 == 0, "D").when(F.col("event_id") < 100, "C").otherwise("U")
    log = t("events").select((F.col("event_id") % 100).alias("_rid"), op.alias("_op"), F.col("event_id").alias("_run"), "value")
    return changes.compact(log, ["value"])


# Functions at the edges of their ranges, and those that the queries above leave out.

_EDGES = "(0.0::double), (-0.0::double), ('inf'::double), ('-inf'::double), ('nan'::double), (2.5::double), (-2.5::double), (1e300::double), (-1e300::double)"
_E_SQL = {"signbit": "signbit(a)", "isinf": "isinf(a)", "isnan": "isnan(a)", "isfinite": "isfinite(a)", "isnat": "a is null", "logical_not": "a = 0"}
_EW_SQL = {"ceil": "ceil(a)", "floor": "floor(a)", "trunc": "trunc(a)", "rint": "round_even(a, 0)", "abs": "abs(a)", "negative": "-a", "conjugate": "a", "reciprocal": "case when a = 0 then case when signbit(a) then '-inf'::double else 'inf'::double end else 1 / a end", "square": "a * a"}
_shown = lambda sql: f"case when isnan({sql}) then 'nan' when isinf({sql}) then case when {sql} > 0 then 'inf' else '-inf' end else format('{{:.6e}}', {sql} + 0.0) end"


def _edges(t):
    """The edge values as doubles, each with its place."""
    cells = ["0.0", "-0.0", "Infinity", "-Infinity", "NaN", "2.5", "-2.5", "1e300", "-1e300"]
    return t("region").limit(1).select(F.posexplode(F.array(*(F.lit(c).cast("double") for c in cells))).alias("place", "a"))


def _text(c):
    """A double as text that both engines write alike."""
    return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(F.format_string("%.6e", c + F.lit(0.0)))


@query("select cast(place as int) as place, " + ", ".join([f"{s} as {n}" for n, s in _E_SQL.items()] + [f"{_shown('(' + s + ')')} as {n}" for n, s in _EW_SQL.items()]) + f" from (select (row_number() over ()) - 1 as place, a from (values {_EDGES}) v(a))")
def unary_functions_at_edges(t, spark):
    return _edges(t).select("place", *(UNARY[n](F.col("a")).alias(n) for n in _E_SQL), *(_text(UNARY[n](F.col("a"))).alias(n) for n in _EW_SQL))


@query(f"select cast(p.place as int) as p, cast(q.place as int) as q, case when signbit(q.a) then {_shown('(-abs(p.a))')} else {_shown('(abs(p.a))')} end as copysign, p.a = q.a and not isnan(p.a) as equal from (select row_number() over () - 1 as place, a from (values {_EDGES}) v(a)) p, (select row_number() over () - 1 as place, a from (values {_EDGES}) v(a)) q")
def binary_functions_at_edges(t, spark):
    p = _edges(t).select(F.col("place").alias("p"), F.col("a"))
    q = _edges(t).select(F.col("place").alias("q"), F.col("a").alias("b"))
    both = p.crossJoin(F.broadcast(q))
    return both.select("p", "q", _text(BINARY["copysign"](F.col("a"), F.col("b"))).alias("copysign"), BINARY["equal"](F.col("a"), F.col("b")).alias("equal"))


@query("select o_orderkey, ~o_orderkey as bitwise_not, ~o_orderkey as invert, round(radians(o_totalprice), 6) as radians, round(degrees(o_totalprice), 4) as rad2deg, round(o_totalprice - trunc(o_totalprice), 6) + 0.0 as fraction, trunc(o_totalprice) as whole, o_totalprice / pow(2, floor(log2(o_totalprice)) + 1) as mantissa, (floor(log2(o_totalprice)) + 1)::int as exponent, pow(2, floor(log2(o_totalprice)) - 52) as spacing, o_totalprice + pow(2, floor(log2(o_totalprice)) - 52) as nextafter, floor(o_totalprice / 7) as quotient, round(o_totalprice - floor(o_totalprice / 7) * 7, 4) as remainder, round(o_totalprice / 1e4 + log2(1 + pow(2, 1 - o_totalprice / 1e4)), 6) as logaddexp2 from orders where o_totalprice > 10000")
def functions_of_parts(t, spark):
    a, k = F.col("o_totalprice"), F.col("o_orderkey")
    rows = t("orders").filter("o_totalprice > 10000")
    modf, frexp, divmod_ = UNARY["modf"](a), UNARY["frexp"](a), BINARY["divmod"](a, F.lit(7.0))
    return rows.select(
        k, UNARY["bitwise_not"](k).alias("bitwise_not"), UNARY["invert"](k).alias("invert"), F.round(UNARY["radians"](a), 6).alias("radians"), F.round(UNARY["rad2deg"](a), 4).alias("rad2deg"),
        (F.round(modf["fraction"], 6) + F.lit(0.0)).alias("fraction"), modf["whole"].alias("whole"), frexp["mantissa"].alias("mantissa"), frexp["exponent"].alias("exponent"),
        UNARY["spacing"](a).alias("spacing"), BINARY["nextafter"](a, F.lit(float("inf"))).alias("nextafter"), divmod_["quotient"].alias("quotient"), F.round(divmod_["remainder"], 4).alias("remainder"),
        F.round(BINARY["logaddexp2"](a / 1e4, F.lit(1.0)), 6).alias("logaddexp2"),
    )


_C_SQL = {**{n: f"sum({s})" for n, s in _B_SQL.items()}, **{n: f"count(*) filter (where {s})::double" for n, s in _B_BOOL.items()}, **{n: f"sum({s.replace('a', 'i').replace('b', 'j') if n not in ('gcd', 'lcm', 'bitwise_xor') else {'gcd': 'gcd(i, j)', 'lcm': 'lcm(i, j)', 'bitwise_xor': 'xor(i, j)'}[n]})::double" for n, s in _I_SQL.items()}}


@query(" union all ".join(f"select '{n}' as function, round({s}, 2) + 0.0 as total from (select p_size / 8 as a, p_partkey % 5 + 0.5::double as b, p_size::bigint as i, (p_partkey % 5 + 1)::bigint as j from part)" for n, s in _C_SQL.items()))
def column_binary_functions(t, spark):
    """Every function of two arguments over two columns of one table, summed up."""
    k = F.col("p_partkey") % 5
    x = t("part").select((F.col("p_size") / 8).alias("a"), (k + F.lit(0.5)).cast("double").alias("b"), F.col("p_size").cast("long").alias("i"), (k + 1).cast("long").alias("j"))
    out = None
    for n in _C_SQL:
        pair = ("i", "j") if n in _I_SQL else ("a", "b")
        one = zip_columns(x, n, [pair[0]], [pair[1]], ["v"]).agg(F.lit(n).alias("function"), F.round(F.sum(F.col("v").cast("double")), 2).alias("total"))
        out = one if out is None else out.unionAll(one)
    return out


_FOLDS = {"subtract": "a - b", "divide": "a / b", "true_divide": "a / b", "floor_divide": "floor(a / b)", "power": "pow(a, b)", "float_power": "pow(a, b)", "arctan2": "atan2(a, b)", "copysign": "abs(a)", "fmod": "a - trunc(a / b) * b", "mod": "a - floor(a / b) * b", "remainder": "a - floor(a / b) * b", "heaviside": "case when a < 0 then 0 when a = 0 then b else 1 end", "ldexp": "a * pow(2, b)", "equal": "(a = b)::int::double", "not_equal": "(a <> b)::int::double", "greater": "(a > b)::int::double", "greater_equal": "(a >= b)::int::double", "less": "(a < b)::int::double", "less_equal": "(a <= b)::int::double"}


@query(" union all ".join(f"select '{n}' as function, round(list_reduce(list(v order by r_regionkey), lambda a, b: {s}), 6) + 0.0 as value from (select r_regionkey, 1.25::double + r_regionkey / 8 as v from region)" for n, s in _FOLDS.items()))
def ordered_folds(t, spark):
    x = t("region").select("r_regionkey", (F.lit(1.25) + F.col("r_regionkey") / 8).alias("v"))
    out = None
    for n in _FOLDS:
        one = reduce_columns(x, n, ["v"], order="r_regionkey").select(F.lit(n).alias("function"), F.round(F.col("v"), 6).alias("value"))
        out = one if out is None else out.unionAll(one)
    return out


@query("select 'logical_and' as function, bool_and(p_size <> 0) as value from part union all select 'logical_or', bool_or(p_size <> 0) from part union all select 'logical_xor', count(*) filter (where p_size <> 0) % 2 = 1 from part")
def logical_reductions(t, spark):
    out = None
    for n in ("logical_and", "logical_or", "logical_xor"):
        one = reduce_columns(t("part").select("p_size"), n, ["p_size"]).select(F.lit(n).alias("function"), F.col("p_size").alias("value"))
        out = one if out is None else out.unionAll(one)
    return out


@query("select p_partkey, case when p_size > 25 then 25 else p_size end as capped, sqrt(p_size) as root, p_size + 2 * p_partkey as mixed, case when p_retailprice > 905 then 'dear' else 'cheap' end as kind from part")
def computed_columns(t, spark):
    made = Computed()
    made.add_function("capped", if_else(">", 25, 25, UNCHANGED), "p_size")
    made.add_function("root", "sqrt", "p_size")
    made.add_expression("mixed", "p_size + 2 * p_partkey")
    made.add_function("kind", if_else(">", 905, "dear", "cheap"), "p_retailprice")
    return made.repeat(t("part")).select("p_partkey", "capped", "root", "mixed", "kind")


@query("select p_partkey, p_size from part where p_size > 20 and p_size * 2 < 90")
def evaluated(t, spark):
    return filters.evaluate(t("part").select("p_partkey", "p_size"), "(p_size > 20) & (p_size * 2 < 90)")


@query("select x.id as p_partkey from range(1, 500) x(id) where x.id not in (select p_partkey from part where p_size > 20) union all select p_partkey from part where p_size > 20 and (p_partkey >= 500 or p_partkey < 1)")
def flipped_ids(t, spark):
    return joins.flip(t("part").filter("p_size > 20").select(F.col("p_partkey").cast("long").alias("p_partkey")), 1, 500, rid="p_partkey")
