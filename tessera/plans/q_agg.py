"""Aggregation and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import numbers
from tessera.functions.policy import HIVE
from tessera.operators import aggregates, windows
from tessera.operators.ordering import key
from tessera.plans.registry import Block, Tables

BLOCK = Block()
query = BLOCK.query


@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_linenumber AS SMALLINT)) AS BIGINT) AS sum_short, CAST(sum(l_linenumber) AS BIGINT) AS sum_int, CAST(sum(l_partkey) AS BIGINT) AS sum_long, sum(l_quantity) AS sum_double,
  avg(l_linenumber) AS avg_int, count(*) AS n, count(nullif(l_linenumber, 1)) AS n_col, min(l_linenumber) AS min_int, max(l_extendedprice) AS max_double, min(l_shipdate) AS min_ts, max(l_linestatus) AS max_str,
  min(l_discount > 0.05) AS min_bool FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def agg_basic_types(t: Tables):
    """Sum, avg, count, min and max over each kind of type."""
    return aggregates.group(
        t.lineitem, ["l_returnflag", "l_linestatus"], F.sum(F.col("l_linenumber").cast("short")).alias("sum_short"), F.sum("l_linenumber").alias("sum_int"), F.sum("l_partkey").alias("sum_long"),
        F.sum("l_quantity").alias("sum_double"), F.avg("l_linenumber").alias("avg_int"), F.count(F.lit(1)).alias("n"), F.count(F.nullif("l_linenumber", F.lit(1))).alias("n_col"),
        F.min("l_linenumber").alias("min_int"), F.max("l_extendedprice").alias("max_double"), F.min("l_shipdate").alias("min_ts"), F.max("l_linestatus").alias("max_str"), F.min(F.col("l_discount") > 0.05).alias("min_bool"),
    )


@query("SELECT count(*) AS n, sum(l_quantity) AS qty, avg(l_quantity) AS avg_qty, max(l_shipdate) AS last, sum(CASE WHEN l_quantity < 0 THEN l_quantity END) AS none FROM lineitem")
def agg_no_group(t: Tables):
    """One row out; the sum of no values is null."""
    return aggregates.group(
        t.lineitem, [], F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), F.avg("l_quantity").alias("avg_qty"), F.max("l_shipdate").alias("last"),
        F.sum(F.when(F.col("l_quantity") < 0, F.col("l_quantity"))).alias("none"),
    )


@query("""
SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS distinct_sum, count(*) AS n FROM lineitem GROUP BY l_returnflag""")
def agg_distinct(t: Tables):
    """Several distinct aggregates beside a plain one."""
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("suppliers"), F.countDistinct("l_partkey").alias("parts"), F.sum_distinct("l_linenumber").alias("distinct_sum"), F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_rows(t: Tables):
    return t.lineitem.select("l_suppkey", "l_returnflag").distinct()


@query("""
SELECT l_suppkey, sum(l_quantity) FILTER (WHERE l_discount > 0.05) AS qty, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, max(l_tax) FILTER (WHERE l_linestatus = 'X') AS none FROM lineitem GROUP BY l_suppkey""")
def agg_filter_clause(t: Tables):
    """FILTER clauses."""
    return t.lineitem.groupBy("l_suppkey").agg(
        F.expr("sum(l_quantity) FILTER (WHERE l_discount > 0.05)").alias("qty"), F.expr("count(*) FILTER (WHERE l_returnflag = 'R')").alias("returned"), F.expr("max(l_tax) FILTER (WHERE l_linestatus = 'X')").alias("none")
    )


@query("""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) = 1 AS fresh FROM lineitem)
SELECT l_suppkey, CAST(sum(CASE WHEN fresh THEN l_partkey END) AS BIGINT) AS distinct_parts, count(CASE WHEN fresh THEN 1 END) AS n_parts, sum(CASE WHEN l_linenumber = 1 THEN l_quantity END) AS first_lines FROM m GROUP BY l_suppkey""")
def agg_masked(t: Tables):
    """Aggregates under mask columns, one of them marking distinct values."""
    marked = t.lineitem.withColumn("fresh", F.row_number().over(windows.over(["l_suppkey", "l_partkey"], [key("l_orderkey"), key("l_linenumber")])) == 1)
    return marked.groupBy("l_suppkey").agg(
        aggregates.masked(F.sum, F.col("l_partkey"), F.col("fresh")).alias("distinct_parts"),
        aggregates.masked(F.count, F.lit(1), F.col("fresh")).alias("n_parts"),
        aggregates.masked(F.sum, F.col("l_quantity"), F.col("l_linenumber") == 1).alias("first_lines"),
    )


@query("""
WITH d AS (SELECT l_returnflag, CAST(l_extendedprice AS DECIMAL(12,2)) AS p FROM lineitem)
SELECT l_returnflag, CAST(sum(p) AS DOUBLE) AS total, CAST(max(p) AS DOUBLE) AS most, round(CAST(sum(p) AS DOUBLE) / count(p), 4) AS mean FROM d GROUP BY l_returnflag""")
def agg_decimal(t: Tables):
    """Exact decimal sums; the wide average keeps the digits that a double shows."""
    d = t.lineitem.select("l_returnflag", F.col("l_extendedprice").cast("decimal(12,2)").alias("p"))
    return d.groupBy("l_returnflag").agg(F.sum("p").cast("double").alias("total"), F.max("p").cast("double").alias("most"), F.round(numbers.average(F.col("p"), 12, 2, HIVE).cast("double"), 4).alias("mean"))


@query("""
SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(sum(o_orderkey) AS BIGINT) END AS try_total, avg(o_orderkey) AS try_mean FROM orders GROUP BY o_orderstatus""")
def agg_try(t: Tables):
    """try_sum gives null where it overflows; try_avg does not."""
    huge = F.when(F.col("o_orderstatus") == "F", F.lit(2**62)).otherwise(F.col("o_orderkey"))
    return t.orders.groupBy("o_orderstatus").agg(F.try_sum(huge).alias("try_total"), F.try_avg("o_orderkey").alias("try_mean"))


@query("SELECT l_suppkey, round(stddev_samp(l_quantity), 6) AS dev, stddev_samp(CASE WHEN l_linenumber = 99 THEN 1.0 END) AS none FROM lineitem GROUP BY l_suppkey")
def agg_stddev(t: Tables):
    """Sample deviation; null of fewer than two values."""
    return t.lineitem.groupBy("l_suppkey").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("dev"), F.stddev_samp(F.when(F.col("l_linenumber") == 99, 1.0)).alias("none"))


@query("""
SELECT l_suppkey, bool_and(l_quantity > 0) AS every_, bool_or(l_discount > 0.09) AS some_, bool_or(l_tax > 0.07) AS any_, CAST(count_if(l_quantity > 40) AS BIGINT) AS many FROM lineitem GROUP BY l_suppkey""")
def agg_bool(t: Tables):
    """Boolean aggregates and conditional counts."""
    return t.lineitem.groupBy("l_suppkey").agg(F.every(F.col("l_quantity") > 0).alias("every_"), F.some(F.col("l_discount") > 0.09).alias("some_"), F.expr("any(l_tax > 0.07)").alias("any_"), F.count_if(F.col("l_quantity") > 40).alias("many"))


@query("""
WITH x AS (SELECT l_returnflag, l_quantity AS y, nullif(l_linenumber, 3) AS x FROM lineitem)
SELECT l_returnflag, regr_avgx(y, x) AS avgx, regr_avgy(y, x) AS avgy FROM x GROUP BY l_returnflag""")
def agg_regr(t: Tables):
    """Regression averages over the pairs without nulls."""
    x = t.lineitem.select("l_returnflag", F.col("l_quantity").alias("y"), F.nullif("l_linenumber", F.lit(3)).alias("x"))
    return x.groupBy("l_returnflag").agg(F.regr_avgx("y", "x").alias("avgx"), F.regr_avgy("y", "x").alias("avgy"))


@query("""
SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first_key, arg_min(o_orderpriority, o_orderkey) AS first_priority,
  arg_min(o_orderstatus, o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS first_open FROM orders GROUP BY o_custkey""")
def agg_first(t: Tables):
    """First values in a total order, with and without nulls."""
    open_ = F.nullif("o_orderstatus", F.lit("F"))
    return t.orders.groupBy("o_custkey").agg(
        aggregates.first_by("o_orderkey", "o_orderkey").alias("first_key"), aggregates.first_by("o_orderpriority", "o_orderkey").alias("first_priority"), F.min_by(open_, F.when(open_.isNotNull(), F.col("o_orderkey"))).alias("first_open")
    )


_SETS = "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS grouping_id, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY "


def _measures():
    return F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n")


@query(_SETS + "ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(t: Tables):
    return aggregates.rollup(t.lineitem, ["l_returnflag", "l_linestatus"], *_measures())


@query(_SETS + "CUBE (l_returnflag, l_linestatus)")
def agg_cube(t: Tables):
    return aggregates.cube(t.lineitem, ["l_returnflag", "l_linestatus"], *_measures())


@query(_SETS + "GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus))")
def agg_grouping_sets(t: Tables):
    return aggregates.grouping_sets(t.lineitem, [["l_returnflag"], ["l_linestatus"], ["l_returnflag", "l_linestatus"]], ["l_returnflag", "l_linestatus"], *_measures())


@query("""
SELECT l_returnflag, l_suppkey, CAST(grouping(l_returnflag, l_suppkey) AS BIGINT) AS grouping_id, sum(l_quantity) AS total, count(l_quantity) AS rows, min(l_quantity) AS least, max(l_quantity) AS most,
  round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS deviation FROM lineitem GROUP BY ROLLUP (l_returnflag, l_suppkey)""")
def agg_rollup_refined(t: Tables):
    """Rollup over the groups of the finest level rather than over the rows."""
    return aggregates.rollup_refined(t.lineitem, ["l_returnflag", "l_suppkey"], "l_quantity").withColumns({c: F.round(c, 6) for c in ("mean", "deviation")})


@query("SELECT p_partkey + 5 AS k, 'a' AS kind FROM part UNION ALL SELECT p_partkey, 'b' FROM part")
def expand(t: Tables):
    """Each row once a projection."""
    return aggregates.expand(t.part, [[F.col("p_partkey") + 5, F.lit("a")], [F.col("p_partkey"), F.lit("b")]], ["k", "kind"])


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders")
def win_row_number(t: Tables):
    spec = windows.over(["o_custkey"], [key("o_orderdate", False, False), key("o_orderkey")])
    return t.orders.select("o_orderkey", F.row_number().over(spec).cast("long").alias("rn"))


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderdate) AS r FROM orders")
def win_rank(t: Tables):
    """Rank in few and large partitions, spread over all tasks."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return windows.spread_rank(t.spark, rows, ["o_orderstatus"], [key("o_orderpriority"), key("o_orderdate")], "r").select("o_orderkey", F.col("r").cast("long").alias("r"))


_ROWS = ", ".join(f"{f} OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS {a}" for f, a in (
    ("CAST(sum(CAST(o_totalprice AS DECIMAL(12,2)))", "s"), ("count(nullif(o_orderstatus, 'F'))", "c"), ("count(*)", "n"), ("min(o_totalprice)", "lo"), ("max(o_totalprice)", "hi"), ("first_value(o_orderstatus)", "f")))


@query("SELECT o_orderkey, " + _ROWS.replace("ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s", "ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS DOUBLE) AS s") + " FROM orders")
def win_agg_rows(t: Tables):
    """Aggregates over a frame of rows."""
    w = windows.over(["o_custkey"], [key("o_orderkey")], rows=(-2, 1))
    p = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", F.sum(p.cast("decimal(12,2)")).over(w).cast("double").alias("s"), F.count(F.nullif("o_orderstatus", F.lit("F"))).over(w).alias("c"), F.count(F.lit(1)).over(w).alias("n"),
        F.min(p).over(w).alias("lo"), F.max(p).over(w).alias("hi"), F.first("o_orderstatus").over(w).alias("f"),
    )


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) AS run, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near,
  round(avg(l_quantity) OVER (PARTITION BY l_suppkey), 6) AS mean FROM lineitem""")
def win_agg_range(t: Tables):
    """Aggregates over frames of values: peers count together."""
    order = [key("l_linenumber")]
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.sum("l_quantity").over(windows.over(["l_suppkey"], order)).alias("run"), F.count(F.lit(1)).over(windows.over(["l_suppkey"], order, values=(-1, 1))).alias("near"),
        F.round(F.avg("l_quantity").over(windows.over(["l_suppkey"])), 6).alias("mean"),
    )


@query("""
SELECT o_orderkey, count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, count(*) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b,
  count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c, count(*) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS d, count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS e,
  round(stddev_samp(o_totalprice) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 3) AS dev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def win_frames_all(t: Tables):
    """Each kind of frame bound."""
    lo, hi = Window.unboundedPreceding, Window.unboundedFollowing
    frames = {"a": (lo, 0), "b": (0, hi), "c": (lo, hi), "d": (-3, -1), "e": (1, 3)}
    counts = [F.count(F.lit(1)).over(windows.over(["o_custkey"], [key("o_orderkey")], rows=f)).alias(n) for n, f in frames.items()]
    dev = F.stddev_samp("o_totalprice").over(windows.over(["o_custkey"], [key("o_orderkey")], rows=(-3, 0)))
    return t.orders.select("o_orderkey", *counts, F.round(dev, 3).alias("dev"))


@query("""
SELECT o_orderkey, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 9 PRECEDING AND 8 PRECEDING) AS far FROM orders""")
def win_empty_frame(t: Tables):
    """Frames that hold no row give null."""
    return t.orders.select("o_orderkey", F.max("o_totalprice").over(windows.over(["o_custkey"], [key("o_orderkey")], rows=(-9, -8))).alias("far"))


@query("""
WITH p AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS v, o_orderkey % 4 AS back, o_orderkey % 3 AS ahead, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT a.o_orderkey, round(sum(b.v), 4) AS total, count(b.v) AS n, round(avg(b.v), 4) AS mean, min(b.v) AS least, max(b.v) AS most
FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND b.rn BETWEEN a.rn - a.back AND a.rn + a.ahead GROUP BY a.o_orderkey""")
def win_frame_by_column(t: Tables):
    """Frames whose bounds are columns of the row, over values with nulls."""
    o = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("v"), (F.col("o_orderkey") % 4).alias("back"), (F.col("o_orderkey") % 3).alias("ahead"))
    o = windows.frame_by_column(o, ["o_custkey"], [key("o_orderkey")], "v", "back", {"total": "sum", "n": "count", "mean": "avg", "least": "min", "most": "max"}, "ahead")
    return o.select("o_orderkey", F.round("total", 4).alias("total"), "n", F.round("mean", 4).alias("mean"), "least", "most")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS r FROM orders) WHERE r <= 2")
def win_group_limit_rank(t: Tables):
    return windows.group_limit(t.orders, ["o_custkey"], [key("o_orderstatus")], 2, ties=True).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def win_group_limit_row_number(t: Tables):
    return windows.group_limit(t.orders, ["o_custkey"], [key("o_totalprice", False, False), key("o_orderkey")], 3).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r <= 1")
def topn_with_ties(t: Tables):
    """Top rows of each group with all that tie with the last."""
    return windows.group_limit(t.lineitem, ["l_suppkey"], [key("l_quantity", False, False)], 1, ties=True).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT vec_id, label, len(embedding) AS dims, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings")
def win_array_passthrough(t: Tables):
    """Array columns carried through a window."""
    ranked = t.embeddings.withColumn("rn", F.row_number().over(windows.over(["label"], [key("vec_id")])).cast("long"))
    return ranked.select("vec_id", "label", F.size("embedding").cast("long").alias("dims"), "rn")


@query("""
WITH k AS (SELECT CASE l_linenumber % 3 WHEN 0 THEN CAST(0 AS DOUBLE) WHEN 1 THEN CAST('NaN' AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS k, l_quantity FROM lineitem)
SELECT isnan(k) AS nan, count(*) AS n, sum(l_quantity) AS qty FROM k GROUP BY isnan(k)""")
def agg_float_keys(t: Tables):
    """Keys of doubles: 0 and -0 are one group, NaN equals NaN."""
    third = F.col("l_linenumber") % 3
    k = F.when(third == 0, F.lit(0.0)).when(third == 1, F.lit(float("nan"))).otherwise(F.lit(-0.0))
    grouped = t.lineitem.select(k.alias("k"), "l_quantity").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))
    return grouped.select(F.isnan("k").alias("nan"), "n", "qty")
