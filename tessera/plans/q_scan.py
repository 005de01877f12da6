"""Scans, writes, exchanges, projections, predicates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from tessera.functions import numbers
from tessera.operators import ordering, projections
from tessera.plans.registry import Block, Tables
from tessera.runtime import deal_by_rows, scratch_dir, ship
from tessera.sources import io
from tessera.streaming import batches

BLOCK = Block()
query = BLOCK.query


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS sum_base_price,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS sum_disc_price, avg(l_quantity) AS avg_qty, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-08-31' GROUP BY l_returnflag, l_linestatus""")
def q01_pricing_summary(t: Tables):
    """Pricing summary: filter at the scan, group, exact decimal sums, order."""
    price, kept = F.col("l_extendedprice").cast("decimal(12,2)"), F.lit(1) - F.col("l_discount").cast("decimal(4,2)")
    return (
        t.lineitem.filter(F.col("l_shipdate") <= F.lit("2001-08-31").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("l_quantity").alias("sum_qty"),
            F.sum(price).cast("double").alias("sum_base_price"),
            F.sum(price * kept).cast("double").alias("sum_disc_price"),
            F.avg("l_quantity").alias("avg_qty"),
            F.count(F.lit(1)).alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(year(o_orderdate) AS INT) AS o_year FROM orders"


def _round_trip(t: Tables, fmt: str):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").alias("o_year"))
    path = scratch_dir(t.spark)
    io.write(rows, path, fmt, partition_by=["o_orderstatus"], sort_by=["o_orderkey"])
    return io.read(t.spark, path, fmt, rows.schema, rows.columns)


@query(_ORDERS)
def scan_roundtrip_parquet(t: Tables):
    """Partitioned Parquet write, read back with the schema given."""
    return _round_trip(t, "parquet")


@query(_ORDERS)
def scan_roundtrip_orc(t: Tables):
    """Partitioned ORC write, read back with the schema given."""
    return _round_trip(t, "orc")


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 40 AND p_type = 'PROMO'")
def scan_pushdown(t: Tables):
    """Two columns and two predicates, all of them at the scan."""
    return io.read(t.spark, f"{t.sf_dir}/part.parquet", columns=["p_partkey", "p_name", "p_size", "p_type"]).filter("p_size > 40 AND p_type = 'PROMO'").select("p_partkey", "p_name")


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 100 + i, 'batch ' || CAST(i AS VARCHAR) FROM range(40) r(i)")
def scan_value_stream(t: Tables):
    """In-process Arrow batches as a source: held by the driver, and from iterators opened in the tasks."""
    ship(t.spark)
    held = t.nation.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name").toArrow()

    def open_(part: int):
        for at in range(part * 10, part * 10 + 10, 5):
            yield pa.RecordBatch.from_pydict({"n_nationkey": [100 + i for i in range(at, at + 5)], "n_name": [f"batch {i}" for i in range(at, at + 5)]})

    schema = pa.schema([("n_nationkey", pa.int64()), ("n_name", pa.string())])
    return batches.from_batches(t.spark, held.to_batches(max_chunksize=7), held.schema).union(batches.from_iterators(t.spark, open_, 4, schema))


#: Murmur3 of a 64-bit number, seed 42, in 32-bit steps
_HASH = """
WITH o AS (SELECT CAST(o_custkey AS UBIGINT) AS v FROM orders),
a AS (SELECT v, ((v % 4294967296) * 3432918353) % 4294967296 AS k, v // 4294967296 AS hi FROM o),
b AS (SELECT hi, (((k * 32768) % 4294967296 + k // 131072) * 461845907) % 4294967296 AS k FROM a),
c AS (SELECT hi, xor(CAST(42 AS UBIGINT), k) AS h FROM b),
d AS (SELECT hi, (((h * 8192) % 4294967296 + h // 524288) * 5 + 3864292196) % 4294967296 AS h FROM c),
e AS (SELECT h, (hi * 3432918353) % 4294967296 AS k FROM d),
f AS (SELECT xor(h, (((k * 32768) % 4294967296 + k // 131072) * 461845907) % 4294967296) AS h FROM e),
g AS (SELECT xor((((h * 8192) % 4294967296 + h // 524288) * 5 + 3864292196) % 4294967296, CAST(8 AS UBIGINT)) AS h FROM f),
i AS (SELECT (xor(h, h // 65536) * 2246822507) % 4294967296 AS h FROM g),
j AS (SELECT (xor(h, h // 8192) * 3266489909) % 4294967296 AS h FROM i),
m AS (SELECT xor(h, h // 65536) AS h FROM j)
SELECT CAST(h % 16 AS INT) AS partition, count(*) AS rows FROM m GROUP BY 1"""


@query(_HASH)
def partition_ids(t: Tables):
    """Rows of each partition of a hash exchange, told by expression."""
    return t.orders.select(numbers.partition_id(16, F.col("o_custkey").cast("long")).alias("partition")).groupBy("partition").agg(F.count(F.lit(1)).alias("rows"))


@query("""
WITH o AS (SELECT o_orderkey, nullif(o_custkey % 5, 0) AS k FROM orders)
SELECT CAST(sum(CASE WHEN k IS NULL THEN 4 ELSE 1 END) AS BIGINT) AS rows, CAST(count(DISTINCT o_orderkey) AS BIGINT) AS orders, true AS in_place FROM o""")
def exchange_replicates_nulls(t: Tables):
    """Rows with a null key go to every partition, others to one; each row is where its partition number says."""
    rows = t.orders.select("o_orderkey", F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("k"))
    dealt = io.deal_output(rows, 4, ["k"], replicate_nulls=True).select("o_orderkey", (F.spark_partition_id() == F.col("partition")).alias("here"))
    # Four tasks, however many orders: they pass their rows on, as each would hold a quarter of all orders to count them.
    passed = deal_by_rows(dealt, t.orders.count(), "o_orderkey")
    return passed.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("o_orderkey").alias("orders"), F.bool_and("here").alias("in_place"))


@query("""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT o_orderkey % 6) AS BIGINT) AS buckets, true AS in_place FROM orders""")
def exchange_by_bucket_map(t: Tables):
    """A bucket map over a hash that the rows bring along."""
    rows = t.orders.select("o_orderkey", (F.col("o_orderkey") % 6).alias("h"))
    dealt = io.deal_output(rows, 3, ["o_orderkey"], buckets=[2, 0, 1, 1, 0, 2], hash_column="h").withColumn("at", F.spark_partition_id())
    told = F.get(F.array(*map(F.lit, (2, 0, 1, 1, 0, 2))), F.col("h").cast("int"))
    return dealt.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("h").alias("buckets"), F.bool_and((F.col("at") == F.col("partition")) & (told == F.col("partition"))).alias("in_place"))


@query("""
SELECT o_orderkey, o_custkey = 10 AS eq, o_custkey <> 10 AS neq, o_custkey < 500 AS lt, o_custkey <= 500 AS lte, o_totalprice > 1e5 AS gt, o_totalprice >= 2e5 AS gte,
  o_orderstatus < 'P' AS str_lt, nullif(o_orderstatus, 'F') = 'O' AS with_null FROM orders""")
def pred_comparisons(t: Tables):
    """All comparisons, also with null operands."""
    k, p, s = F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey", (k == 10).alias("eq"), (k != 10).alias("neq"), (k < 500).alias("lt"), (k <= 500).alias("lte"), (p > 1e5).alias("gt"), (p >= 2e5).alias("gte"), (s < "P").alias("str_lt"),
        (F.nullif(s, F.lit("F")) == "O").alias("with_null"),
    )


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_custkey > 500 END AS a, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice > 2e5 END AS b FROM orders)
SELECT o_orderkey, a AND b AS both_, a OR b AS either, NOT a AS not_a, a AND b AND o_orderkey > 10 AS three, a IS NULL AS a_null, b IS NOT NULL AS b_there FROM o""")
def pred_logic_null(t: Tables):
    """Three-valued AND, OR and NOT, and the flattened forms."""
    o = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_custkey") > 500).alias("a"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") > 2e5).alias("b"))
    a, b = F.col("a"), F.col("b")
    return o.select(
        "o_orderkey", projections.all_of([a, b]).alias("both_"), projections.any_of([a, b]).alias("either"), (~a).alias("not_a"), projections.all_of([a, b, F.col("o_orderkey") > 10]).alias("three"),
        a.isNull().alias("a_null"), b.isNotNull().alias("b_there"),
    )


@query("""
SELECT o_orderkey, o_orderstatus IN ('O', 'P') AS in_list, nullif(o_orderstatus, 'P') IN ('O') AS in_null, o_custkey IN (1, NULL) AS list_null, o_totalprice BETWEEN 5e4 AND 1e5 AS between_,
  o_orderpriority BETWEEN '2' AND '4' AS between_str FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8, 13, 21) OR o_totalprice BETWEEN 1000 AND 30000""")
def pred_in_between(t: Tables):
    """IN and BETWEEN, also with null in the value and in the list."""
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    kept = t.orders.filter(F.col("o_custkey").isin(1, 2, 3, 5, 8, 13, 21) | p.between(1000, 30000))
    return kept.select(
        "o_orderkey", s.isin("O", "P").alias("in_list"), F.nullif(s, F.lit("P")).isin("O").alias("in_null"), F.expr("o_custkey IN (1, NULL)").alias("list_null"), p.between(5e4, 1e5).alias("between_"),
        F.col("o_orderpriority").between("2", "4").alias("between_str"),
    )


@query("""
SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS if_, CASE p_type WHEN 'PROMO' THEN 1 WHEN 'LARGE' THEN 2 ELSE 0 END AS switch_, CASE p_type WHEN 'PROMO' THEN 'p' END AS no_else,
  CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 20 THEN 'b' WHEN p_retailprice > 1000 THEN 'c' ELSE 'd' END AS searched, p_size + 1 AS plus, p_size // 4 AS int_div, p_size % 7 AS rem FROM part""")
def pred_case_if(t: Tables):
    """IF, both forms of CASE, and arithmetic, projected in one step."""
    size, kind = F.col("p_size"), F.col("p_type")
    return projections.project(
        t.part,
        None,
        p_partkey=F.col("p_partkey"),
        if_=F.when(size > 25, "big").otherwise("small"),
        switch_=projections.switch(kind, [("PROMO", 1), ("LARGE", 2)], 0),
        no_else=projections.switch(kind, [("PROMO", "p")]),
        searched=projections.searched_switch([(size < 10, "a"), (size < 20, "b"), (F.col("p_retailprice") > 1000, "c")], "d"),
        plus=size + 1,
        int_div=numbers.int_divide(size, F.lit(4)).cast("int"),
        rem=size % 7,
    )


@query("""
WITH p AS (SELECT p_partkey, nullif(p_size % 3, 0) AS a, nullif(p_type, 'PROMO') AS k FROM part)
SELECT p_partkey, coalesce(a, -1) AS coalesce_, nullif(a, 2) AS nullif_, ifnull(a, 9) AS nvl_, CASE WHEN a IS NOT NULL THEN 1 ELSE 0 END AS nvl2_, ifnull(k, 'none') AS ifnull_,
  CASE WHEN k IS NULL THEN 'null' WHEN k = 'LARGE' THEN 'l' ELSE 'else' END AS decode_, a IS NULL AS isnull_ FROM p""")
def pred_null_funcs(t: Tables):
    """COALESCE, NULLIF, NVL, NVL2, IFNULL, DECODE and null tests."""
    p = t.part.select("p_partkey", F.nullif(F.col("p_size") % 3, F.lit(0)).alias("a"), F.nullif("p_type", F.lit("PROMO")).alias("k"))
    return p.select(
        "p_partkey", F.coalesce("a", F.lit(-1)).alias("coalesce_"), F.nullif("a", F.lit(2)).alias("nullif_"), F.nvl("a", F.lit(9)).alias("nvl_"), F.nvl2("a", F.lit(1), F.lit(0)).alias("nvl2_"),
        F.ifnull("k", F.lit("none")).alias("ifnull_"), projections.decode(F.col("k"), None, "null", "LARGE", "l", "else").alias("decode_"), F.isnull("a").alias("isnull_"),
    )


@query("SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS s FROM orders ORDER BY s DESC NULLS LAST, o_custkey, o_orderkey LIMIT 100")
def sort_nulls(t: Tables):
    """Sort with the places of nulls said; the first hundred show the order."""
    rows = t.orders.select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return ordering.limit(rows.orderBy(ordering.key("s", False, False), ordering.key("o_custkey"), ordering.key("o_orderkey")), 100)


@query("SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size NULLS FIRST, p_partkey")
def sort_full(t: Tables):
    """A whole sort by expression keys."""
    return t.part.select("p_partkey", "p_name", "p_size").orderBy(ordering.key("p_size"), ordering.key("p_partkey"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 15")
def limit_offset(t: Tables):
    """Skip 15 rows, take 20."""
    return ordering.limit(t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey"), 20, 15)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 40 OFFSET 10")
def topn(t: Tables):
    """Rows 10 to 50 by price: the count includes the skipped rows."""
    return ordering.top_n(t.orders.select("o_orderkey", "o_totalprice"), [ordering.key("o_totalprice", False, False), ordering.key("o_orderkey")], 50, 10)


@query("SELECT DISTINCT p_brand, p_type FROM part ORDER BY p_brand, p_type LIMIT 25")
def distinct_limit(t: Tables):
    """The first distinct tuples."""
    return ordering.distinct_limit(t.part, ["p_brand", "p_type"], 25)
