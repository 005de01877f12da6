"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import joins, sets
from tessera.plans.registry import Block, Tables

BLOCK = Block()
query = BLOCK.query

_INNER = "SELECT o_orderkey, c_custkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'"


def _inner(t: Tables, strategy: str | None):
    building = t.customer.filter("c_mktsegment = 'BUILDING'")
    return joins.equi_join(t.orders, building, [("o_custkey", "c_custkey")], strategy=strategy).select("o_orderkey", "c_custkey", "c_name", "o_totalprice")


@query(_INNER)
def join_inner_hash(t: Tables):
    """Shuffled hash join."""
    return _inner(t, "hash")


@query(_INNER)
def join_inner_merge(t: Tables):
    """Sort-merge join."""
    return _inner(t, "merge")


@query(_INNER)
def join_inner_auto(t: Tables):
    """The optimizer's own choice, by size."""
    return _inner(t, None)


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner_broadcast(t: Tables):
    """Broadcast of a table of fixed size."""
    return joins.equi_join(t.nation, t.region, [("n_regionkey", "r_regionkey")], strategy="broadcast").select("n_name", "r_name")


@query("""
SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 3e5) o ON c_custkey = o_custkey AND o_orderstatus = 'F'""")
def join_left(t: Tables):
    """Left outer join with a residual condition."""
    big = t.orders.filter("o_totalprice > 3e5")
    return joins.equi_join(t.customer, big, [("c_custkey", "o_custkey")], "left", F.col("o_orderstatus") == "F").select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT s_suppkey, n_nationkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def join_right(t: Tables):
    """Right outer join with a residual condition."""
    return joins.equi_join(t.supplier, t.nation, [("s_nationkey", "n_nationkey")], "right", F.col("s_acctbal") > 5000).select("s_suppkey", "n_nationkey", "n_name")


@query("SELECT c_custkey, s_suppkey, c_acctbal, s_acctbal FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 2 AND c_acctbal > s_acctbal")
def join_full(t: Tables):
    """Full outer join with a residual condition; the key of one side is an expression."""
    twice = t.supplier.withColumn("twice", F.col("s_suppkey") * 2)
    return joins.equi_join(t.customer, twice, [("c_custkey", "twice")], "full", F.col("c_acctbal") > F.col("s_acctbal")).select("c_custkey", "s_suppkey", "c_acctbal", "s_acctbal")


@query("""
SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey < 400) c LEFT JOIN orders ON c_custkey = o_custkey""")
def join_left_build_left(t: Tables):
    """Left outer join that builds the outer side and emits what is unmatched there."""
    return joins.equi_join(t.customer.filter("c_custkey < 400"), t.orders, [("c_custkey", "o_custkey")], "left", strategy="hash", build="left").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 4e5)")
def join_semi(t: Tables):
    """Left semi join on distinct keys."""
    return joins.semi_join(t.customer, t.orders.filter("o_totalprice > 4e5"), [("c_custkey", "o_custkey")]).select("c_custkey", "c_name")


@query("""
WITH c AS (SELECT nullif(c_custkey, 7) AS k, c_name FROM customer)
SELECT k, c_name FROM c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = k)""")
def join_anti(t: Tables):
    """Left anti join; rows with a null key are kept."""
    c = t.customer.select(F.nullif("c_custkey", F.lit(7)).alias("k"), "c_name")
    return joins.semi_join(c, t.orders, [("k", "o_custkey")], anti=True)


@query("""
SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_pending FROM customer""")
def join_existence(t: Tables):
    """Every row, with whether it has a match."""
    return joins.existence_join(t.customer, t.orders.filter("o_orderstatus = 'P'"), [("c_custkey", "o_custkey")], "has_pending").select("c_custkey", "has_pending")


@query("SELECT l_orderkey, l_linenumber, p_partkey, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity > p_size")
def join_filtered(t: Tables):
    """Equi join with a residual condition over both sides."""
    return joins.equi_join(t.lineitem, t.part, [("l_partkey", "p_partkey")], residual=F.col("l_quantity") > F.col("p_size")).select("l_orderkey", "l_linenumber", "p_partkey", "l_quantity")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey + 1")
def join_theta(t: Tables):
    """Theta join of fixed-size tables."""
    a, b = (t.nation.select(F.col("n_nationkey").alias(x), F.col("n_regionkey").alias(f"r{x}")) for x in "ab")
    return joins.theta_join(a, b, (F.col("a") < F.col("b")) & (F.col("ra") == F.col("rb") + 1)).select("a", "b")


@query("SELECT s_suppkey, r_regionkey FROM supplier LEFT JOIN region ON s_nationkey > 5 * r_regionkey + 18")
def join_theta_left(t: Tables):
    """Left theta join."""
    return joins.theta_join(t.supplier, t.region, F.col("s_nationkey") > 5 * F.col("r_regionkey") + 18, "left").select("s_suppkey", "r_regionkey")


@query("SELECT s_suppkey, r_regionkey FROM (SELECT * FROM supplier WHERE s_acctbal > 9000) s RIGHT JOIN region ON s_nationkey > 5 * r_regionkey + 18")
def join_theta_right(t: Tables):
    """Right theta join."""
    return joins.theta_join(t.supplier.filter("s_acctbal > 9000"), t.region, F.col("s_nationkey") > 5 * F.col("r_regionkey") + 18, "right").select("s_suppkey", "r_regionkey")


@query("SELECT n_name, r_name FROM nation, region")
def join_cross(t: Tables):
    """Cross product of two tables of fixed size."""
    return joins.theta_join(t.nation, t.region, None).select("n_name", "r_name")


@query("""
SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 4.5e5""")
def bloom_pruned_join(t: Tables):
    """A selective side; the optimizer may put a runtime Bloom filter on the large one."""
    few = t.orders.filter("o_orderpriority = '1-URGENT' AND o_totalprice > 4.5e5")
    return joins.equi_join(t.lineitem, few, [("l_orderkey", "o_orderkey")]).select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT c_nationkey AS k, 'c' AS kind FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier UNION ALL SELECT n_nationkey, 'n' FROM nation")
def union_all(t: Tables):
    """Three sources by position, repeats kept."""
    sides = [df.select(F.col(c).alias("k"), F.lit(kind).alias("kind")) for df, c, kind in ((t.customer, "c_nationkey", "c"), (t.supplier, "s_nationkey", "s"), (t.nation, "n_nationkey", "n"))]
    return sets.union_all(*sides)


def _nations(t: Tables):
    return t.customer.filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")), t.supplier.filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))


_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000", "SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000"


@query(f"{_A} UNION {_B}")
def union_distinct(t: Tables):
    return sets.union_distinct(*_nations(t))


@query(f"{_A} INTERSECT {_B}")
def intersect(t: Tables):
    return sets.intersect(*_nations(t))


@query(f"{_A} INTERSECT ALL {_B}")
def intersect_all(t: Tables):
    return sets.intersect(*_nations(t), keep_repeats=True)


@query(f"{_A} EXCEPT {_B}")
def except_distinct(t: Tables):
    return sets.except_(*_nations(t))


@query(f"{_A} EXCEPT ALL {_B}")
def except_all(t: Tables):
    return sets.except_(*_nations(t), keep_repeats=True)


@query("""
SELECT p_partkey, p_name, p_retailprice FROM part, lineitem, orders, customer
WHERE p_partkey = l_partkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND p_retailprice BETWEEN 900 AND 1400 AND p_size IN (3, 9, 14, 19, 23, 36, 45)
  AND o_orderdate BETWEEN TIMESTAMP '1998-05-25' AND TIMESTAMP '1999-07-24' AND l_quantity BETWEEN 10 AND 50 AND c_mktsegment IN ('BUILDING', 'MACHINERY')
GROUP BY p_partkey, p_name, p_retailprice ORDER BY p_partkey LIMIT 100""")
def flagship_star_join(t: Tables):
    """Four tables, IN and BETWEEN at every scan, distinct groups, the first hundred.

    Each join only asks for existence, so the fact rows are reduced to keys."""
    days = F.col("o_orderdate").between(F.lit("1998-05-25").cast("timestamp_ntz"), F.lit("1999-07-24").cast("timestamp_ntz"))
    buyers = t.customer.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")
    orders = t.orders.filter(days).select("o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    parts = t.part.filter(F.col("p_retailprice").between(900, 1400) & F.col("p_size").isin(3, 9, 14, 19, 23, 36, 45)).select("p_partkey", "p_name", "p_retailprice")
    lines = t.lineitem.filter(F.col("l_quantity").between(10, 50)).select("l_orderkey", "l_partkey")
    sold = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return parts.join(sold, F.col("p_partkey") == F.col("l_partkey"), "left_semi").distinct().orderBy("p_partkey").limit(100)
