"""Window operators: ranking, framed aggregates, and per-group limits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions.policy import SPARK, Policy
from tessera.runtime import materialise


def over(partition: Sequence[str], order: Sequence[Column] = (), rows: tuple[int, int] | None = None, values: tuple[int, int] | None = None, policy: Policy = SPARK) -> WindowSpec:
    """A window; ``rows`` frames by position, ``values`` by the order key's value, or by policy by position too."""
    spec = Window.partitionBy(*partition)
    spec = spec.orderBy(*order) if order else spec
    if values and policy.range_offsets_are_rows:
        rows = values
    if rows:
        return spec.rowsBetween(*rows)
    return spec.rangeBetween(*values) if values else spec


def group_limit(df: DataFrame, partition: Sequence[str], order: Sequence[Column], n: int, ties: bool = False) -> DataFrame:
    """The first n rows of each partition; with ties those equal to the n-th as well.

    The filter on the rank is seen by the optimizer, which cuts each group before
    the shuffle."""
    rank = (F.rank if ties else F.row_number)().over(over(partition, order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def _same(keys: Sequence[str], of: str) -> Column:
    """Equality with the columns ``of`` + key, null equal to null."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(of + k)) for k in keys), F.lit(True))


#: what frame_by_column can give: how two neighbouring blocks are merged; nulls count for nothing
_MERGES = {
    "sum": lambda a, b: F.coalesce(a + b, a, b),
    "count": lambda a, b: a + F.coalesce(b, F.lit(0)),
    "min": F.least,
    "max": F.greatest,
}
_FINAL = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def frame_by_column(df: DataFrame, partition: Sequence[str], order: Sequence[Column], value: str, before: str | None, measures: dict[str, str], after: str | None = None) -> DataFrame:
    """Aggregates over as many rows before and after the current one as columns of the row say.

    measures gives for each new column sum, count, avg, min or max.
    Aggregates of blocks of 1, 2, 4, ... rows are made by doubling in one window; a frame is
    the union of as many disjoint blocks as its length has binary digits, looked up by position
    in one equi-join.  So sums never subtract, and a row costs the logarithm of its frame.
    A frame without rows or with nulls only gives NULL, and a count of 0; a null offset gives a
    frame without rows.  ``order`` has to be total."""
    parts = sorted({part for aggregate in measures.values() for part in (("sum", "count") if aggregate == "avg" else (aggregate,))})
    back, ahead = (F.col(c) if c else F.lit(0) for c in (before, after))
    spec = over(partition, order)
    whole = over(partition)
    placed = df.withColumns({"_at": F.row_number().over(spec), "_last": F.count(F.lit(1)).over(whole)})
    low, high = F.greatest(F.lit(1), F.col("_at") - back), F.least(F.col("_last"), F.col("_at") + ahead)
    placed = placed.withColumns({"_low": low.cast("long"), "_length": F.when(back.isNotNull() & ahead.isNotNull(), F.greatest(F.lit(0), high - low + 1)).otherwise(0).cast("long")})
    longest = placed.agg(F.max("_length")).first()[0] or 0
    levels = placed
    for part in parts:
        start = F.col(value) if part != "count" else F.col(value).isNotNull().cast("long")
        levels = levels.withColumn(f"_{part}0", start)
        for j in range(1, longest.bit_length()):
            earlier = F.col(f"_{part}{j - 1}")
            levels = levels.withColumn(f"_{part}{j}", _MERGES[part](earlier, F.lead(earlier, 1 << (j - 1)).over(spec)))
    depth = max(1, longest.bit_length())
    held = levels.select(*(F.col(p).alias(f"_of_{p}") for p in partition), F.col("_at").alias("_place"), *(F.array(*(F.col(f"_{part}{j}") for j in range(depth))).alias(f"_{part}") for part in parts))
    blocks = F.expr(f"filter(transform(sequence(0, {depth - 1}), j -> named_struct('j', j, 'place', _low + shiftleft(shiftright(_length, j + 1), j + 1))), b -> (shiftright(_length, b.j) & 1) = 1)")
    wanted = placed.select(*partition, "_at", F.explode(blocks).alias("_b"))
    met = wanted.join(held, _same(partition, "_of_") & (F.col("_b.place") == F.col("_place")))
    sums = met.groupBy(*partition, "_at").agg(*(_FINAL[part](F.get(f"_{part}", F.col("_b.j"))).alias(f"_got_{part}") for part in parts))
    sums = sums.select(*(F.col(p).alias(f"_of_{p}") for p in partition), F.col("_at").alias("_place"), *(f"_got_{part}" for part in parts))
    out = placed.join(sums, _same(partition, "_of_") & (F.col("_at") == F.col("_place")), "left")
    made = {"avg": F.when(F.col("_got_count") > 0, F.col("_got_sum") / F.col("_got_count")), "count": F.coalesce(F.col("_got_count"), F.lit(0))}
    return out.select(*df.columns, *(made.get(aggregate, F.col(f"_got_{aggregate}")).alias(name) for name, aggregate in measures.items()))


def spread_rank(spark: SparkSession, df: DataFrame, partition: Sequence[str], order: Sequence[Column], name: str, ties: bool = True) -> DataFrame:
    """rank, or row_number of a total order, where a partition may hold any share of all rows.

    Rows are dealt by ranges of (partition, order), ranked within their range, and moved up by
    the number of rows of their partition in earlier ranges.  Ranges are dealt once, to a table,
    as another sample would cut them elsewhere.  Only partitions that span ranges need moving,
    two rows a range at most, so that side may be broadcast."""
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(parts, *(F.col(p).asc_nulls_first() for p in partition), *order)
    dealt = materialise(spark, dealt.withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part", *partition).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = F.coalesce(F.sum("_rows").over(over(partition, [F.col("_part")], rows=(Window.unboundedPreceding, -1))), F.lit(0))
    moves = counts.withColumn("_earlier", earlier).filter("_earlier > 0").select(F.col("_part").alias("_of__part"), *(F.col(p).alias(f"_of_{p}") for p in partition), "_earlier")
    local = (F.rank if ties else F.row_number)().over(over(["_part", *partition], order))
    out = dealt.withColumn("_local", local).join(F.broadcast(moves), _same(["_part", *partition], "_of_"), "left")
    return out.select(*df.columns, (F.col("_local") + F.coalesce("_earlier", F.lit(0))).alias(name))
