"""Scans, writes and exchanges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "csv", "json")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A scan.  With ``columns`` those that are missing are an error at once, before any task runs."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    reader = spark.read.format(fmt)
    out = (reader.schema(schema) if schema is not None else reader).load(path)
    if columns is None:
        return out
    if missing := [c for c in columns if c not in out.columns]:
        raise ValueError(f"{path} has no columns {missing}")
    return out.select(*columns)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """A write.  A partitioned write deals rows by the partition columns first, so that each
    folder gets few files; adaptive execution splits what is skewed."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.format(fmt).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def insert_into(df: DataFrame, table: str, overwrite: bool = False) -> None:
    """Append to, or replace the matching partitions of, a table of the catalog."""
    df.write.insertInto(table, overwrite=overwrite)


def deal(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """Hash exchange over n partitions; ``numbers.partition_id`` gives a row's."""
    return df.repartition(n, *keys)


def deal_output(df: DataFrame, n: int, keys: Sequence[str], replicate_nulls: bool = False, buckets: Sequence[int] | None = None, hash_column: str | None = None) -> DataFrame:
    """Exchange by the partition a row's hash names, with that number in the column ``partition``.

    Rows go to ``pmod(hash(keys), n)``, or to ``buckets[pmod(hash, len(buckets))]`` by a bucket map; a
    column may bring the hash.  With ``replicate_nulls`` rows with a null first key go to every partition.
    A row of partition p is in the p-th partition of the result."""
    value = F.col(hash_column) if hash_column else F.hash(*keys)
    one = F.pmod(value, F.lit(len(buckets) if buckets else n)).cast("int")
    one = F.get(F.array(*map(F.lit, buckets)), one) if buckets else one
    every = F.sequence(F.lit(0), F.lit(n - 1))
    targets = F.when(F.col(keys[0]).isNull(), every).otherwise(F.array(one)) if replicate_nulls else F.array(one)
    return df.withColumn("partition", F.explode(targets)).repartitionById(n, F.col("partition"))
