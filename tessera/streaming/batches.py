"""In-process batches as a source: the counterpart of a host handing over its own iterator.

There is no unbounded stream among the operators; a "stream" here is a finite
iterator of Arrow batches, one for each partition, read where the partition's task runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema


def from_iterators(spark: SparkSession, open_: Callable[[int], Iterator[pa.RecordBatch]], partitions: int, schema: pa.Schema) -> DataFrame:
    """A DataFrame of the batches that ``open_(k)`` gives for each partition k.

    The iterators are opened in the tasks and read batch by batch, so nothing passes through the driver."""
    wanted, name_ = from_arrow_schema(schema), f"batches_{uuid.uuid4().hex}"

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(k) for k in range(partitions)]

        def read(self, partition):
            for batch in open_(partition.value):
                yield batch.select(schema.names).cast(schema)

    class Batches(DataSource):
        @classmethod
        def name(cls):
            return name_

        def schema(self):
            return wanted

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Batches)
    return spark.read.format(name_).load()


def from_batches(spark: SparkSession, batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> DataFrame:
    """A DataFrame of batches that the driver already holds, typed by the given schema even if there are none."""
    return spark.createDataFrame(pa.Table.from_batches(list(batches), schema=schema))


def to_batches(df: DataFrame) -> Iterable[pa.RecordBatch]:
    """The rows as Arrow batches; for results that fit the driver."""
    yield from df.toArrow().to_batches()
