"""Session settings, shipping of the package to executors, scratch tables and checked broadcasts."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runtime settings every query relies on.  ANSI is off because a failed cast, a
#: division by zero or an overflow is NULL or wraps in the semantics aimed at.
SETTINGS = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}

#: Rows of a small side that may be broadcast; a larger side is joined by shuffle.
BROADCAST_ROWS = 200_000

#: Rows of a task where each takes much time or memory, and the most tasks that are made to keep to it: up to 200
#: (Spark's default) a shuffle writes its rows as they come, beyond that it collects them in memory to sort them.
TASK_ROWS, TASKS = 1 << 17, 200


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; returns the session."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table as a lazy scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df``, dealt evenly over the cores where its scan has fewer partitions than there are cores (one small file);
    a scan of many partitions is left as it is, so large inputs never pay for this exchange."""
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def deal_by_rows(df: DataFrame, rows: int, *keys: str, at_least: int = 1) -> DataFrame:
    """``df``, dealt by distinct-valued ``keys`` into as many tasks as ``rows`` rows need at TASK_ROWS each, but
    ``at_least`` and at most TASKS.  For narrow rows; adaptive execution would go by their bytes, which are few."""
    return df.repartition(max(at_least, min(TASKS, -(-rows // TASK_ROWS))), *keys)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that Python tasks can
    import it whatever their working folder is."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    root = Path(__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    folder = tempfile.mkdtemp(prefix="tessera-")
    target = os.path.join(folder, "tessera_code.zip")
    Path(target).write_bytes(packed.getvalue())
    context.addPyFile(target)
    context._tessera_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a temporary
    folder of this machine only where the setting is missing, as in local tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = getattr(spark.sparkContext, "_tessera_scratch", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            base = spark.sparkContext._tessera_scratch = f"file://{tempfile.mkdtemp(prefix='tessera-scratch-')}"
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    spark.sparkContext._tessera_folders = [*getattr(spark.sparkContext, "_tessera_folders", ()), path]
    return path


def scratch_count(spark: SparkSession) -> int:
    """How many scratch tables this session has made and not deleted."""
    return len(getattr(spark.sparkContext, "_tessera_folders", ()))


def clear_scratch(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the scratch tables of this session from the ``since``-th on but for the last ``keep``, once no
    result is needed that reads them; returns how many."""
    folders = list(getattr(spark.sparkContext, "_tessera_folders", ()))
    gone = folders[since : len(folders) - keep]
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    spark.sparkContext._tessera_folders = [f for f in folders if f not in gone]
    return len(gone)


def materialise(spark: SparkSession, df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to a table in the shared scratch folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, not what came before."""
    path = scratch_dir(spark)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(big: DataFrame, small: DataFrame, key: str, how: str = "left", limit: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Join ``small`` (one row a key) to ``big``.

    The rows of ``small`` are counted up to ``limit`` first.  Within it the side is
    broadcast.  Beyond it both sides are shuffled by key and a salt, so that one
    key with a third of all rows is dealt to ``salts`` tasks; ``small`` is
    repeated once a salt, which multiplies only the small side.
    """
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), key, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # The salt follows from the row, so a task that runs again deals its rows as before.
    own = F.pmod(F.xxhash64(*[c for c in big.columns if c != key][:2]), F.lit(salts)).cast("int")
    return big.withColumn("_salt", own).join(salted, [key, "_salt"], how).drop("_salt")
