"""Quality by importance resampling over hashed n-grams.

Words and word pairs are hashed into buckets, whose number grows with the square root
of the number of documents, as vocabularies do.  Two generative models, bags of
buckets, are counted: one of all target texts, one of all raw texts.  A
document's log weight is the sum of the log ratios of its buckets; with Gumbel
noise added, the documents of the largest values are a sample without
replacement by importance.  The cut for the k largest is found by radix selection
over histograms of fixed size, so neither weights nor ids meet in one place.

Both models count every document given: the target model each one whose id is a
target id, the raw model all.  The driver and each Python worker hold one 32-bit
number a bucket: 128 KB up to 2^18 documents, 64 MB at 2^34 of them; a counting
task holds two 64-bit numbers a bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkernel as tk
from tessera.runtime import join_small, materialise, ship

#: bits of a bucket number for few documents
LEAST_BITS = 15
#: beyond 2 to this power, four times the documents have twice the buckets
GROWS_FROM = 16
#: target ids that are broadcast; more of them are joined by a salted shuffle
TARGET_ROWS = 1_000_000
#: pseudo-count of a bucket
SMOOTHING = 1.0
#: bits of a step of the radix selection
STEP_BITS = 16


def bucket_bits(documents: int) -> int:
    """Bits of a bucket number for so many documents."""
    return LEAST_BITS + max(0, max(documents, 1).bit_length() - 1 - GROWS_FROM) // 2


def buckets(chunk: tk.Chunk, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the rows they stand in.

    Words are split at ASCII white space and keep case and punctuation, which tell
    quality."""
    starts, ends = chunk.spans(tk.NOT_SPACE)
    words = chunk.hashes(starts, ends, False)
    row = np.repeat(np.arange(chunk.rows), np.diff(chunk.per_row(starts)))
    pairs, at = tk.grams(words, row, 2)
    return (np.concatenate([words, pairs]) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate([row, row[at]])


def _count(bits: int):
    def run(batches):
        """Counts of a task: raw and target occurrences by bucket."""
        size = 1 << bits
        raw, target = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for batch in batches:
            wanted = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for chunk in tk.chunks(batch.column(0)):
                found, row = buckets(chunk, bits)
                np.add.at(raw, found, 1)
                np.add.at(target, found[wanted[chunk.first + row]], 1)
        at = np.flatnonzero(raw)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(raw[part]), pa.array(target[part])], names=["bucket", "raw", "target"])

    return run


def log_ratios(spark: SparkSession, docs: DataFrame, target_ids: DataFrame, bits: int) -> np.ndarray:
    """Log ratio of the target and raw models for each bucket; zeros without target texts."""
    chosen = target_ids.filter("doc_id is not null").select("doc_id").distinct().withColumn("target", F.lit(True))
    marked = join_small(docs.select("doc_id", "text"), chosen, "doc_id", limit=TARGET_ROWS).select("text", F.coalesce("target", F.lit(False)).alias("target"))
    counted = marked.mapInArrow(_count(bits), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    sums, ratios = materialise(spark, counted), np.zeros(1 << bits, dtype=np.float32)
    raw, target = sums.agg(F.sum("raw"), F.sum("target")).first()
    if not target:
        return ratios
    share = [F.log((F.col(name) + SMOOTHING) / (total + SMOOTHING * (1 << bits))) for name, total in (("target", target), ("raw", raw))]
    for batch in sums.select("bucket", (share[0] - share[1]).cast("float").alias("ratio")).toArrow().to_batches():
        ratios[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return ratios


def ordered_key(values: np.ndarray) -> np.ndarray:
    """Signed integers in the order of the numbers."""
    bits = np.asarray(values, dtype=np.float64).view(np.int64)
    return bits ^ ((bits >> np.int64(63)) & np.int64(0x7FFFFFFFFFFFFFFF))


def _weigh(shared, bits: int):
    def run(batches):
        for batch in batches:
            noise = batch.column(2).to_numpy()
            out = []
            for chunk in tk.chunks(batch.column(1)):
                found, row = buckets(chunk, bits)
                out.append(np.bincount(row, weights=shared.value[found], minlength=chunk.rows).astype(np.float64))  # whole numbers if there are no words
            weight = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(ordered_key(weight + noise))], names=["doc_id", "log_weight", "key"])

    return run


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest of the column ``key`` (long), by one histogram for each STEP_BITS bits."""
    prefix, rest = None, k
    for shift in range(64 - STEP_BITS, -1, -STEP_BITS):
        held = keys if prefix is None else keys.filter(F.shiftright("key", shift + STEP_BITS) == prefix)
        found = sorted(((r["p"], r["count"]) for r in held.groupBy(F.shiftright("key", shift).alias("p")).count().collect()), reverse=True)
        for p, count in found:
            if rest <= count:
                prefix = p
                break
            rest -= count
        else:
            return None
    return prefix


def good_share(labels: DataFrame, margin: float = 0.01) -> float:
    """The share of good texts among those labelled (quality 0 or 1), and a margin rather than lose good ones; 0.9 without labels."""
    n, good = labels.filter("quality is not null").agg(F.count(F.lit(1)), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0))).first()
    return min(1.0, good / n + margin) if n else 0.9


def resample(spark: SparkSession, docs: DataFrame, target_ids: DataFrame, keep: float = 0.9, seed: int = 1) -> DataFrame:
    """Sample the share ``keep`` of the rows of ``docs`` (doc_id, text) by importance.

    Returns doc_id, log_weight and kept, one row for each row of docs.  The noise of a
    row is a function of its doc_id and the seed, so a sample can be repeated; rows
    of one doc_id share it, and rows that tie with the last one kept are all kept.
    Null and empty texts have the weight of no evidence, 0, as all have without
    target texts; texts of any length are read whole; an empty table gives no rows;
    columns beside doc_id and text, whatever their names, are not read.
    """
    ship(spark)
    bits = bucket_bits(docs.count())
    ratios = spark.sparkContext.broadcast(log_ratios(spark, docs, target_ids, bits))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id"), F.lit(-1))), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = docs.select("doc_id", "text", (-F.log(-F.log(uniform))).alias("noise"))
    weighed = materialise(spark, rows.mapInArrow(_weigh(ratios, bits), "doc_id long, log_weight double, key long"))
    k = round(keep * weighed.count())
    least = kth_largest(weighed.select("key"), k) if k else None
    return weighed.select("doc_id", "log_weight", (F.col("key") >= F.lit(least) if least is not None else F.lit(False)).alias("kept"))
