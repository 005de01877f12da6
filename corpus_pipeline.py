"""The corpus pipeline: documents in, packed training sequences out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on
all rows its predecessor kept and returns a DataFrame, which is written as Parquet
and read again as the next one's docs.  All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_dedup, near_dup, tier_pack, toxicity_pu
from tessera.llm.rows import unwrap, wrap
from tessera.runtime import clear_scratch, configure, materialise, scratch_count, spread, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    Null and empty texts get the bias's score and stay; texts of any length are scored whole; rows
    that repeat a doc_id are scored on their own; an empty table or no labels reject nothing; columns
    beside doc_id and text, whatever their names, are carried."""
    model = toxicity_pu.train_from_labels(configure(spark), docs, table(spark, sf_dir, "labels"))
    return unwrap(toxicity_pu.score(spark, wrap(docs), model).filter(F.col("_score") < toxicity_pu.THRESHOLD), docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the new text.

    Every row stays; a null or empty text comes back empty.  Of rows that tie on the largest doc_id
    all keep the line; texts of any length are split whole; an empty table gives none; other columns,
    whatever their names, are carried."""
    done = unwrap(line_dedup.dedup_lines(configure(spark), wrap(docs)), docs.columns)
    return done.withColumn("n_chars", F.char_length("text").cast("long"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity 0.8.

    It is that of the smallest doc_id; of rows that repeat it, the one of the least text.  Rows
    without words and rows without doc_id all stay.  Texts of any length are compared whole, a
    similarity of just 0.8 links, an empty table gives none; other columns, whatever their names, are carried."""
    return unwrap(near_dup.drop_near_duplicates(configure(spark), wrap(docs), 5, 80, 100), docs.columns)


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of 13 words of a benchmark item go, however long they are, and
    those with one word in twenty inside items shorter than that.

    Null and empty texts have no words and stay, as all do with an empty benchmark; items without
    item_id count.  Texts of any length are read whole, rows that repeat are searched on their own, just
    one word in twenty is enough; other columns, whatever their names, are carried."""
    found = decontaminate.find_overlap(configure(spark), wrap(docs), table(spark, sf_dir, "benchmark"), nameless=True)
    return unwrap(found.filter(~decontaminate.leaked()), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' ids, packed: one row a piece.

    A null or empty text is its end id; rows that repeat a doc_id are documents of their own.
    Texts of any length are cut without losing an id; an empty table gives no pieces; other columns are not read."""
    return tier_pack.pack_tiers(configure(spark), docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near_duplicates),
    ("decontamination", reject_contaminated),
    ("packing", pack_sequences),
]

#: The first stage is learnt, so no SQL gives these rows; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each but the last is written and read again, and
    what a stage wrote for itself is deleted once its rows are written."""
    docs = spread(spark, table(configure(spark), sf_dir, "documents"))
    before = scratch_count(spark)
    for _, stage in STAGES[:-1]:
        docs = materialise(spark, stage(spark, docs, sf_dir))
        clear_scratch(spark, before, keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
