"""Quality rules judged by document and by host, in DataFrame operations only.

Each document is measured once.  Rule failures are summed by host with partial
aggregation, so a host with a third of all rows is a few partial sums; a host's
failure rate is shrunk towards a beta prior whose two parameters are fitted by
moments to all hosts, so that a small host isn't condemned by a few documents.
The rejected hosts are joined back to the documents' measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import join_small, materialise

#: shrunk failure rate from which a host is rejected
HOST_LIMIT = 0.5
WINDOW = 5
SYMBOLS = "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measure(docs: DataFrame, host: str) -> DataFrame:
    """doc_id, _host and the measures of each row's whole text.

    A window is known by a hash of 64 bits, made in three steps from the hashes of its
    words, each a pass over an array of numbers; windows are only compared inside one
    text, so a text of a million words counts a false repeat once in 10^7 such texts.
    The arrays a later step needs twice are columns of their own, so that no lambda
    evaluates an array anew for each of its elements."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.col(host).alias("_host"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    split = base.withColumns({"words": F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), ""), "lines": lines})
    counted = split.select(
        "doc_id",
        "_host",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.octet_length("text") - F.octet_length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, F.transform("words", lambda w: F.xxhash64(w))).alias("one"),
    )

    def joined(a: str, b: str, step: int) -> Column:
        """Hashes of the runs that ``a`` and, ``step`` words later, ``b`` stand for."""
        both = F.size(b) - step
        return F.zip_with(F.slice(a, F.lit(1), both), F.slice(b, F.lit(step + 1), both), lambda x, y: F.xxhash64(x, y))

    two = counted.withColumn("two", joined("one", "one", 1))
    four = two.withColumn("four", joined("two", "two", 2))
    windows = four.withColumn("windows", joined("four", "one", WINDOW - 1)).drop("one", "two", "four")
    repeats = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = windows.withColumn("placed", F.when(repeats, F.sort_array(F.expr("transform(windows, (h, i) -> struct(h, i))")))).drop("windows")
    twins = F.expr("zip_with(slice(placed, 1, size(placed) - 1), slice(placed, 2, size(placed) - 1), (a, b) -> if(a.h = b.h, array(a.i, b.i), array()))")
    at = placed.withColumn("at", F.when(F.col("placed").isNotNull(), F.sort_array(F.array_distinct(F.flatten(twins))))).drop("placed")
    steps = F.expr(f"aggregate(zip_with(slice(at, 1, size(at) - 1), slice(at, 2, size(at) - 1), (a, b) -> least({WINDOW}, b - a)), 0, (s, x) -> s + x)")
    covered = F.when(F.col("at").isNotNull() & (F.size("at") > 0), steps + WINDOW).otherwise(0)
    return at.withColumn("n_repeat_words", covered.cast("long")).drop("at")


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """Rule failures that count against the host, by name."""
    return {
        "text": base_failed(),
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "words": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
    }


def host_rates(measured: DataFrame) -> DataFrame:
    """_host, its documents and the shrunk failure rate of each rule."""
    names = list(rules())
    sums = [F.sum(failed.cast("long")).alias(f"k_{name}") for name, failed in rules().items()]
    hosts = measured.filter("_host is not null").groupBy("_host").agg(F.count(F.lit(1)).alias("n"), *sums)
    mean = {x: F.sum(f"k_{x}") / F.sum("n") for x in names}
    total = hosts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), *(mean[x].alias(f"m_{x}") for x in names)).first()
    spread = [F.sum(F.col("n") * F.pow(F.col(f"k_{x}") / F.col("n") - F.lit(total[f"m_{x}"] or 0.0), 2)).alias(f"v_{x}") for x in names]
    prior = total.asDict() | hosts.agg(*spread).first().asDict()  # one row each
    shrunk = []
    for x in names:
        m, n, groups = (prior[c] or 0.0 for c in (f"m_{x}", "n", "hosts"))
        between = (prior[f"v_{x}"] / n - m * (1 - m) * groups / n) if n else 0.0
        size = min(max(m * (1 - m) / between - 1, 1.0), 1e6) if between > 0 else 1e6
        shrunk.append(((F.col(f"k_{x}") + m * size) / (F.col("n") + size)).alias(f"rate_{x}"))
    return hosts.select("_host", "n", *shrunk)


def judge(spark: SparkSession, docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Measures and verdicts, one row for each row of ``docs`` (doc_id, text and the column ``host``).

    Returns doc_id, the measures, base_failed, host_rejected and kept.  A null text
    counts as empty: no words, so it fails.  Rows without a host have no host
    verdict.  Repeated rows count as often as they stand there.  A host whose rate is
    just ``limit`` is rejected.  Texts of any length are measured whole; an empty table
    gives none; other columns, whatever their names, are not read.
    """
    measured = materialise(spark, measure(docs, host))
    names = [f"rate_{x}" for x in rules()]
    rejected = host_rates(measured).filter(F.greatest(*names) >= limit).select("_host", F.lit(True).alias("host_rejected"))
    judged = join_small(measured, materialise(spark, rejected), "_host")
    judged = judged.withColumns({"base_failed": base_failed(), "host_rejected": F.coalesce("host_rejected", F.lit(False))})
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
