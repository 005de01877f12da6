"""Queries of this subpackage, their oracle SQL, and nothing else: thin bindings of the operators to the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, host_rules, line_dedup, near_dup, resample, secrets, tier_pack, token_pack, toxicity_pu, wrapper
from tessera.runtime import configure, spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(spark, table(configure(spark), sf_dir, "documents").select("doc_id", "text", *columns))


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document against the texts labelled good, and a sample as large as their share."""
    labels = table(configure(spark), sf_dir, "labels")
    return resample.resample(spark, _documents(spark, sf_dir), labels.filter("quality = 1").select("doc_id"), resample.good_share(labels))


def op2_nonnegative_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels outside the held-out fold."""
    docs = _documents(spark, sf_dir)
    model = toxicity_pu.train_from_labels(spark, docs, table(spark, sf_dir, "labels"))
    scored = toxicity_pu.score(spark, docs, model, carry=["doc_id"])
    return scored.select("doc_id", toxicity_pu.held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= toxicity_pu.THRESHOLD).cast("int").alias("predicted"))


def op3_prefix_filter_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of documents with benchmark items: 13-word windows, contaminated from one word in twenty."""
    docs, items = _documents(spark, sf_dir), table(spark, sf_dir, "benchmark")
    found = decontaminate.find_overlap(spark, docs, items, 13, carry=["doc_id"], nameless=True)
    names = F.concat_ws(",", F.array_sort(F.transform("_items", lambda x: x.cast("string"))))
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.col("_n_hit").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op4_randomness_battery_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: base patterns, and tokens that pass the randomness tests."""
    return secrets.report(secrets.scan(configure(spark), _documents(spark, sf_dir)))


def op5_lsh_forest_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents: 3-word shingles, similarity 0.85."""
    return near_dup.near_duplicates(spark, _documents(spark, sf_dir), 3, 85, 100)


def op6_wrapper_induction_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    done = wrapper.extract(spark, spread(spark, table(configure(spark), sf_dir, "pages").select("page_id", "url", "html")))
    return done.withColumn("n_chars", F.char_length("text").cast("long"))


def op7_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures of every document, and verdicts by document and by host (source)."""
    judged = host_rules.judge(spark, _documents(spark, sf_dir, "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_perfect_hash_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines dropped: keys of 20 code points or more in 3 documents or more."""
    docs = _documents(spark, sf_dir)
    done = line_dedup.dedup_lines(spark, docs, 20, 3)
    digest = F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), digest)


def op9_best_fit_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrix of all documents: rows of 4096 ids."""
    return token_pack.pack_matrices(spark, _documents(spark, sf_dir))


def op10_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids, none padded."""
    packed = tier_pack.pack_tiers(spark, _documents(spark, sf_dir))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


QUERIES = (
    op1_importance_resampling,
    op2_nonnegative_pu_toxicity,
    op3_prefix_filter_decontamination,
    op4_randomness_battery_secrets,
    op5_lsh_forest_near_dup,
    op6_wrapper_induction_text,
    op7_host_quality_rules,
    op8_perfect_hash_line_dedup,
    op9_best_fit_token_matrices,
    op10_tiered_packing,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


#: ``n_dup`` etc. are counted as documents (rows), so the keys are made distinct within a row first.
_OP8 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS nr FROM documents
), keyed AS (
  SELECT doc_id, nr, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), hot AS (
  SELECT key, max(doc_id) AS owner FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE h.owner IS NOT NULL AND h.owner <> k.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (WHERE h.owner IS NULL OR h.owner = k.doc_id), '')) AS kept_sha256
FROM keyed k LEFT JOIN hot h ON k.key = h.key GROUP BY k.doc_id
"""

_OP3 = r"""
WITH ws AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), windows AS (
  SELECT DISTINCT id AS item_id, least(len(w), 13) AS n, list_slice(w, s, s + least(len(w), 13) - 1) AS win
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM ws WHERE kind = 'b' AND len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), placed AS (
  SELECT id AS doc_id, s, n, list_slice(w, s, s + n - 1) AS win
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM ws, sizes WHERE kind = 'd' AND len(w) >= n)
), hits AS (SELECT p.doc_id, p.s, p.n, v.item_id FROM placed p JOIN windows v ON p.n = v.n AND p.win = v.win
), words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM ws LEFT JOIN words ON ws.id = words.doc_id LEFT JOIN items ON ws.id = items.doc_id WHERE kind = 'd'
"""

_OP7 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), win AS (
  SELECT row, i, list_slice(w, i, i + 4) AS g FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM win) WHERE c > 1
), covered AS (SELECT row, count(DISTINCT p) AS n_repeat_words FROM (SELECT row, unnest(range(i, i + 5)) AS p FROM again) GROUP BY row
), m AS (
  SELECT d.row, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN covered c ON c.row = d.row
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), k AS (
  SELECT source, count(*) AS n, rule, sum(CAST(bad AS INT)) AS k FROM (
    SELECT source, unnest(['text', 'symbols', 'lines', 'words']) AS rule,
      unnest([base_failed, 10 * n_symbols > word_chars, 10 * n_dup_lines > 3 * n_lines, word_chars < 2 * n_words OR word_chars > 20 * n_words]) AS bad FROM f WHERE source IS NOT NULL
  ) GROUP BY source, rule
), t AS (SELECT rule, sum(k) / sum(n) AS m, sum(n) AS n, count(*) AS hosts FROM k GROUP BY rule
), v AS (SELECT k.rule, any_value(m) AS m, sum(k.n * (k.k / k.n - m) ** 2) / any_value(t.n) - any_value(m * (1 - m) * hosts / t.n) AS between_ FROM k JOIN t ON k.rule = t.rule GROUP BY k.rule
), s AS (SELECT rule, m, CASE WHEN between_ > 0 THEN least(greatest(m * (1 - m) / between_ - 1, 1), 1e6) ELSE 1e6 END AS size FROM v
), rejected AS (SELECT DISTINCT source FROM k JOIN s ON k.rule = s.rule WHERE (k.k + m * size) / (k.n + size) >= 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r.source IS NULL AS kept
FROM f LEFT JOIN rejected r ON f.source = r.source
"""

_OP5 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, list_slice(w, i, i + least(len(w), 3) - 1) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)
), both_ AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, b.y FROM reach r JOIN both_ b ON r.y = b.x
), c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_lsh_forest_near_dup": _OP5, "op3_prefix_filter_decontamination": _OP3, "op7_host_quality_rules": _OP7, "op8_perfect_hash_line_dedup": _OP8}
