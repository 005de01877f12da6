"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts and unlabelled texts are needed.  Two linear
classifiers are trained in numpy, one on the words of a text and one on the
proper prefixes of its words, which reaches inflected and unseen forms.  Each
minimises the class-prior-corrected risk

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)])

whose second part, the risk on the negatives hidden in the unlabelled texts,
must not fall below zero; where it does, the step goes against it.  Weights are
kept non-negative, so harmless text cannot outweigh what is toxic in a long text.

Fitting uses bounded samples of rows (``positives``, ``unlabelled``), whole texts of any
length: features are counted and looked up where the texts are, so what comes to
the driver is counts of at most ``FEATURES`` features a view and a row of bits for each
text drawn.  The prior is counted over all labelled rows given, and all documents are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textkernel as tk
from tessera.runtime import materialise, ship

#: confirmed toxic texts and unlabelled texts in the fit, at most
POSITIVES, UNLABELLED = 1000, 3000
#: features of a view
FEATURES = 1024
#: least signed root of the likelihood ratio of a feature
STRENGTH = 3.6
#: where few positive texts leave fewer features than FEW, down to this
WEAK, FEW = 2.8, 6
#: words, and proper prefixes of words
VIEWS = (0, 1)
#: bytes of the prefixes of the second view
PREFIXES = (3, 4, 5, 6, 7, 8, 9)
THRESHOLD = 0.7
#: what a false alarm costs, in hits
FALSE_COST = 2.0


def features(chunk: tk.Chunk, view: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and the rows they stand in (repeats included)."""
    starts, ends = chunk.spans(tk.ALNUM)
    row = np.repeat(np.arange(chunk.rows), np.diff(chunk.per_row(starts)))
    if view == 0:
        return chunk.hashes(starts, ends, True), row
    hashes, rows = [], []
    for n in PREFIXES:
        on = np.flatnonzero(ends - starts > n)
        hashes.append(chunk.hashes(starts[on], starts[on] + n, True))
        rows.append(row[on])
    return np.concatenate(hashes), np.concatenate(rows)


@dataclass
class View:
    """A linear classifier: sorted feature hashes with weights, and a bias."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, chunk: tk.Chunk, view: int, sieve: tk.Sieve) -> np.ndarray:
        out = np.full(chunk.rows, self.bias)
        if len(self.hashes):
            found, row = features(chunk, view)
            at, which = sieve.find(found)
            pairs = np.unique(row[at] * np.int64(len(self.hashes)) + which)
            np.add.at(out, pairs // len(self.hashes), self.weights[pairs % len(self.hashes)])
        return out


@dataclass
class Model:
    views: list[View]
    #: the logit that becomes a score of THRESHOLD
    cut: float = float(np.log(THRESHOLD / (1 - THRESHOLD)))

    def logits(self, chunk: tk.Chunk, sieves: list[tk.Sieve]) -> np.ndarray:
        """The larger of the views' logits."""
        return np.stack([v.logits(chunk, k, s) for k, (v, s) in enumerate(zip(self.views, sieves, strict=True))]).max(axis=0)

    def scores(self, chunk: tk.Chunk, sieves: list[tk.Sieve]) -> np.ndarray:
        """0 to 1."""
        z = self.logits(chunk, sieves) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def distinct_features(chunk: tk.Chunk, view: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs."""
    found, row = features(chunk, view)
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    return row[fresh], found[fresh]


def _feature_rows(batches):
    """(view, feature, kind) for each distinct feature of each text of (kind, text)."""
    for batch in batches:
        kinds = batch.column(0).to_numpy()
        for chunk in tk.chunks(batch.column(1)):
            for view in VIEWS:
                row, found = distinct_features(chunk, view)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), view, np.int32)), pa.array(found.view(np.int64)), pa.array(kinds[chunk.first + row])], names=["view", "feature", "kind"])


def choose_features(texts: DataFrame, n_pos: int, n_unl: int, prior: float, most: int = FEATURES) -> list[np.ndarray]:
    """For each view the features far more frequent in positive texts than in the negatives hidden among the
    unlabelled; texts are rows (kind, text), kind 1 for positive."""
    counted = texts.mapInArrow(_feature_rows, "view int, feature long, kind int").groupBy("view", "feature").agg(F.sum("kind").alias("k"), F.sum(1 - F.col("kind")).alias("m"))
    n_p, n_u = float(max(1, n_pos)), float(max(1, n_unl))
    both = f"((k + m) / {n_p + n_u}D)"
    part = lambda c, n: f"if({c} > 0, {c} * ln({c} / {n}D / {both}), 0D)"
    counted = counted.filter(F.col("k") >= max(2.0, n_pos / 400)).withColumn("strength", F.expr(f"sqrt(greatest(2 * ({part('k', n_p)} + {part('m', n_u)}), 0D))"))  # signed root of the likelihood ratio
    negative = f"greatest(0D, least(1D, (m / {n_u}D - {prior}D * k / {n_p}D) / {1 - prior}D))"
    good = counted.filter((F.col("strength") >= WEAK) & F.expr(f"k / {n_p}D >= 4 * {negative}"))
    out = []
    for view in VIEWS:
        held = good.filter(F.col("view") == view).orderBy(F.desc("strength"), "feature").limit(most).select("feature", "strength").collect()
        kept = max(FEW, sum(r.strength >= STRENGTH for r in held))
        out.append(np.sort(np.array([r.feature for r in held[:kept]], dtype=np.int64).view(np.uint64)))
    return out


def _bit_rows(shared):
    """(kind, doc_id, bits of each view) for each text of (kind, doc_id, text): which of the views' features it holds."""

    def run(batches):
        names = shared.value
        sieves = [tk.Sieve(x) for x in names]
        for batch in batches:
            for chunk in tk.chunks(batch.column(2)):
                bits = []
                for view in VIEWS:
                    held = np.zeros((chunk.rows, len(names[view])), dtype=bool)
                    found, row = features(chunk, view)
                    at, which = sieves[view].find(found)
                    held[row[at], which] = True
                    bits.append(pa.array([np.packbits(r).tobytes() for r in held], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(chunk.first, chunk.rows) for k in (0, 1)), *bits], names=["kind", "doc_id", "one", "two"])

    return run


def fit_view(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam on the non-negative risk with the logistic loss."""
    w, b = np.zeros(x_pos.shape[1]), -2.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        w32 = w.astype(np.float32)  # the matrices are single precision
        z_pos, z_unl = x_pos @ w32 + b, x_unl @ w32 + b
        s_pos, s_unl = 1 / (1 + np.exp(-z_pos)), 1 / (1 + np.exp(-z_unl))
        negative = np.logaddexp(0, z_unl).mean() - prior * np.logaddexp(0, z_pos).mean()
        g_pos, g_unl = -prior * (1 - s_pos) / len(z_pos), np.zeros_like(z_unl)
        n_pos, n_unl = -prior * s_pos / len(z_pos), s_unl / len(z_unl)
        if negative >= 0:
            g_pos, g_unl = g_pos + n_pos, n_unl
        else:
            g_pos, g_unl = -n_pos, -n_unl
        grad = np.append(g_pos.astype(np.float32) @ x_pos + g_unl.astype(np.float32) @ x_unl + decay * w, g_pos.sum() + g_unl.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = np.maximum(w - move[:-1], 0), b - move[-1]
    return w, b


def place_cut(z_pos: np.ndarray, z_unl: np.ndarray, prior: float) -> float:
    """The logit from which a text is called toxic: where the hit rate less FALSE_COST times the
    false-alarm rate is largest, in the middle of the gap.  The false-alarm rate, too, is corrected
    by the class prior: (rate of the unlabelled - prior * hit rate) / (1 - prior).

    The risk alone puts the cut wrong where the prior is off by the luck of few labels."""
    steps = np.unique(np.concatenate([z_pos, z_unl]))
    middles = (steps[1:] + steps[:-1]) / 2
    if not len(middles):
        return float(np.log(THRESHOLD / (1 - THRESHOLD)))
    hit, all_ = (1 - np.searchsorted(np.sort(z), middles) / len(z) for z in (z_pos, z_unl))
    gain = hit - FALSE_COST * np.maximum(0, (all_ - prior * hit) / (1 - prior))
    return float(middles[np.flatnonzero(gain == gain.max())[-1]])


def train(spark: SparkSession, docs: DataFrame, toxic_ids: DataFrame, prior: float, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on the texts of ``toxic_ids`` (doc_id) and on unlabelled texts of ``docs``, both drawn among documents
    with a text by the order of a hash of the id, up to the given numbers; of rows that repeat an id the least
    text is read.  Without positive or unlabelled texts every score is the prior's."""
    ship(spark)
    prior = min(max(prior, 1e-4), 0.9)
    worded = docs.filter("doc_id is not null and octet_length(text) > 0")

    def drawn(ids: DataFrame, most: int, kind: int) -> DataFrame:
        return ids.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("kind", F.lit(kind))

    ids = worded.select("doc_id")
    chosen = materialise(spark, drawn(ids.join(toxic_ids.select("doc_id"), "doc_id", "left_semi"), positives, 1).union(drawn(ids, unlabelled, 0)))
    texts = worded.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("kind", "doc_id").agg(F.min("text").alias("text"))
    texts = materialise(spark, texts)
    n_pos, n_unl = (chosen.filter(f"kind = {kind}").count() for kind in (1, 0))
    names = choose_features(texts.select("kind", "text"), n_pos, n_unl, prior) if n_pos and n_unl else [np.zeros(0, np.uint64)] * len(VIEWS)
    base = float(np.log(prior / (1 - prior)))
    if not any(len(x) for x in names):
        return Model([View(x, np.zeros(0), base) for x in names])
    held = texts.select("kind", "doc_id", "text").mapInArrow(_bit_rows(spark.sparkContext.broadcast(names)), "kind int, doc_id long, one binary, two binary")
    rows = held.orderBy("kind", "doc_id").collect()
    views, logits = [], []
    for name, column in zip(names, ("one", "two"), strict=True):
        w, b = np.zeros(0), base
        x = [np.array([np.unpackbits(np.frombuffer(r[column], np.uint8), count=len(name)) for r in rows if r.kind == kind], dtype=np.float32).reshape(-1, len(name)) for kind in (1, 0)]
        if len(name):
            w, b = fit_view(*x, prior)
        views.append(View(name, w, b))
        logits.append([part @ w + b for part in x])
    return Model(views, place_cut(*(np.maximum(a, b) for a, b in zip(*logits, strict=True)), prior))


def score(spark: SparkSession, docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of docs (all by default) and _score, 0 to 1, from the whole text
    alone, however long.  Null and empty texts have no features and get the score of the bias;
    rows that repeat an id are scored on their own, equal texts alike; an empty table gives none."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    columns = docs.columns
    names = [c for c in columns if carry is None or c in carry]
    text_at = columns.index("text")

    def run(batches):
        sieves = [tk.Sieve(v.hashes) for v in shared.value.views]
        for batch in batches:
            out = [shared.value.scores(chunk, sieves) for chunk in tk.chunks(batch.column(text_at))]
            rows = [c for c, name in zip(batch.columns, columns, strict=True) if name in names]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*names, "_score"])

    return docs.mapInArrow(run, T.StructType([*(f for f in docs.schema.fields if f.name in names), T.StructField("_score", T.DoubleType())]))


def held_out() -> F.Column:
    """The fold that no label is learnt from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_from_labels(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Fit from a table of labels (doc_id, toxic) outside the held-out fold.

    Rows with null doc_id or null toxic are no labels; a document labelled both
    ways counts as toxic.  Unlabelled texts come from outside the fold as well."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out())
    counts = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1)), F.lit(0)).alias("k")).first()
    return train(spark, docs.filter(~held_out()), known.filter("toxic = 1"), counts.k / counts.n if counts.n else 0.0)
