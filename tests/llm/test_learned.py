import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import resample, toxicity_pu
from tessera.llm import textkernel as tk
from tests.llm.helpers import alnum_words, corpus, frame


def prose(rng, n):
    return " ".join(rng.choice("the of and to in is that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which".split()) for _ in range(n))


def toxic_rows(n=600, seed=1):
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        words = prose(rng, rng.randint(5, 80)).split()
        bad = rng.random() < 0.15
        for _ in range(rng.randint(2, 4) if bad else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["Grobian", "lumpen", "schuftix", "Schuftou", "schuften"]))
        rows.append((i, " ".join(words)))
        if rng.random() < 0.6:
            labels.append((i, int(bad)))
    return rows, labels


def test_held_out_toxicity(spark):
    rows, labels = toxic_rows()
    docs = frame(spark, [*rows, (9000, None), (9001, ""), (None, "grobian lumpen")])
    held = spark.createDataFrame([*((i, t, 9) for i, t in labels), (None, 1, 9), (5, None, 9)], "doc_id long, toxic int, extra int")
    model = toxicity_pu.train_from_labels(spark, docs, held)
    scores = {r.doc_id: r._score for r in toxicity_pu.score(spark, docs, model, ["doc_id"]).collect()}
    assert len(scores) == len(rows) + 3 and all(0 <= s <= 1 for s in scores.values())
    test = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [(scores[i] >= toxicity_pu.THRESHOLD) == bool(t) for i, t in test]
    assert np.mean(right) > 0.97
    assert scores[9000] == scores[9001] < toxicity_pu.THRESHOLD <= scores[None]


def test_held_out_labels_are_not_learnt_from(spark):
    rows, labels = toxic_rows()
    docs = frame(spark, rows, clashes=False)
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    models = [toxicity_pu.train_from_labels(spark, docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped)]
    for a, b in zip(models[0].views, models[1].views, strict=True):
        assert (a.hashes == b.hashes).all() and (a.weights == b.weights).all() and a.bias == b.bias


def test_harmless_text_does_not_hide_toxic_words(spark):
    rows, labels = toxic_rows()
    docs = frame(spark, rows, clashes=False)
    model = toxicity_pu.train_from_labels(spark, docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rng = random.Random(2)
    texts = frame(spark, [(1, "grobian lumpen"), (2, prose(rng, 30_000) + " grobian lumpen"), (3, prose(rng, 30_000))], clashes=False)
    scores = {r.doc_id: r._score for r in toxicity_pu.score(spark, texts, model).collect()}
    assert scores[2] >= scores[1] > 0.9 and scores[3] < toxicity_pu.THRESHOLD


def plain_features(text, view):
    words = [w.encode() for w in alnum_words(text)]
    return set(words) if view == 0 else {w[:k] for w in words for k in toxicity_pu.PREFIXES if len(w) > k}


def hash_of(feature):
    (chunk,) = tk.chunks(pa.array([feature], pa.binary()))
    return int(chunk.hashes(np.array([0]), np.array([len(feature)]), True)[0])


def test_features_matrices_and_scores_equal_plain_python(spark):
    """Features chosen and scores given, by sets of words; toxic texts beyond 64 KiB teach as well."""
    rows, labels = toxic_rows(300, 5)
    rng = random.Random(6)
    rows = [(i, t + " " + prose(rng, 20_000) if i % 50 == 0 else t) for i, t in rows] + [(7, "the of"), (8000, None), (8001, "")]
    known = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    docs = frame(spark, rows)
    model = toxicity_pu.train_from_labels(spark, docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    least = {}
    for i, t in rows:
        if t and zlib.crc32(str(i).encode()) % 3 != 1:
            least[i] = min(t, least.get(i, t))
    positive = [least[i] for i, t in known if t and i in least]
    unlabelled = list(least.values())
    prior = sum(t for _, t in known) / len(known)
    for view in toxicity_pu.VIEWS:
        in_pos, in_unl = (Counter(f for t in texts for f in plain_features(t, view)) for texts in (positive, unlabelled))
        strength = {}
        for f, k in in_pos.items():
            m, p, u = in_unl[f], k / len(positive), in_unl[f] / len(unlabelled)
            both = (k + m) / (len(positive) + len(unlabelled))
            g = 2 * (k * np.log(p / both) + (m * np.log(u / both) if m else 0))
            if k >= max(2, len(positive) / 400) and max(g, 0) ** 0.5 >= toxicity_pu.WEAK and p >= 4 * min(1, max(0, (u - prior * p) / (1 - prior))):
                strength[f] = max(g, 0) ** 0.5
        strong = [f for f, g in strength.items() if g >= toxicity_pu.STRENGTH]
        want = strong if len(strong) >= toxicity_pu.FEW else strength
        assert set(model.views[view].hashes.tolist()) >= {hash_of(f) for f in strong} and set(model.views[view].hashes.tolist()) <= {hash_of(f) for f in want}
        assert len(model.views[view].hashes) >= 2
    offset = -model.cut + np.log(toxicity_pu.THRESHOLD / (1 - toxicity_pu.THRESHOLD))
    weights = [dict(zip(v.hashes.tolist(), v.weights.tolist(), strict=True)) for v in model.views]
    hashed: dict = {}
    for r in toxicity_pu.score(spark, docs, model, ["text"]).collect():
        z = max(v.bias + sum(w.get(hashed.setdefault(f, hash_of(f)), 0) for f in plain_features(r.text, k)) for k, (v, w) in enumerate(zip(model.views, weights, strict=True)))
        assert np.isclose(r._score, 1 / (1 + np.exp(-np.clip(z + offset, -30, 30))))


def test_no_labels(spark):
    docs = frame(spark, corpus()[:5])
    model = toxicity_pu.train_from_labels(spark, docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r._score >= 0.7 for r in toxicity_pu.score(spark, docs, model, ["doc_id"]).collect()} == {False}


M64 = (1 << 64) - 1


def mixed(x):
    """The 64-bit finaliser in plain integers."""
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & M64
    return x ^ x >> 31


def word_hash(word, known={}):  # noqa: B006
    if word not in known:
        (chunk,) = tk.chunks(pa.array([word], pa.string()))
        known[word] = int(chunk.hashes(np.array([0]), np.array([len(word.encode())]), False)[0])
    return known[word]


def brute_weights(rows, targets, bits):
    """Log weights by counting word and word-pair buckets one by one, with plain splitting and integers."""
    per_row = []
    for _, text in rows:
        words = [word_hash(w) for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
        pairs = [mixed((a * 0xA0761D6478BD642F + b) & M64) for a, b in zip(words, words[1:], strict=False)]
        per_row.append([h >> (64 - bits) for h in words + pairs])
    raw = Counter(b for found in per_row for b in found)
    target = Counter(b for (i, _), found in zip(rows, per_row, strict=True) if i in targets for b in found)
    logs = [{b: np.log((x[b] + 1) / (x.total() + (1 << bits))) for b in raw} for x in (target, raw)]
    return [sum(logs[0][b] - logs[1][b] for b in found) for found in per_row]


def test_weights_and_sample(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 40)) for i in range(80)] + [(100 + i, " ".join(f"{rng.randint(0, 30)}#!" for _ in range(40))) for i in range(20)] + [(200, None), (201, ""), (7, "the of"), (None, "and to")]
    targets = set(range(60))
    ids = spark.createDataFrame([(i, 1) for i in targets] + [(None, 1)], "doc_id long, kept int")
    out = resample.resample(spark, frame(spark, rows), ids, 0.8).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((r.doc_id, r.log_weight) for r in out), key=key)
    want = sorted(zip([i for i, _ in rows], brute_weights(rows, targets, resample.LEAST_BITS), strict=True), key=key)
    assert np.allclose([w for _, w in got], [w for _, w in want], atol=1e-4)
    assert sum(r.kept for r in out) == round(0.8 * len(rows))
    assert not any(r.kept for r in out if r.doc_id and 100 <= r.doc_id < 120)


def test_models_grow_with_the_documents(spark, monkeypatch):
    """More documents have more buckets, and more target ids than are broadcast all count."""
    assert [resample.bucket_bits(n) for n in (0, 1 << 16, (1 << 18) - 1, 1 << 18, 1 << 36)] == [15, 15, 15, 16, 25]
    rng = random.Random(4)
    rows = [(i, prose(rng, 20)) for i in range(60)] + [(None, "and"), (3, "the of")]
    targets = set(range(0, 60, 2))
    ids = spark.createDataFrame([(i,) for i in targets], "doc_id long")
    monkeypatch.setattr(resample, "TARGET_ROWS", 5)
    monkeypatch.setattr(resample, "GROWS_FROM", 0)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((r.doc_id, r.log_weight) for r in resample.resample(spark, frame(spark, rows), ids).collect()), key=key)
    want = sorted(zip([i for i, _ in rows], brute_weights(rows, targets, resample.bucket_bits(len(rows))), strict=True), key=key)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([w for _, w in got], [w for _, w in want], atol=1e-4)


def test_sampling_follows_the_weights(spark):
    """Equal weights: every row is as likely; noise comes from the id, so a seed repeats itself."""
    docs = frame(spark, [(i, "") for i in range(400)], clashes=False)
    none = spark.createDataFrame([], "doc_id long")
    samples = [{r.doc_id for r in resample.resample(spark, docs, none, 0.5, seed).collect() if r.kept} for seed in (1, 1, 2)]
    assert samples[0] == samples[1] != samples[2] and all(len(s) == 200 for s in samples)
    assert 60 < len(samples[0] & samples[2]) < 140


def test_good_share(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 1), (5, None)], "doc_id long, quality int")
    assert resample.good_share(labels) == 0.76 and resample.good_share(labels.limit(0)) == 0.9
    assert resample.good_share(labels.filter("quality = 1")) == 1.0


def test_kth_largest(spark):
    rng = random.Random(8)
    keys = [rng.randint(-(2**63), 2**63 - 1) for _ in range(300)] + [5] * 40 + [-1, 0, 1, 2**63 - 1, -(2**63)]
    frame_ = spark.createDataFrame([(k,) for k in keys], "key long")
    order = sorted(keys, reverse=True)
    assert [resample.kth_largest(frame_, k) for k in (1, 150, len(keys))] == [order[0], order[149], order[-1]]
    assert resample.kth_largest(frame_, len(keys) + 1) is None


def test_empty(spark):
    assert resample.resample(spark, frame(spark, []), spark.createDataFrame([], "doc_id long")).count() == 0
