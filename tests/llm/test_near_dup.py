import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import near_dup
from tessera.runtime import scratch_count
from tests.llm.helpers import LOWER, corpus, frame, space_words


def brute(rows, size, num, den):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets, up = defaultdict(set), {}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, text in rows:
        words = [w.translate(LOWER) for w in space_words(text)]
        own = frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1)) if len(words) >= size else frozenset([tuple(words)] if words else [])
        if i is not None:
            sets[i].add(own)
            up[i] = i
    flat = [(i, s) for i, held in sets.items() for s in held if s]
    for k, (i, s) in enumerate(flat):
        for j, t in flat[:k]:
            shared = len(s & t)
            if den * shared >= num * (len(s) + len(t) - shared):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(next(iter(sets[i]))), find(i)) for i in sets}


@pytest.mark.parametrize(("size", "num"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, size, num):
    rows = corpus()
    out = near_dup.near_duplicates(spark, frame(spark, rows), size, num, 100).collect()
    want = brute(rows, size, num, 100)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


@pytest.mark.parametrize(("limit", "size"), [("BLOCK", 3), ("BLOCK_SHINGLES", 300)])
def test_dense_families_give_the_same(spark, monkeypatch, limit, size):
    rows = [(i, t) for i, t in corpus(5, 10) if i is not None]
    want = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark, frame(spark, rows), 3, 85, 100).collect()}
    monkeypatch.setattr(near_dup, limit, size)
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark, frame(spark, rows), 3, 85, 100).collect()} == want


def test_a_dense_family_of_several_components(spark):
    """One text with more and more of its words changed: a family that links only in parts, beyond one block."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(rng.choice([2, 4, 12, 16, 20])):
            words[rng.randrange(300)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    want = brute(rows, 3, 85, 100)
    assert 20 < len({c for _, c in want.values()}) < 690
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark, frame(spark, rows, clashes=False), 3, 85, 100).collect()} == {i: c for i, (_, c) in want.items()}


def test_blocks_end_at_the_shortest_common_prefix(monkeypatch):
    import pyarrow as pa

    rng, held = np.random.default_rng(1), []
    monkeypatch.setattr(near_dup, "links_of", lambda sets, *_: held.append(len(sets)) or [])
    values = np.concatenate([np.tile(rng.integers(0, 9, near_dup.DEEP), (n, 1)) for n in (5, 5, 3)]).astype(">u4")
    values[:, -1] = np.arange(13)
    sig = np.zeros((13, near_dup.VALUES), ">u4")
    columns = [pa.array([7] * 13), pa.array([0] * 13, pa.int32()), pa.array([v.tobytes() for v in values], pa.binary()), pa.array(range(13)), pa.array([v.tobytes() for v in sig], pa.binary()), pa.array([b"x" * 8] * 13, pa.binary())]
    list(near_dup._deep_blocks(85, 100, 6, 1 << 20)([pa.RecordBatch.from_arrays(columns, names=list("abcdef"))]))
    assert held == [5, 5, 3]
    assert near_dup.common_prefix(np.array([[1, 2, 3], [1, 2, 4], [5, 2, 4], [5, 2, 4]])).tolist() == [2, 0, 3]


def test_repeated_ids_keep_the_least_text(spark):
    rows = [(1, "b c d e f"), (1, "a c d e f"), (1, None), (2, "b c d e f"), (3, " "), (3, "")]
    out = sorted((r.doc_id, r.text) for r in near_dup.drop_near_duplicates(spark, frame(spark, rows, clashes=False)).collect())
    assert out == [(1, "a c d e f"), (3, ""), (3, " ")]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 1001), (2000, 2000)], "a long, b long")
    assert {r.node: r.label for r in near_dup.components(spark, edges).collect()} == {i: 0 for i in range(501)} | {1000: 1000, 1001: 1000, 2000: 2000}


@pytest.mark.parametrize("few", [0, 30, 1 << 18])
def test_components_by_rounds_and_in_one_task(spark, monkeypatch, few):
    """The same components, whichever way connects the edges; few edges take two tables, however long their chains."""
    monkeypatch.setattr(near_dup, "FEW_EDGES", few)
    rng = random.Random(4)
    pairs = [(rng.randint(-90, 90), rng.randint(-90, 90)) for _ in range(100)] + [(k, k + 1) for k in range(1000, 1060)]
    up = {x: x for pair in pairs for x in pair}
    for _ in up:
        for a, b in pairs:
            up[a] = up[b] = min(up[a], up[b])
    before = scratch_count(spark)
    out = near_dup.components(spark, spark.createDataFrame(pairs, "a long, b long"))
    assert scratch_count(spark) - before == 2 or few < len(pairs)
    assert sorted((r.node, r.label) for r in out.collect()) == sorted(up.items())


def test_drop_keeps_one_of_each_component(spark):
    rows = corpus()
    from tessera.llm.rows import unwrap, wrap

    docs = frame(spark, rows)
    out = unwrap(near_dup.drop_near_duplicates(spark, wrap(docs), 5, 80, 100), docs.columns)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    want = brute(rows, 5, 80, 100)
    assert sorted(i for i in kept if i is not None) == sorted(i for i, (_, c) in want.items() if c == i)
    assert kept.count(None) == 2


def test_empty(spark):
    assert near_dup.near_duplicates(spark, frame(spark, []), 3, 85, 100).count() == 0
