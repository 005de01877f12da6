from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import line_dedup
from tessera.llm.rows import unwrap, wrap
from tests.llm.helpers import LOWER, SPACE, corpus, frame


def brute(rows, min_chars, min_docs):
    holders = defaultdict(list)
    for k, (i, text) in enumerate(rows):
        for key in {line.strip(SPACE).translate(LOWER) for line in (text or "").split("\n")}:
            holders[key].append((line_dedup.NO_ID if i is None else i, k))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        own = line_dedup.NO_ID if i is None else i
        kept = []
        for line in lines:
            key = line.strip(SPACE).translate(LOWER)
            if len(key) < min_chars or len(holders[key]) < min_docs or max(holders[key])[0] == own:
                kept.append(line)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize(("shard_keys", "group_keys"), [(1 << 16, 1 << 21), (2, 2)])
def test_equals_brute_force(spark, shard_keys, group_keys):
    rows = corpus()
    docs = frame(spark, rows)
    done = line_dedup.dedup_lines(spark, wrap(docs), 20, 3, shard_keys, group_keys)
    got = [(r.doc_id, r.text, r._n_lines, r._n_dropped) for r in done.collect()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = sorted(brute(rows, 20, 3), key=order)
    assert sum(w[3] for w in want) > 20
    assert sorted(got, key=order) == want
    assert unwrap(done, docs.columns).columns == docs.columns


def test_empty(spark):
    assert line_dedup.dedup_lines(spark, frame(spark, [], clashes=False)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash_is_minimal(keys):
    held = np.array(sorted(keys), dtype=np.uint64)
    assert sorted(line_dedup.PerfectHash.build(held).index(held)) == list(range(len(held)))


def test_strangers_are_told_by_their_fingerprint():
    rng = np.random.default_rng(1)
    import pyarrow as pa

    keys = np.unique(rng.integers(-(2**63), 2**63 - 1, 500))
    table = pa.table({"key": keys, "mark": keys + 1, "docs": np.full(len(keys), 3), "last": np.arange(len(keys)), "shard": np.zeros(len(keys), np.int64)})
    row = line_dedup._build(table).to_pylist()[0]
    shard = line_dedup.Shard(*(row[c] for c in ("sizes", "words", "prints", "counts", "last")))
    own = keys.view(np.uint64)
    assert list(shard.last[shard.find(own, (keys + 1).view(np.uint64))]) == list(range(len(keys)))
    assert (shard.find(own, own) == -1).all()
    assert (shard.find(rng.integers(0, 2**63, 500).astype(np.uint64), own[:1].repeat(500)) == -1).all()
