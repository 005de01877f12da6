import pytest

from tessera.llm import decontaminate
from tessera.llm.rows import wrap
from tests.llm.helpers import alnum_words, corpus, frame


def brute(rows, items, size):
    windows = {}
    for i, text in items:
        words = alnum_words(text)
        if i is not None and words:
            for k in range(max(1, len(words) - size + 1)):
                windows.setdefault(tuple(words[k : k + size]), set()).add(i)
    out = []
    for i, text in rows:
        words, hit, found, whole = alnum_words(text), set(), set(), 0
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if own := windows.get(tuple(words[k : k + n])):
                    found |= own
                    whole += n == size
                    hit |= set(range(k, k + n))
        out.append((i, len(words), len(hit), sorted(found), whole))
    return out


@pytest.mark.parametrize("block_windows", [1 << 18, 60])
def test_equals_brute_force(spark, block_windows):
    rows = corpus()
    source = [t for _, t in rows[:6]]
    items = [(1, " ".join(source[0].split()[3:40])), (2, source[1].upper()), (3, "one"), (4, "ONE two"), (5, None), (6, ""), (7, "!!"), (2, source[2]), (None, source[3]), (9, " ".join(rows[85][1].split()[100:130])), (10, "not there at all"), (11, source[4])]
    bench = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, hi int, tokens string")
    out = decontaminate.find_overlap(spark, wrap(frame(spark, rows)), bench, 13, ["doc_id"], block_windows)
    assert out.columns == ["doc_id", "_items", "_n_words", "_n_hit", "_n_windows"]
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    want = sorted(brute(rows, items, 13), key=order)
    assert sum(w[2] > 0 for w in want) > 10
    assert sorted(((r.doc_id, r._n_words, r._n_hit, r._items, r._n_windows) for r in out.collect()), key=order) == want


def test_items_without_id_hit_words_as_in_the_oracle(spark, tmp_path):
    import duckdb

    from tessera.llm import queries

    docs = [(1, "a b c x y"), (2, "only p q r here"), (3, "a b c then p q r"), (4, "nothing"), (5, None)]
    frame(spark, docs, clashes=False).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(None, "p q r"), (None, "here"), (7, "a b c"), (-(1 << 63), "then p"), (8, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    with duckdb.connect() as db:
        for name in ("documents", "benchmark"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        found = db.execute(queries.oracle_sql()["op3_prefix_filter_decontamination"])
        names = [c[0] for c in found.description]
        want = sorted(found.fetchall())
    got = sorted(tuple(r[c] for c in names) for r in queries.op3_prefix_filter_decontamination(spark, str(tmp_path)).collect())
    assert got == want and {r[0]: r[2] for r in got} == {1: 3, 2: 4, 3: 7, 4: 0, 5: 0}


def test_a_window_in_a_long_text_is_a_leak(spark):
    long = " ".join(f"w{k}" for k in range(2000))
    item = " ".join(f"leak{k}" for k in range(20))
    passage = lambda k: " ".join(item.split()[:k])
    docs = frame(spark, [(1, f"{long} {passage(13)} {long}"), (2, f"{long} {passage(12)} {long}"), (3, f"short one {long}"), (4, "short one"), (5, long), (6, None)], clashes=False)
    bench = spark.createDataFrame([(1, item), (2, "short one")], "item_id long, text string")
    found = decontaminate.find_overlap(spark, docs, bench, carry=["doc_id"]).withColumn("gone", decontaminate.leaked()).collect()
    assert {r.doc_id: r.gone for r in found} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False}


@pytest.mark.parametrize("empty", ["documents", "benchmark"])
def test_empty(spark, empty):
    docs = frame(spark, [] if empty == "documents" else [(1, "a b c")], clashes=False)
    bench = spark.createDataFrame([] if empty == "benchmark" else [(1, "a b")], "item_id long, text string")
    out = decontaminate.find_overlap(spark, docs, bench).collect()
    assert [(r._n_words, r._n_hit, r._items) for r in out] == ([] if empty == "documents" else [(3, 0, [])])
