from collections import Counter

from tessera.llm import host_rules
from tests.llm.helpers import SPACE, corpus, frame, space_words


def brute(text):
    words = space_words(text)
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(k, k + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark):
    rows = [*corpus(), (300, "a b c d e " * 9), (301, "x|y <b> & 5% $1 #t **"), (302, "la la la la la la la la la la la"), (303, "q\nq\n q\nq\n\n\nr"), (304, "fff\nfff\nabc f\nf\nf"), (305, "a\n\f\n\f\nb\n\v\n\v\n\r\n\r"), (306, "a b c d"), (307, "a b c d e"), (308, "a a a a a a")]
    out = host_rules.judge(spark, frame(spark, rows)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, *(r[n] for n in names)) for r in out), key=key) == sorted(((i, *brute(t)) for i, t in rows), key=key)
    for r in out:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.host_rejected)


def test_bad_hosts_are_rejected_and_small_ones_spared(spark):
    good, bad = "every word here is another one so that nothing repeats at all", "two words"
    rows = [("good", good)] * 60 + [("fine", good)] * 40 + [("other", good)] * 40 + [("bad", bad)] * 40 + [("bad", good)] * 5 + [("small", bad)] + [(None, bad)] * 5 + [(None, good)]
    docs = spark.createDataFrame([(k, h, t) for k, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    verdicts = {(rows[r.doc_id][0], r.host_rejected, r.kept) for r in host_rules.judge(spark, docs).collect()}
    assert ("bad", True, False) in verdicts and ("bad", False, True) not in verdicts
    assert ("small", False, False) in verdicts or ("small", True, False) in verdicts
    assert {v for v in verdicts if v[0] == "good"} == {("good", False, True)}
    assert {v for v in verdicts if v[0] is None} == {(None, False, False), (None, False, True)}


def test_large_host_tables_are_joined_by_shuffle(spark):
    from tessera.runtime import join_small

    big = spark.createDataFrame([(k % 7, k) for k in range(200)], "h long, v long")
    small = spark.createDataFrame([(k, f"n{k}") for k in range(5)], "h long, name string")
    rows = [sorted((r.h, r.v, r.name or "") for r in join_small(big, small, "h", "left", limit).collect()) for limit in (100, 2)]
    assert rows[0] == rows[1] and len(rows[0]) == 200


def test_empty(spark):
    assert host_rules.judge(spark, frame(spark, [])).count() == 0
