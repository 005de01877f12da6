"""The pipeline against a brute-force version of its stages, on rows that every stage has to take."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import toxicity_pu, tokens
from tessera.runtime import scratch_count
from tests.llm import test_decontaminate, test_line_dedup, test_near_dup
from tests.llm.helpers import CLASHES, corpus, frame
from tests.llm.test_learned import toxic_rows


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    toxic, labels = toxic_rows(240)
    rows = corpus() + [(1000 + i, t) for i, t in toxic]
    rng = random.Random(4)
    leak = " ".join(f"leak{rng.randint(0, 999)}" for _ in range(40))
    rows += [(3000, leak), (3001, rows[5][1] + " " + leak), (3002, " ".join(f"own{k}" for k in range(2000)) + " " + " ".join(leak.split()[3:16]))]
    frame(spark, rows).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1000 + i, 1, t) for i, t in labels] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, leak), (2, None), (None, "x")], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), rows


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or ""))


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or ""))


def test_stages_equal_brute_force(spark, inputs, tmp_path):
    folder, rows = inputs
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert set(CLASHES) <= set(columns)
    held = in_order(rows)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        if name == "toxicity":
            model = toxicity_pu.train_from_labels(spark, docs, spark.read.parquet(f"{folder}/labels.parquet"))
            scored = toxicity_pu.score(spark, docs.select("doc_id", "text"), model).collect()
            want = in_order([(r.doc_id, r.text) for r in scored if r._score < toxicity_pu.THRESHOLD])
            assert 5 < len(held) - len(want) < 60
        elif name == "line_dedup":
            want = in_order([(i, t) for i, t, _, _ in test_line_dedup.brute(held, 20, 3)])
            assert want != held
        elif name == "near_dedup":
            kept = {i for i, (_, c) in test_near_dup.brute(held, 5, 80, 100).items() if i == c}
            once = Counter()
            want = []
            for i, t in held:
                once[i] += 1
                if i is None or i in kept and (once[i] == 1 or not (t or "").split()):
                    want.append((i, t))
            assert 1 < len(held) - len(want) < 150
        elif name == "decontamination":
            found = test_decontaminate.brute(held, [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()], 13)
            want = [x for x, (_, n, hit, _, whole) in zip(held, found, strict=True) if not (whole or hit and 20 * hit >= n)]
            assert {3000, 3001, 3002} >= {i for i, _ in held} - {i for i, _ in want} >= {3000, 3002}
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.columns == columns
            assert pairs(docs) == want, name
            if name == "line_dedup":
                assert all(r.n_chars == len(r.text) for r in docs.collect())
            held = want
    ids = defaultdict(list)
    for r in docs.collect():
        ids[r.doc_id].append((r.start, bytes(r.ids)))
    single = {i for i, n in Counter(i for i, _ in held).items() if n == 1}
    encoded = lambda t: np.array([*tokens.encoder().encode_ordinary(t or ""), 1], "<u4").tobytes()
    assert {i: b"".join(b for _, b in sorted(ids[i])) for i in single} == {i: encoded(t) for i, t in held if i in single}
    assert sum(len(b) for p in ids.values() for _, b in p) == sum(len(encoded(t)) for _, t in held)


def test_run_gives_the_stages_result(spark, inputs):
    folder, _ = inputs
    before = scratch_count(spark)
    out = corpus_pipeline.run(spark, folder)
    assert scratch_count(spark) == before + 1
    assert {"doc_id", "ids", "sequence_id", "offset"} <= set(out.columns) and out.count() > 50


def test_stages_take_empty_tables(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
