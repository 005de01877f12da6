import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tier_pack, token_pack, tokens
from tests.llm.helpers import corpus, frame

LENGTHS = st.lists(st.one_of(st.integers(1, 40), st.integers(1, 3000)), max_size=40)


@pytest.fixture(scope="module")
def reference_ids():
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    return lambda text: known.encode(text or "", add_special_tokens=False).ids


def covered(pieces, lengths):
    """Whether each id of each document stands in exactly one piece."""
    seen = [np.zeros(n, dtype=int) for n in lengths]
    for doc, start, n in pieces:
        assert n > 0
        seen[doc][start : start + n] += 1
    return all((s == 1).all() for s in seen)


@settings(max_examples=150, deadline=None)
@given(LENGTHS)
def test_tiers_hold_every_id_once_without_padding(lengths):
    sequences = tier_pack.pack(lengths)
    assert covered([p for s in sequences for p in s], lengths)
    for s in sequences:
        n = sum(p[2] for p in s)
        assert n <= 2048 and n & (n - 1) == 0
    assert sum(sum(p[2] for p in s) < tier_pack.TIERS[-1] for s in sequences) <= 8


@settings(max_examples=50, deadline=None)
@given(LENGTHS)
def test_step_groups_are_even(lengths):
    sequences = tier_pack.pack(lengths)
    groups = tier_pack.step_groups(sequences, 4096)
    held = defaultdict(int)
    for s, g in zip(sequences, groups, strict=True):
        held[g] += sum(p[2] for p in s)
    if held:
        assert max(held.values()) - min(held.values()) <= 2048


@settings(max_examples=150, deadline=None)
@given(LENGTHS)
def test_best_fit_holds_every_id_once(lengths):
    rows = token_pack.best_fit(lengths, 512)
    assert covered([p for r in rows for p in r], lengths)
    assert all(sum(p[2] for p in r) <= 512 for r in rows)


@settings(max_examples=150, deadline=None)
@given(LENGTHS)
def test_best_fit_fills_rows_as_a_plain_search_does(lengths):
    rooms = []
    for n in sorted((min(512, n - at) for n in lengths for at in range(0, n, 512)), reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
        rooms.append((min(fitting) if fitting else 512) - n)
    assert sorted(512 - sum(p[2] for p in r) for r in token_pack.best_fit(lengths, 512)) == sorted(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(1, 100)), max_size=80))
def test_room_tree_finds_the_least_room(steps):
    tree, held = token_pack.RoomTree(100), []
    for k, (put, room) in enumerate(steps):
        if put:
            tree.put(room, k)
            held.append(room)
        else:
            fitting = [h for h in held if h >= room]
            found = tree.take(room)
            assert (found[1] if found else None) == (min(fitting) if fitting else None)
            if found:
                held.remove(found[1])


def test_ids_are_those_of_the_tokenizers_library(reference_ids):
    import random

    rng = random.Random(1)
    pieces = [*"abcXYZ 0189\n\t\r '’\"!#|é ßñ中文字한글😀\u2003\xa0\u200b\u0301\x00\x1c\x85٣½Ⅷ²", "'s", "'ll", " 's", "<|endoftext|>", "  ", "\n\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(600)] + ["a" * 3000, " " * 3000, "é" * 2000]
    assert [ids.tolist() for ids in tokens.encode(pa.array(texts), 7)] == [[*reference_ids(t), 7] for t in texts]


def test_added_tokens_are_those_of_the_tokenizers_library_by_default(spark, reference_ids):
    import random

    rng, pieces = random.Random(2), ["<|endoftext|>", "<|endoftext|", "<|", "|>", " ", "\n", "a", "'s", "é", "0"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", *("".join(rng.choice(pieces) for _ in range(rng.randint(0, 20))) for _ in range(400))]
    want = [[*reference_ids(t), 7] for t in texts]
    assert want[0] == [64, 220, 50256, 275, 7]
    assert [ids.tolist() for ids in tokens.encode(pa.array(texts), 7)] == want
    rows = frame(spark, list(enumerate(texts[:40])))
    tiers, matrices = defaultdict(list), defaultdict(list)
    for r in tier_pack.pack_tiers(spark, rows, end_id=7).collect():
        tiers[r.doc_id].append((r.start, bytes(r.ids)))
    for r in token_pack.segments(token_pack.pack_matrices(spark, rows, end_id=7)).collect():
        matrices[r.doc_id].append((r.start, bytes(r.ids)))
    for held in (tiers, matrices):
        assert [np.frombuffer(b"".join(b for _, b in sorted(held[i])), "<u4").tolist() for i in range(40)] == want[:40]


def _texts(rows):
    held = defaultdict(list)
    for i, t in rows:
        held[i].append(t)
    return held


def test_packed_pieces_give_back_the_documents(spark, reference_ids):
    rows = [*corpus(), (500, "a <|endoftext|> b<|endoftext|>")]
    out = tier_pack.pack_tiers(spark, frame(spark, rows), group_ids=20_000).collect()
    want = sorted((i is None, i or 0, tuple([*reference_ids(t), 1])) for i, t in rows)
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in out:
        ids = tuple(np.frombuffer(bytes(r.ids), "<u4").tolist())
        assert len(ids) == r.length and r.start + r.length <= r.doc_tokens
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id, r.doc_tokens].append((r.start, ids))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0
    copies = defaultdict(list)  # rows that repeat an id give each piece's start once a row
    for key, pieces in docs.items():
        n = sum(len(ids) for _, ids in pieces) // key[1]
        if n == 1:
            copies[key].append(tuple(x for _, ids in sorted(pieces) for x in ids))
    got = [(k[0] is None, k[0] or 0, v) for k, held in copies.items() for v in held]
    repeated = {(i is None, i or 0) for i, n in ((i, len(t)) for i, t in _texts(rows).items()) if n > 1}
    assert sorted(g for g in got if g[:2] not in repeated) == [w for w in want if w[:2] not in repeated]
    assert sum(r.length for r in out) == sum(len(w[2]) for w in want)


def test_matrices_give_back_the_documents(spark, reference_ids):
    rows = [*((i, t) for i, t in corpus() if i is not None and i != 202), (500, "<|endoftext|>x")]
    packed = token_pack.pack_matrices(spark, frame(spark, rows), context=1024, group_ids=20_000)
    docs = defaultdict(list)
    for r in token_pack.segments(packed).collect():
        docs[r.doc_id].append((r.start, bytes(r.ids)))
    want = {i: np.array([*reference_ids(t), token_pack.END_ID], "<u4").tobytes() for i, t in rows}
    assert {i: b"".join(b for _, b in sorted(p)) for i, p in docs.items()} == want
    for r in packed.collect():
        ids, positions = (np.frombuffer(bytes(b), "<u4") for b in (r.input_ids, r.position_ids))
        assert len(ids) == len(positions) == 1024 and r.cu_seqlens[-1] == r.n_tokens and len(r.cu_seqlens) == r.n_segments + 1
        assert (ids[r.n_tokens :] == token_pack.END_ID).all()
        for a, b in zip(r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert (positions[a:b] == np.arange(b - a)).all()


def test_query_digest(spark, tmp_path, reference_ids):
    from tessera.llm import queries

    rows = [*corpus()[:8], (500, "a <|endoftext|> b")]
    frame(spark, rows, clashes=False).write.parquet(str(tmp_path / "documents.parquet"))
    ids = {i: np.array([*reference_ids(t), 1], "<u4") for i, t in rows}
    out = queries.op10_tiered_packing(spark, str(tmp_path)).collect()
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id]) for r in out)
    assert sum(r.length for r in out) == sum(map(len, ids.values()))


def test_written_matrices_read_back(spark, tmp_path):
    packed = token_pack.pack_matrices(spark, frame(spark, corpus()[:20]), context=256)
    token_pack.write_matrices(packed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == packed.count()


def test_empty(spark):
    assert tier_pack.pack_tiers(spark, frame(spark, [])).count() == 0
    assert token_pack.pack_matrices(spark, frame(spark, [])).count() == 0
