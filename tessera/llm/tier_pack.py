"""Hierarchical multi-length packing of token ids.

Each task packs the documents of its own partition, some million ids at a time,
so packing needs no shuffle and its memory is bounded.  A document's pieces of
the longest window go straight to windows of their own; what is left is routed
to the smallest tier (context size) that holds it.  Tiers are packed from the
longest: a window takes its tier's largest piece, then the largest pieces of
shorter tiers that fit, and at last a cut of the smallest piece that does not,
so every window is full.  When the pieces run out, the rest is laid out in
windows of falling powers of two.  Sequences are then dealt to step groups of
equal tokens, the costliest first.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import tokens
from tessera.runtime import ship

#: context sizes, longest first; the lengths of windows must be powers of two
TIERS = (2048, 1024, 512, 256)
#: ids packed at once
GROUP_IDS = 1 << 20
#: ids of a step group
STEP_IDS = 32 * 2048

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier long, step_group long"

Piece = tuple[int, int, int]  # document, start, length


class Pool:
    """Pieces by length; the lengths in use are the bits of one number."""

    def __init__(self):
        self.by_length: dict[int, list[Piece]] = defaultdict(list)
        self.lengths = 0

    def add(self, piece: Piece) -> None:
        self.by_length[piece[2]].append(piece)
        self.lengths |= 1 << piece[2]

    def _take(self, length: int) -> Piece:
        held = self.by_length[length]
        piece = held.pop()
        if not held:
            self.lengths &= ~(1 << length)
        return piece

    def largest(self, most: int) -> Piece | None:
        fitting = self.lengths & ((2 << most) - 1)
        return self._take(fitting.bit_length() - 1) if fitting else None

    def smallest(self) -> Piece | None:
        return self._take((self.lengths & -self.lengths).bit_length() - 1) if self.lengths else None


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[Piece]]:
    """Sequences of pieces that hold each id of each document once; every sequence's
    length is a power of two, the longest tier at most."""
    longest, out, pool = tiers[0], [], Pool()
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        out += [[(doc, at, longest)] for at in range(0, whole, longest)]
        if n > whole:
            pool.add((doc, whole, n - whole))
    rest: list[Piece] = []
    for tier, shorter in zip(tiers, (*tiers[1:], 0), strict=True):
        while pool.lengths >> (shorter + 1):
            window, gap = [], tier
            while gap and (piece := pool.largest(gap) or pool.smallest()):
                doc, start, n = piece
                window.append((doc, start, min(n, gap)))
                if n > gap:
                    pool.add((doc, start + gap, n - gap))
                gap -= window[-1][2]
            if gap:
                rest += window
            else:
                out.append(window)
    left = sum(p[2] for p in rest)
    while left:
        gap = min(longest, 1 << (left.bit_length() - 1))
        left -= gap
        window = []
        while gap:
            doc, start, n = rest.pop(0)
            window.append((doc, start, min(n, gap)))
            if n > gap:
                rest.insert(0, (doc, start + gap, n - gap))
            gap -= window[-1][2]
        out.append(window)
    return out


def step_groups(sequences: list[list[Piece]], step_ids: int = STEP_IDS) -> list[int]:
    """A step group for each sequence: the longest first, to the group of fewest ids so far,
    then of least attention work (the squares of its pieces)."""
    ids = [sum(p[2] for p in s) for s in sequences]
    work = [sum(p[2] ** 2 for p in s) for s in sequences]
    groups = [(0, 0, g) for g in range(max(1, -(-sum(ids) // step_ids)))]
    out = [0] * len(sequences)
    for k in sorted(range(len(sequences)), key=lambda k: (-ids[k], -work[k])):
        n, w, g = heapq.heappop(groups)
        out[k] = g
        heapq.heappush(groups, (n + ids[k], w + work[k], g))
    return out


def _rows(part: int, first: int, first_group: int, docs: list, ids: list[np.ndarray], tiers, step_ids) -> tuple[pa.RecordBatch, int, int]:
    sequences = pack([len(x) for x in ids], tiers)
    groups = step_groups(sequences, step_ids)
    columns: list[list] = [[] for _ in range(9)]
    for k, (sequence, group) in enumerate(zip(sequences, groups, strict=True)):
        offset, tier = 0, sum(p[2] for p in sequence)
        for doc, start, n in sequence:
            row = (docs[doc], start, n, ids[doc][start : start + n].tobytes(), len(ids[doc]), (part << 40) + first + k, offset, tier, (part << 40) + first_group + group)
            for column, value in zip(columns, row, strict=True):
                column.append(value)
            offset += n
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    arrays = [pa.array(c, pa.binary() if name == "ids" else pa.int64()) for c, name in zip(columns, names, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=names), first + len(sequences), first_group + max(groups, default=-1) + 1


def _pack_partition(end_id: int, path: str | None, tiers: tuple[int, ...], group_ids: int, step_ids: int):
    def run(batches):
        from pyspark import TaskContext

        part, sequence, group = TaskContext.get().partitionId(), 0, 0
        docs, ids, held = [], [], 0
        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1), end_id, path), strict=True):
                docs.append(doc)
                ids.append(own)
                held += len(own)
                if held >= group_ids:
                    made, sequence, group = _rows(part, sequence, group, docs, ids, tiers, step_ids)
                    yield made
                    docs, ids, held = [], [], 0
        if docs:
            yield _rows(part, sequence, group, docs, ids, tiers, step_ids)[0]

    return run


def pack_tiers(spark: SparkSession, docs: DataFrame, end_id: int = 1, path: str | None = None, tiers: tuple[int, ...] = TIERS, group_ids: int = GROUP_IDS, step_ids: int = STEP_IDS) -> DataFrame:
    """Pack the token ids of ``docs`` (doc_id, text) into sequences.

    A document is the ids of its text and ``end_id``; a null or empty text is the
    end id alone.  Returns one row a piece: doc_id, start (the document's ids before
    it), length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset
    in the sequence, tier (the sequence's length) and step_group.  Rows that repeat
    a doc_id are documents of their own; a null doc_id is carried.  Texts of any
    length are cut without losing an id; ties between pieces of one length follow
    from the order of reading alone; an empty table gives no pieces; other columns
    are not read.
    """
    ship(spark)
    return docs.select("doc_id", "text").mapInArrow(_pack_partition(end_id, path, tiers, group_ids, step_ids), SCHEMA)
