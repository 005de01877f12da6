"""Packed token-id matrices by best-fit decreasing.

Documents are turned into ids in the task that reads them; overlong ones are
split into pieces of the context size without losing an id.  Some million ids
at a time, pieces are placed by falling length, each into the row with the
least room that still holds it; a segment tree over the room left finds that row
in logarithmic time.  A row of the result is a row of the id matrix, with its
cumulative segment lengths and positions that restart at each segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.runtime import ship

CONTEXT = 4096
END_ID = 50256
GROUP_IDS = 1 << 20

SCHEMA = "row_id long, n_tokens int, n_segments int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, input_ids binary, position_ids binary"


class RoomTree:
    """Segment tree over the room left in rows: how many rows have each room."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        node = room + self.width
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The row of the smallest room of ``least`` or more, and its room."""
        node = least + self.width
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.width:
                node *= 2
                if not self.count[node]:
                    node += 1
        room = node - self.width
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit(lengths: list[int], context: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (document, start, length); pieces of a document are whole but for overlong ones."""
    pieces = [(min(context, n - at), doc, at) for doc, n in enumerate(lengths) for at in range(0, n, context)]
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    tree, rows = RoomTree(context), []
    for n, doc, start in pieces:
        found = tree.take(n)
        if found is None:
            rows.append([])
            found = len(rows) - 1, context
        row, room = found
        rows[row].append((doc, start, n))
        if room > n:
            tree.put(room - n, row)
    return rows


def _rows(part: int, first: int, docs: list, ids: list[np.ndarray], context: int, pad_id: int) -> tuple[pa.RecordBatch, int]:
    rows = best_fit([len(x) for x in ids], context)
    matrix = np.full((len(rows), context), pad_id, dtype="<u4")
    positions = np.zeros((len(rows), context), dtype="<u4")
    steps = np.arange(context, dtype="<u4")
    ends = []
    for k, row in enumerate(rows):
        at = 0
        ends.append([0])
        for doc, start, n in row:
            matrix[k, at : at + n] = ids[doc][start : start + n]
            positions[k, at : at + n] = steps[:n]
            at += n
            ends[-1].append(at)
    columns = [
        pa.array([(part << 40) + first + k for k in range(len(rows))], pa.int64()),
        pa.array([e[-1] for e in ends], pa.int32()),
        pa.array([len(r) for r in rows], pa.int32()),
        pa.array([[docs[p[0]] for p in r] for r in rows], pa.list_(pa.int64())),
        pa.array([[p[1] for p in r] for r in rows], pa.list_(pa.int64())),
        pa.array(ends, pa.list_(pa.int32())),
        pa.array([x.tobytes() for x in matrix], pa.binary()),
        pa.array([x.tobytes() for x in positions], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")]), first + len(rows)


def _pack_partition(end_id: int, path: str | None, context: int, group_ids: int):
    def run(batches):
        from pyspark import TaskContext

        part, row = TaskContext.get().partitionId(), 0
        docs, ids, held = [], [], 0
        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1), end_id, path), strict=True):
                docs.append(doc)
                ids.append(own)
                held += len(own)
                if held >= group_ids:
                    made, row = _rows(part, row, docs, ids, context, end_id)
                    yield made
                    docs, ids, held = [], [], 0
        if docs:
            yield _rows(part, row, docs, ids, context, end_id)[0]

    return run


def pack_matrices(spark: SparkSession, docs: DataFrame, context: int = CONTEXT, end_id: int = END_ID, path: str | None = None, group_ids: int = GROUP_IDS) -> DataFrame:
    """Pack the token ids of ``docs`` (doc_id, text) into rows of ``context`` ids.

    A document is the ids of its text and ``end_id``; a null or empty text is the
    end id alone.  Returns one row for each row of the matrix: row_id, n_tokens (ids
    before the padding), n_segments, doc_ids and starts (a document's ids before the
    segment) of the segments, cu_seqlens (cumulative segment lengths from 0),
    input_ids and position_ids (little-endian unsigned 32-bit, ``context`` of each;
    padding is ``end_id`` at position 0).  Rows that repeat a doc_id are documents of
    their own; a null doc_id is carried.  Texts of any length are cut without losing
    an id; documents of equal length go in the order of reading; an empty table gives
    no rows; other columns are not read.
    """
    ship(spark)
    return docs.select("doc_id", "text").mapInArrow(_pack_partition(end_id, path, context, group_ids), SCHEMA)


def write_matrices(packed: DataFrame, path: str, rows_per_file: int = 1 << 14) -> None:
    """Write packed rows as Parquet files of at most so many rows, in the given folder."""
    packed.write.option("maxRecordsPerFile", rows_per_file).parquet(path)


def segments(packed: DataFrame) -> DataFrame:
    """One row a segment (doc_id, start, ids), to get documents back from packed rows."""
    place = F.explode(F.arrays_zip("doc_ids", "starts", F.expr("slice(cu_seqlens, 1, n_segments)").alias("at"), F.expr("slice(cu_seqlens, 2, n_segments)").alias("to")))
    one = packed.select("input_ids", place.alias("s"))
    return one.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.starts").alias("start"), F.expr("substring(input_ids, 4 * s.at + 1, 4 * (s.to - s.at))").alias("ids"))
