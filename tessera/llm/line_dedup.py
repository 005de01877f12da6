"""Line deduplication through sharded minimal perfect hashes.

One pass counts, for each line key, the documents that hold it and the largest
of their ids.  The keys that repeat often enough to be dropped are dealt to
shards by hash; each shard is built in its own task into a minimal perfect hash
with three dense arrays in its order: 64-bit fingerprints, document counts and
largest ids.  Documents then probe the arrays in one more pass without any join
or shuffle of lines.  Shards are broadcast in groups of bounded size; further
groups are further passes over the rows, which carry a bit a line.  After ``CHAINED`` passes the
rows are written down and those groups given up, so the driver and the executors hold a
bounded number of them however many keys there are.

Only keys that documents repeat often enough are built in: an index of all distinct
lines would hold mostly keys that drop nothing, at 25 bytes each.  So the count of a key found
always reaches the limit, and the probe's look at it is a guard, not a second decision.

A key's slot comes from one hash family and its fingerprint from another, so a
line outside the shard is told apart by all 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textkernel as tk
from tessera.runtime import materialise, ship

#: keys of a shard, on average
SHARD_KEYS = 1 << 16
#: keys broadcast at once; about 25 bytes each
GROUP_KEYS = 1 << 21
#: passes in one chain of Python workers, and so groups held at a time
CHAINED = 4
#: bits of a level of the perfect hash, for each key that reaches it
GAMMA = 2.0
#: rows without doc_id count as below every id
NO_ID = -(1 << 63)


class PerfectHash:
    """Minimal perfect hash by levels of bit arrays.

    A key sets a bit at a level where no other remaining key meets it; the others
    go on to the next level.  A key's index is the number of bits before its own.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tk.mix(keys ^ np.uint64((level * 0x9E3779B97F4A7C15 + 1) & tk.MASK64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct unsigned 64-bit numbers."""
        sizes, bits, rest = [], [], keys
        while len(rest):
            size = -(-max(64, int(GAMMA * len(rest))) // 64) * 64
            slot = cls._slot(rest, len(sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            rest = rest[~alone[slot]]
        flags = np.concatenate(bits) if bits else np.zeros(0, bool)
        return cls(np.array(sizes, dtype=np.int64), np.packbits(flags, bitorder="little").view(np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key below the number of keys; -1 for some that were not built in,
        any index for others, to be told apart by their fingerprint."""
        out = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self._slot(keys[rest], level, int(size)) + self.starts[level]
            word, shift = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1)))
            out[rest[hit]] = self.ranks[at[hit] >> 6] + below[hit]
            rest = rest[~hit]
        return out


class Shard:
    """A perfect hash with its arrays."""

    def __init__(self, sizes: bytes, words: bytes, prints: bytes, counts: bytes, last: bytes):
        self.hash = PerfectHash(np.frombuffer(sizes, np.int64), np.frombuffer(words, np.uint64))
        self.prints, self.counts, self.last = np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.int64), np.frombuffer(last, np.int64)

    def find(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Index of each line key, -1 where the shard does not hold it."""
        at = self.hash.index(keys)
        at[(at >= 0) & (self.prints[at] != prints)] = -1
        return at


def line_spans(chunk: tk.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the first line of each row; every row has one line at least."""
    breaks = np.flatnonzero(chunk.data == 10)
    first = np.searchsorted(breaks, chunk.offsets) + np.arange(len(chunk.offsets))
    n = int(first[-1])
    inner = np.ones(n + 1, dtype=bool)
    inner[first] = False
    starts, ends = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    starts[first[:-1]], starts[inner[:-1]] = chunk.offsets[:-1], breaks + 1
    ends[first[1:] - 1], ends[inner[:-1].nonzero()[0] - 1] = chunk.offsets[1:], breaks
    return starts, ends, first


def line_keys(chunk: tk.Chunk, starts: np.ndarray, ends: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines whose key is long enough: their indices and both hashes of their keys."""
    from_, to = chunk.spans(tk.NOT_SPACE)
    if not len(from_):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.searchsorted(from_, starts), np.searchsorted(from_, ends) - 1
    at = np.flatnonzero(b >= a)
    left, right = from_[a[at]], to[b[at]]
    points = np.concatenate([[0], np.cumsum(tk.LEADS[chunk.data])])
    long_ = points[right] - points[left] >= min_chars
    at, left, right = at[long_], left[long_], right[long_]
    return at, chunk.hashes(left, right, True, 0), chunk.hashes(left, right, True, 1)


def _ids(column: pa.Array) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in column.to_pylist()], dtype=np.int64) if column.null_count else column.to_numpy()


def _count_lines(min_chars: int):
    def run(batches):
        for batch in batches:
            ids = _ids(batch.column(0))
            for chunk in tk.chunks(batch.column(1)):
                starts, ends, first = line_spans(chunk)
                at, key, mark = line_keys(chunk, starts, ends, min_chars)
                row = np.searchsorted(first, at, side="right") - 1
                order = np.lexsort((mark, key, row))
                key, mark, row = key[order], mark[order], row[order]
                if len(key):
                    fresh = np.ones(len(key), dtype=bool)
                    fresh[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1]) | (row[1:] != row[:-1])
                    key, mark, row = key[fresh], mark[fresh], row[fresh]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(mark.view(np.int64)), pa.array(ids[chunk.first + row])], names=["key", "mark", "holder"]
                )

    return run


def _build(table: pa.Table) -> pa.Table:
    keys = table["key"].to_numpy().view(np.uint64)
    order = np.lexsort((table["mark"].to_numpy().view(np.uint64), keys))
    kept = order[np.concatenate([[True], keys[order][1:] != keys[order][:-1]])]
    extra = np.setdiff1d(order, kept)  # equal in 64 bits of their key only: a second hash of their own
    rows = []
    for level, part in enumerate((kept, extra)):
        if len(part) or not level:
            made = PerfectHash.build(keys[part])
            at = part[np.argsort(made.index(keys[part]))]
            columns = [table["mark"].to_numpy()[at], table["docs"].to_numpy()[at], table["last"].to_numpy()[at]]
            rows.append([made.sizes.tobytes(), made.words.tobytes(), *(c.astype(np.int64).tobytes() for c in columns)])
    names = ["sizes", "words", "prints", "counts", "last"]
    return pa.table({"shard": pa.array([table["shard"][0].as_py()] * len(rows), pa.int64())} | {c: pa.array([r[k] for r in rows], pa.binary()) for k, c in enumerate(names)})


SHARD_SCHEMA = "shard long, sizes binary, words binary, prints binary, counts binary, last binary"


def build_shards(spark: SparkSession, keys: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """The shards of the keys (key, mark, docs, last) as rows, and how many there are."""
    n = max(1, -(-keys.count() // shard_keys))
    dealt = keys.withColumn("shard", F.expr(f"pmod(key, {n}L)"))
    return materialise(spark, dealt.groupBy("shard").applyInArrow(_build, SHARD_SCHEMA)), n


def _probe(shared, shards: int, min_chars: int, min_docs: int, columns: list[str], first_pass: bool, last_pass: bool):
    """A pass over the rows: marks the lines that the group's shards drop; the last pass rewrites the texts."""
    text_at, id_at = columns.index("text"), columns.index("doc_id")

    def run(batches):
        tables: dict[int, list[Shard]] = {}
        for shard, *arrays in shared.value:
            tables.setdefault(shard, []).append(Shard(*arrays))
        for batch in batches:
            ids = _ids(batch.column(id_at))
            masks = None if first_pass else batch.column(len(columns)).to_pylist()
            for chunk in tk.chunks(batch.column(text_at)):
                starts, ends, first = line_spans(chunk)
                drop = np.zeros(len(starts), dtype=bool)
                if masks is not None:
                    for r in range(chunk.rows):
                        bits = np.frombuffer(masks[chunk.first + r], dtype=np.uint8)
                        drop[first[r] : first[r + 1]] = np.unpackbits(bits, count=first[r + 1] - first[r]).astype(bool)
                at, key, mark = line_keys(chunk, starts, ends, min_chars)
                owner = ids[chunk.first + np.searchsorted(first, at, side="right") - 1]
                shard = _shard_of(key, shards)
                for s in np.unique(shard):
                    for table in tables.get(int(s), ()):
                        mine = np.flatnonzero(shard == s)
                        found = table.find(key[mine], mark[mine])
                        mine, found = mine[found >= 0], found[found >= 0]
                        lose = (table.counts[found] >= min_docs) & (table.last[found] != owner[mine])
                        drop[at[mine[lose]]] = True
                rows = [c.slice(chunk.first, chunk.rows) for c in batch.columns[: len(columns)]]
                if not last_pass:
                    packed = [np.packbits(drop[first[r] : first[r + 1]]).tobytes() for r in range(chunk.rows)]
                    yield pa.RecordBatch.from_arrays([*rows, pa.array(packed, pa.binary())], names=[*columns, "_lines"])
                    continue
                gone = np.add.reduceat(drop, first[:-1], dtype=np.int64)
                rows[text_at] = kept_text(chunk, starts, ends, first, drop)
                yield pa.RecordBatch.from_arrays([*rows, pa.array(np.diff(first)), pa.array(gone)], names=[*columns, "_n_lines", "_n_dropped"])

    return run


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """What ``pmod(key, shards)`` gives in SQL; slots inside a shard come from mixed keys."""
    return np.mod(keys.view(np.int64), np.int64(shards))


def kept_text(chunk: tk.Chunk, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, drop: np.ndarray) -> pa.Array:
    """The rows' kept lines, joined by a line feed."""
    keep = np.flatnonzero(~drop)
    row = np.searchsorted(first, keep, side="right") - 1
    joined = np.zeros(len(keep), dtype=np.int64)
    if len(keep):
        joined[:-1] = row[1:] == row[:-1]
    to = ends[keep] + joined
    step = np.zeros(len(chunk.data) + 1, dtype=np.int8)
    np.add.at(step, starts[keep], 1)
    np.add.at(step, to, -1)
    data = chunk.data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    offsets = np.zeros(chunk.rows + 1, dtype=np.int32)
    np.cumsum(np.bincount(row, weights=to - starts[keep], minlength=chunk.rows), out=(total := np.empty(chunk.rows)))
    offsets[1:] = total
    return pa.StringArray.from_buffers(chunk.rows, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def dedup_lines(spark: SparkSession, docs: DataFrame, min_chars: int = 20, min_docs: int = 3, shard_keys: int = SHARD_KEYS, group_keys: int = GROUP_KEYS) -> DataFrame:
    """Drop repeated lines from ``text``.

    Texts are split at line feeds.  A line's key is the line without the ASCII
    white space at both ends, A-Z lower-cased.  A key of ``min_chars`` code points
    or more that ``min_docs`` rows or more hold loses all its lines except in the
    row of the largest doc_id holding it (in all rows that share that id).

    Returns the columns of ``docs`` with ``text`` rewritten, and _n_lines and
    _n_dropped.  Null and empty texts have one empty line and come back empty.  A
    line repeated in one row counts once for that row.  Rows without doc_id count
    as below every id.  Texts of any length are read whole; an empty table gives none.
    """
    ship(spark)
    texts = docs.select("doc_id", "text")
    counted = texts.mapInArrow(_count_lines(min_chars), "key long, mark long, holder long")
    keys = counted.groupBy("key", "mark").agg(F.count(F.lit(1)).alias("docs"), F.max("holder").alias("last"))
    shards, n = build_shards(spark, materialise(spark, keys.filter(F.col("docs") >= min_docs)), shard_keys)

    columns = docs.columns
    at_once = max(1, group_keys // shard_keys)
    groups = [(k, min(k + at_once, n)) for k in range(0, n, at_once)]
    out_type = T.StructType(docs.schema.fields)
    out, shared = docs, []
    for k, (lo, hi) in enumerate(groups):
        if len(shared) == CHAINED:
            out = materialise(spark, out)
            for old in shared:
                old.unpersist()
            shared = []
        held = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in shards.filter((F.col("shard") >= lo) & (F.col("shard") < hi)).collect()]
        first_pass, last_pass = k == 0, k == len(groups) - 1
        added = [T.StructField("_n_lines", T.LongType()), T.StructField("_n_dropped", T.LongType())] if last_pass else [T.StructField("_lines", T.BinaryType())]
        shared.append(spark.sparkContext.broadcast(held))
        run = _probe(shared[-1], n, min_chars, min_docs, columns, first_pass, last_pass)
        out = out.mapInArrow(run, T.StructType([*out_type.fields, *added]))
    return out
