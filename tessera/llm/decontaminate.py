"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of 13 words; a window is held as its 3-word shingles
and their offsets.  All documents are counted once for the shingles of the
benchmark, which gives the order by rarity.  As a document must contain all
shingles of a window, one necessary prefix token - the window's rarest shingle -
is enough to find it.  Documents are joined on these tokens, candidates that
would reach over a border of the text (length and position bounds) are
dropped, and the rest are confirmed word by word over the window, by 128 bits of
hash.

The index of a block of windows has a fixed bound and is broadcast; a benchmark
beyond it is taken in several blocks, each a further pass over the documents
that carries what was hit so far, so any benchmark gives the whole result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textkernel as tk
from tessera.runtime import materialise, ship

#: words of a shingle
SHINGLE = 3
#: windows of a block; some 150 bytes each on the driver while the index is made
BLOCK_WINDOWS = 1 << 18


@dataclass
class Words:
    """The words of a chunk: hashes of both lanes, rows, and the rows' first words."""

    chunk: tk.Chunk
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    row: np.ndarray

    @classmethod
    def of(cls, chunk: tk.Chunk) -> Words:
        starts, ends = chunk.spans(tk.ALNUM)
        first = chunk.per_row(starts)
        return cls(chunk, starts, ends, chunk.hashes(starts, ends, True), first, np.repeat(np.arange(chunk.rows), np.diff(first)))

    def other_lane(self) -> np.ndarray:
        return self.chunk.hashes(self.starts, self.ends, True, 1)

    def tokens(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the shingles of so many words, and their first words."""
        hashes, at = tk.grams(self.hashes, self.row, length)
        return hashes ^ np.uint64(length), at


def window_hash(words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of the windows; equal words give equal hashes."""
    out = np.zeros(len(start), dtype=np.uint64)
    for j in range(int(length.max(initial=0))):
        on = np.flatnonzero(length > j)
        out[on] = tk.mix(out[on] * np.uint64(0xA0761D6478BD642F) + words[start[on] + j])
    return out


def _cut(size: int):
    """Windows of the items, with the tokens at each of their offsets."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for chunk in tk.chunks(batch.column(1)):
                words = Words.of(chunk)
                count = np.diff(words.first)
                n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
                row = np.repeat(np.arange(chunk.rows), n)
                start = np.repeat(words.first[:-1], n) + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
                length = np.minimum(count[row], size)
                both = [window_hash(h, start, length) for h in (words.hashes, words.other_lane())]
                tokens = []
                for a, k in zip(start, length, strict=True):
                    step = min(SHINGLE, int(k))
                    tokens.append((tk.gram_hashes(words.hashes[a : a + k], step) ^ np.uint64(step)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(chunk.first, chunk.rows).take(pa.array(row)),
                        *(pa.array(h.view(np.int64)) for h in both),
                        pa.array(length),
                        pa.array(tokens, pa.list_(pa.int64())),
                    ],
                    names=["item", "hi", "lo", "length", "tokens"],
                )

    return run


def _count(shared):
    """Occurrences of the benchmark's tokens in the texts of a task."""

    def run(batches):
        tokens, sizes = shared.value
        sieve, total = tk.Sieve(tokens), np.zeros(len(tokens), dtype=np.int64)
        for batch in batches:
            for chunk in tk.chunks(batch.column(0)):
                words = Words.of(chunk)
                for size in sizes:
                    total += np.bincount(sieve.find(words.tokens(size)[0])[1], minlength=len(tokens))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "seen"])

    return run


@dataclass
class Index:
    """Prefix tokens with their windows, and the windows' items, as flat arrays."""

    tokens: np.ndarray  # sorted, distinct
    token_first: np.ndarray  # postings of token k: token_first[k] to token_first[k + 1]
    window: np.ndarray
    offset: np.ndarray
    hi: np.ndarray
    lo: np.ndarray
    length: np.ndarray
    window_first: np.ndarray  # items of window k
    items: np.ndarray
    sizes: tuple[int, ...]  # shingle lengths in use


def _first(sorted_keys: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_keys, np.arange(n + 1))


def make_index(spark: SparkSession, block: pa.Table, texts: DataFrame) -> Index:
    """Order the block's shingles by rarity in the texts, and index each window under its rarest."""
    item, hi, lo, length = (block[c].to_numpy() for c in ("item", "hi", "lo", "length"))
    order = np.lexsort((item, length, lo, hi))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.any([x[order][1:] != x[order][:-1] for x in (hi, lo, length)], axis=0)
    distinct = order[fresh]
    windows = np.cumsum(fresh) - 1
    lists = block["tokens"].combine_chunks().take(pa.array(distinct))
    flat, ends = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
    owner = np.repeat(np.arange(len(distinct)), ends)
    offset = np.arange(len(flat)) - np.repeat(np.cumsum(ends) - ends, ends)
    tokens, code = np.unique(flat, return_inverse=True)
    sizes = tuple(sorted({int(min(SHINGLE, k)) for k in np.unique(length)}))

    seen = np.zeros(len(tokens), dtype=np.int64)
    counted = texts.mapInArrow(_count(spark.sparkContext.broadcast((tokens, sizes))), "token long, seen long")
    for batch in counted.groupBy("token").agg(F.sum("seen").alias("seen")).toArrow().to_batches():
        seen[batch.column(0).to_numpy()] = batch.column(1).to_numpy()

    best = np.lexsort((offset, code, seen[code], owner))
    best = best[np.concatenate([[True], owner[best][1:] != owner[best][:-1]])] if len(best) else best
    by_token = best[np.argsort(code[best], kind="stable")]
    used, place = np.unique(code[by_token], return_inverse=True)
    return Index(
        tokens[used], _first(place, len(used)), owner[by_token], offset[by_token], hi[distinct].view(np.uint64), lo[distinct].view(np.uint64), length[distinct],
        _first(windows, len(distinct)), item[order], sizes,
    )


def _expand(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of at, all places first[at] to first[at + 1]: which of at, and the place."""
    n = first[at + 1] - first[at]
    which = np.repeat(np.arange(len(at)), n)
    return which, np.repeat(first[at], n) + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


def occurrences(words: Words, index: Index, sieve: tk.Sieve) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed windows in a chunk: first words and window numbers."""
    starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in index.sizes:
        hashes, word = words.tokens(size)
        at, token = sieve.find(hashes)
        which, place = _expand(index.token_first, token)
        window = index.window[place]
        start = word[at[which]] - index.offset[place]
        row = words.row[word[at[which]]]
        fits = (start >= words.first[row]) & (start + index.length[window] <= words.first[row + 1])
        starts.append(start[fits])
        windows.append(window[fits])
    start, window = np.concatenate(starts), np.concatenate(windows)
    if len(start):
        same = window_hash(words.hashes, start, index.length[window]) == index.hi[window]
        start, window = start[same], window[same]
    if len(start):
        same = window_hash(words.other_lane(), start, index.length[window]) == index.lo[window]
        start, window = start[same], window[same]
    return start, window


def _probe(shared, size: int, columns: list[str], carried: list[str] | None, later: bool):
    text_at = columns.index("text")

    def run(batches):
        index: Index = shared.value
        sieve = tk.Sieve(index.tokens)
        for batch in batches:
            for chunk in tk.chunks(batch.column(text_at)):
                words = Words.of(chunk)
                start, window = occurrences(words, index, sieve)
                step = np.zeros(len(words.row) + 1, dtype=np.int64)
                np.add.at(step, start, 1)
                np.add.at(step, start + index.length[window], -1)
                hit = np.cumsum(step[:-1]) > 0
                which, place = _expand(index.window_first, window)
                pairs = np.unique(np.stack([words.row[start[which]], index.items[place]], axis=1), axis=0)
                items = [[]] * chunk.rows
                for r, (a, b) in enumerate(zip(*(np.searchsorted(pairs[:, 0], np.arange(chunk.rows) + k) for k in (0, 1)), strict=True)):
                    items[r] = pairs[a:b, 1]
                if later:
                    old_marks, old_items = (batch.column(len(columns) + k).slice(chunk.first, chunk.rows).to_pylist() for k in (0, 1))
                    for r in range(chunk.rows):
                        a, b = words.first[r], words.first[r + 1]
                        hit[a:b] |= np.unpackbits(np.frombuffer(old_marks[r], np.uint8), count=b - a).astype(bool)
                        items[r] = np.unique(np.concatenate([items[r], np.array(old_items[r], dtype=np.int64)]).astype(np.int64))
                n_windows = np.bincount(words.row[start[index.length[window] == size]], minlength=chunk.rows)
                if later:
                    n_windows = n_windows + batch.column(len(columns) + 4).slice(chunk.first, chunk.rows).to_numpy()
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[words.first[1:]] - total[words.first[:-1]]
                rows = [c.slice(chunk.first, chunk.rows) for c in batch.columns[: len(columns)]]
                state = []
                if carried is None:  # a later pass goes on from here
                    state = [pa.array([np.packbits(hit[a:b]).tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)], pa.binary())]
                out = [c for c, name in zip(rows, columns, strict=True) if carried is None or name in carried]
                names = [name for name in columns if carried is None or name in carried]
                found = [pa.array(items, pa.list_(pa.int64())), pa.array(np.diff(words.first)), pa.array(n_hit), pa.array(n_windows, pa.int64())]
                yield pa.RecordBatch.from_arrays([*out, *state, *found], names=[*names, *["_marks"] * len(state), "_items", "_n_words", "_n_hit", "_n_windows"])

    return run


def find_overlap(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, size: int = 13, carry: list[str] | None = None, block_windows: int = BLOCK_WINDOWS, nameless: bool = False) -> DataFrame:
    """Words of ``docs`` covered by windows of ``benchmark``.

    Words are the maximal runs of ASCII letters and digits and of all code points
    beyond ASCII, A-Z lower-cased.  A window is ``size`` consecutive words of an
    item, or a shorter item's whole sequence.

    Returns the columns ``carry`` of docs (all by default) and _items (distinct
    item ids, ascending), _n_words, _n_hit and _n_windows (places where a window of
    the whole ``size`` stands).  Null and empty texts have no words.  Texts of any
    length are read whole; repeated rows are searched as often as they stand there.  Items without words are ignored; items that repeat an id count as one.
    Items without item_id are ignored, or with ``nameless`` hit words as others do
    and stand in _items as one null.  An empty benchmark hits nothing.
    """
    ship(spark)
    columns = docs.columns
    carry = columns if carry is None else carry
    items = benchmark.select("item_id", "text")
    stand_in = _unused_id(items) if nameless else None
    items = items.filter("item_id is not null") if stand_in is None else items.fillna({"item_id": stand_in})
    windows = materialise(spark, items.mapInArrow(_cut(size), "item long, hi long, lo long, length long, tokens array<long>"))
    blocks = max(1, -(-windows.count() // block_windows))
    texts = docs.select("text")
    kinds = {f.name: f for f in docs.schema.fields}
    found = [T.StructField("_items", T.ArrayType(T.LongType())), T.StructField("_n_words", T.LongType()), T.StructField("_n_hit", T.LongType()), T.StructField("_n_windows", T.LongType())]
    out = docs
    for k in range(blocks):
        block = windows.filter(F.expr(f"pmod(hi, {blocks}L)") == k).toArrow()
        index = spark.sparkContext.broadcast(make_index(spark, block, texts))
        last = k == blocks - 1
        names = carry if last else columns
        state = [] if last else [T.StructField("_marks", T.BinaryType())]
        out = out.mapInArrow(_probe(index, size, columns, carry if last else None, k > 0), T.StructType([*(kinds[c] for c in columns if c in names), *state, *found]))
    if stand_in is not None:
        out = out.withColumn("_items", F.transform("_items", lambda x: F.nullif(x, F.lit(stand_in))))
    return out


def _unused_id(items: DataFrame) -> int | None:
    """An id that no item has, to stand for the null id; None if no id is null."""
    if items.filter("item_id is null").isEmpty():
        return None
    return next(k for k in range(-(1 << 63), 1 << 63) if items.filter(F.col("item_id") == F.lit(k)).isEmpty())


def leaked() -> F.Column:
    """A window of the whole size stands in the text, or, for items shorter than a window, one word in
    twenty is hit: in long texts, too, a passage is a leak, but a few words alone are none."""
    return (F.col("_n_windows") > 0) | contaminated()


def contaminated() -> F.Column:
    """At least one word in twenty is hit, and one at least."""
    return (F.col("_n_hit") > 0) & (20 * F.col("_n_hit") >= F.col("_n_words"))
