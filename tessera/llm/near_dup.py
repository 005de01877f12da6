"""Near-duplicate components by an LSH forest over minhash signatures.

Stages, each linear in the rows but for what stage 6 has to finish:

1. *Signatures*: one pass over the texts gives each document the size of its set
   of word shingles, a 128-bit identity of the set and 128 minhash values.
2. *Classes*: documents of equal sets collapse to one representative, the
   smallest doc_id, by partial aggregation; a class of any size is one row.
3. *Forest*: the signature is put in ``TREES`` sorted orders, each led by
   ``depth`` columns of its own.  Rows are range-partitioned on (order, leading
   values, id); the id makes keys distinct, so a region of equal values that holds a
   third of all rows is still dealt to many tasks.  Sorted neighbours with a common prefix
   of the base depth or more are joined by an edge; a region of n rows gives n - 1 edges,
   never its pairs.  Connected components of the edges are families: every two
   documents that share a prefix of base depth in any order are in one.
4. *Sparse regions*: a family of at most ``BLOCK`` members stays at the base depth;
   its members meet with their full shingle sets in one group.
5. *Dense regions* go deeper: the members of a larger family are sorted by ``PASSES``
   whole orders of ``DEEP`` values, and the sorted rows are cut into blocks of at most
   ``BLOCK`` where neighbours have the shortest common prefix, so each block is as
   deep as its density asks.  Members of a block, the neighbours of longest common
   prefixes, are confirmed with each other.  The rows are range-partitioned and
   read as a stream, so a family of any size is dealt to many tasks.
6. *The exact rest*: near copies are connected by now.  Where a dense family still has several
   components, members of different ones are compared, in blocks by size class and component,
   leaving out pairs of blocks inside one component and of sizes too far apart to link.
7. Components of the confirmed links, joined back to all rows.

Pairs are screened by size and by signature (six standard errors below the
threshold), then confirmed on the full sets; a pair already known to be connected
is skipped, so a group returns a spanning forest of its links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import textkernel as tk
from tessera.runtime import join_small, materialise, ship

#: minhash values of a signature
VALUES = 128
#: sorted orders
TREES = 64
#: members of a family, or of a block of it, that are compared in one task
BLOCK = 256
#: shingles of a block, on average: the sets of two blocks are in memory together
BLOCK_SHINGLES = 1 << 22
#: whole orders in which a dense family is sorted, and the values of such an order
PASSES, DEEP = 4, 24
#: bits of the filter that keeps unrelated documents out of the shuffle of sets
FILTER_BITS = 1 << 22
#: edges that one task connects alone
FEW_EDGES = 1 << 18

SIG_SCHEMA = "doc_id long, n_shingles long, set_hi long, set_lo long, sig binary"


def _minhash_multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    return rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def tree_columns(depth: int) -> np.ndarray:
    """Columns that lead each sorted order."""
    rng = np.random.default_rng(77)
    return np.stack([rng.permutation(VALUES)[:depth] for _ in range(TREES)])


def shingle_sets(chunk: tk.Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, concatenated, and the rows' offsets.

    Words are split at ASCII white space, A-Z lower-cased; a row of fewer than
    ``size`` words but not none has its whole sequence as one shingle."""
    starts, ends = chunk.spans(tk.NOT_SPACE)
    words = chunk.hashes(starts, ends, True)
    first = chunk.per_row(starts)
    counts = np.diff(first)
    row_of = np.repeat(np.arange(chunk.rows), counts)
    hashes, at = tk.grams(words, row_of, size)
    rows = row_of[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = [tk.gram_hashes(words[first[r] : first[r + 1]], counts[r])[0] ^ np.uint64(counts[r]) for r in short]
        hashes = np.concatenate([hashes, np.array(whole, dtype=np.uint64)])
        rows = np.concatenate([rows, short])
    order = np.lexsort((hashes, rows)) if len(short) else _sorted_in_rows(hashes, rows, chunk.rows)
    hashes, rows = hashes[order], rows[order]
    if len(hashes):
        fresh = np.ones(len(hashes), dtype=bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        hashes, rows = hashes[fresh], rows[fresh]
    return hashes, np.searchsorted(rows, np.arange(chunk.rows + 1))


def _sorted_in_rows(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    at = np.searchsorted(rows, np.arange(n + 1))
    out = np.empty(len(hashes), dtype=np.int64)
    for a, b in zip(at[:-1], at[1:], strict=True):
        out[a:b] = a + np.argsort(hashes[a:b])
    return out


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minhash values, one row of VALUES unsigned 32-bit numbers for each set."""
    out = np.zeros((len(offsets) - 1, VALUES), dtype=">u4")
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        by, plus = _minhash_multipliers()
        for k in range(VALUES):
            value = hashes * by[k]
            value += plus[k]
            value >>= np.uint64(32)
            out[full, k] = np.minimum.reduceat(value, offsets[:-1][full])
    return out


def _sign(size: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for chunk in tk.chunks(batch.column(1)):
                hashes, offsets = shingle_sets(chunk, size)
                n = np.diff(offsets)
                sig = signatures(hashes, offsets)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(hashes), dtype=np.uint64)])
                again = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
                hi, lo = (x[offsets[1:]] - x[offsets[:-1]] for x in (total, again))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(chunk.first, chunk.rows),
                        pa.array(n, pa.int64()),
                        pa.array(hi.view(np.int64)),
                        pa.array(lo.view(np.int64)),
                        pa.array([row.tobytes() if k else b"" for row, k in zip(sig, n, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "set_hi", "set_lo", "sig"],
                )

    return run


def _plant(depth: int):
    """Rows (key, node) of each sorted order: key stands for the order and its leading values."""

    def run(batches):
        columns = tree_columns(depth)
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u4").reshape(-1, VALUES).astype(np.uint64)
            for tree, cols in enumerate(columns):
                key = np.full(len(sig), tree + 1, dtype=np.uint64)
                for c in cols:
                    key = tk.mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + sig[:, c])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(nodes)], names=["key", "node"])

    return run


def _neighbours(batches):
    """Edges between sorted neighbours of one region; the first and the last row of
    the partition come out too, as they may have neighbours in the next one."""
    part = _partition_id()
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if last is None:
            yield _edge_batch([key[0]], [node[0]], [-1], part)
        else:
            key, node = np.concatenate([[last[0]], key]), np.concatenate([[last[1]], node])
        same = np.flatnonzero((key[1:] == key[:-1]) & (node[1:] != node[:-1]))
        if len(same):
            yield _edge_batch(key[same], node[same], node[same + 1], -1)
        last = (key[-1], node[-1])
    if last is not None:
        yield _edge_batch([last[0]], [last[1]], [-1], part)


def _partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _edge_batch(key, a, b, part) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(key, np.int64)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)), pa.array(np.full(n, part, np.int64))], names=["key", "a", "b", "part"]
    )


def forest_edges(spark: SparkSession, reps: DataFrame, depth: int) -> DataFrame:
    """Distinct edges (a, b), a < b, between sorted neighbours of equal leading values."""
    rows = reps.select("node", "sig").mapInArrow(_plant(depth), "key long, node long")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    ordered = rows.repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node")
    found = materialise(spark, ordered.mapInArrow(_neighbours, "key long, a long, b long, part long"))
    inner = found.filter("part < 0").select("a", "b")
    # Border rows: two a partition.  A region that spans partitions has the last row of one and
    # the first of the next; the rows of one key are few, as only whole partitions lie between.
    border = found.filter("part >= 0").select("key", F.col("a").alias("node")).distinct()
    ends = border.groupBy("key").agg(F.min("node").alias("low"))
    across = border.join(ends, "key").select(F.col("low").alias("a"), F.col("node").alias("b"))
    return inner.union(across).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _shuffled(c: str) -> F.Column:
    """A bijection of 64-bit numbers that leaves no trace of their order."""
    return F.expr(f"((({c} ^ shiftrightunsigned({c}, 32)) * -7046029254386353131L) ^ shiftrightunsigned(({c} ^ shiftrightunsigned({c}, 32)) * -7046029254386353131L, 29)) * -4658895280553007687L")


def _connected(edges: DataFrame, node: str, label: str) -> DataFrame:
    """Components of few edges (a, b) in one task: each node and the smallest node of its component."""

    def run(batches):
        pairs = [np.stack([c.to_numpy() for c in batch.columns[:2]]) for batch in batches]
        nodes, at = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1), return_inverse=True)
        forest = _Forest(len(nodes))
        for a, b in at.reshape(2, -1).T.tolist():
            forest.join(forest.find(a), forest.find(b))
        least = nodes[[forest.find(k) for k in range(len(nodes))]] if len(nodes) else nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=[node, label])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, f"{node} long, {label} long")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b) as (node, label), label the smallest node.

    Nodes are named by a bijection first, so that names are in no order even along a
    chain of neighbouring ids.  Each round every name hooks to the smallest name next
    to it, parents are followed once more, and the edges are contracted to the new
    names.  About half of the names or more vanish in a round, whatever the shape.
    Once ``FEW_EDGES`` edges or fewer are left, one task connects them: a round writes
    three tables of many small files, and each file has the JVM start processes.
    """
    edges = materialise(spark, edges.select("a", "b"))
    if edges.count() <= FEW_EDGES:
        return materialise(spark, _connected(edges, "node", "label"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = nodes.withColumn("label", _shuffled("node"))
    edges = edges.select(_shuffled("a").alias("a"), _shuffled("b").alias("b")).filter("a <> b")
    while left := edges.count():
        if left <= FEW_EDGES:
            labels = labels.join(_connected(edges, "label", "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label"))
            labels = materialise(spark, labels)
            break
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("x"), F.least("a", "b").alias("up"))
        above = parent.select(F.col("x").alias("up"), F.col("up").alias("top"))
        parent = materialise(spark, parent.join(above, "up", "left").select("x", F.coalesce("top", "up").alias("up")))
        from_a, from_b = (parent.select(F.col("x").alias(c), F.col("up").alias(f"up_{c}")) for c in "ab")
        moved = edges.join(from_a, "a").join(from_b, "b").filter("up_a <> up_b")
        edges = materialise(spark, moved.select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct())
        step = parent.select(F.col("x").alias("label"), "up")
        labels = materialise(spark, labels.join(step, "label", "left").select("node", F.coalesce("up", "label").alias("label")))
    least = labels.groupBy("label").agg(F.min("node").alias("least"))
    return materialise(spark, labels.join(least, "label").select("node", F.col("least").alias("label")))


def id_filter(ids: DataFrame) -> DataFrame:
    """A bitmap of FILTER_BITS bits with a bit for each node, as rows (word, bits) of 64 bits.

    It has FILTER_BITS / 64 rows at most, so it may be broadcast whatever the number
    of ids; beyond its capacity it lets more through but never loses an id."""
    at = ids.select(F.pmod(F.xxhash64("node"), F.lit(FILTER_BITS)).alias("at"))
    words = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    return words.groupBy("word").agg(F.bit_or("bit").alias("bits"))


def maybe_in(docs: DataFrame, bitmap: DataFrame, inside: bool = True) -> DataFrame:
    """Rows whose doc_id may be in the bitmap, or all others; rows without doc_id are others."""
    at = F.pmod(F.xxhash64(docs["doc_id"]), F.lit(FILTER_BITS))
    bitmap = F.broadcast(bitmap.select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    hit = docs["doc_id"].isNotNull() & (F.shiftright(at, 6) == F.col("_word")) & (F.call_function("shiftright", F.col("_bits"), at.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
    return docs.join(bitmap, hit, "left_semi" if inside else "left_anti")


def _sets(size: int):
    def run(batches):
        for batch in batches:
            for chunk in tk.chunks(batch.column(1)):
                hashes, offsets = shingle_sets(chunk, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, chunk.rows), pa.array([hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["node", "shingles"]
                )

    return run


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        self.up[max(a, b)] = min(a, b)


def links_of(sets: list[np.ndarray], sig: np.ndarray, side: np.ndarray, num: int, den: int, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets: pairs with den * |intersection| >= num * |union|.

    With two sides only pairs across them are asked for; rows of equal ``known`` are
    connected already.  Pairs are taken by falling signature agreement, so that most
    are connected before they are due.
    """
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    ratio = num / den
    floor = VALUES * (ratio - 6 * np.sqrt(ratio * (1 - ratio) / VALUES))
    forest, found = _Forest(len(sets)), []
    if known is not None:
        _, first, group = np.unique(known, return_index=True, return_inverse=True)
        forest.up = first[group].tolist()
    left, right, agree = [], [], []
    sizes = size[order]
    for k, i in enumerate(order[:-1]):
        to = np.searchsorted(sizes, sizes[k] * den // num, side="right")
        js = order[k + 1 : to]
        js = js[(side[js] != side[i])] if side.any() else js
        js = js[known[js] != known[i]] if known is not None else js
        if len(js):
            same = (sig[js] == sig[i]).sum(axis=1)
            good = same >= floor
            left.append(np.full(good.sum(), i))
            right.append(js[good])
            agree.append(same[good])
    if not left:
        return found
    left, right, agree = map(np.concatenate, (left, right, agree))
    for p in np.argsort(-agree, kind="stable"):
        i, j = int(left[p]), int(right[p])
        if forest.find(i) == forest.find(j):
            continue
        shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if den * shared >= num * (len(sets[i]) + len(sets[j]) - shared):
            forest.join(forest.find(i), forest.find(j))
            found.append((i, j))
    return found


def _link_table(nodes: np.ndarray, pairs: list[tuple[int, int]]) -> dict[str, pa.Array]:
    return {c: pa.array([int(nodes[p[k]]) for p in pairs], pa.int64()) for k, c in enumerate("ab")}


def _confirm(num: int, den: int):
    """Links of one group of rows (node, sig, shingles); where they have block and comp, across the two blocks and different comps."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        nodes, at = np.unique(table["node"].to_numpy(), return_index=True)
        raw = table["shingles"].take(pa.array(at)).to_pylist()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in raw]
        sig = np.frombuffer(b"".join(table["sig"].take(pa.array(at)).to_pylist()), dtype=">u4").reshape(-1, VALUES).astype(np.uint32)
        side, known = np.zeros(len(at), dtype=bool), None
        if "block" in table.column_names:
            known = table["comp"].to_numpy()[at]
            if table["low"][0] != table["high"][0]:
                side = table["block"].to_numpy()[at] == table["high"][0].as_py()
        return pa.table(_link_table(nodes, links_of(sets, sig, side, num, den, known)))

    return run


def _whole_orders(batches):
    """Each row once for each pass, with the values of that order as sortable bytes."""
    columns = np.stack([np.random.default_rng(78 + k).permutation(VALUES)[:DEEP] for k in range(PASSES)])
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=">u4").reshape(-1, VALUES)
        for k, cols in enumerate(columns):
            prefix = pa.array([row.tobytes() for row in np.ascontiguousarray(sig[:, cols])], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(sig), k, np.int32)), prefix, *batch.columns[1:]], names=["label", "pass", "prefix", "node", "sig", "shingles"])


def common_prefix(values: np.ndarray) -> np.ndarray:
    """Of each row and the next one the number of equal leading values."""
    differ = values[1:] != values[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), values.shape[1])


def _deep_blocks(num: int, den: int, block: int, block_shingles: int):
    """Links inside blocks of rows sorted by (label, pass, prefix).

    Rows of one family and pass are held until they exceed a block, which then ends where the
    neighbours in its second half have the shortest common prefix."""

    def links(rows):
        nodes = np.array([r[0] for r in rows], dtype=np.int64)
        sig = np.stack([np.frombuffer(r[2], dtype=">u4") for r in rows]).astype(np.uint32)
        sets = [np.frombuffer(r[3], dtype=np.uint64) for r in rows]
        found = _link_table(nodes, links_of(sets, sig, np.zeros(len(rows), dtype=bool), num, den))
        return pa.RecordBatch.from_arrays(list(found.values()), names=list(found))

    def run(batches):
        held, group, shingles = [], None, 0
        for batch in batches:
            for label, pass_, prefix, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (label, pass_) != group:
                    yield links(held)
                    held, shingles = [], 0
                elif len(held) > 1 and (len(held) >= block or shingles + len(row[2]) // 8 > block_shingles):
                    shared = common_prefix(np.stack([np.frombuffer(r[1], dtype=">u4") for r in held]))
                    half = len(shared) // 2
                    cut = half + int(len(shared) - half - 1 - np.argmin(shared[half:][::-1])) + 1
                    yield links(held[:cut])
                    held = held[cut:]
                    shingles = sum(len(r[3]) // 8 for r in held)
                group = label, pass_
                held.append((row[0], prefix, row[1], row[2]))
                shingles += len(row[2]) // 8
        if held:
            yield links(held)

    return run


def _deep_links(spark: SparkSession, members: DataFrame, num: int, den: int) -> DataFrame:
    """Links among longest-common-prefix neighbours of dense families: members (label, node, sig, shingles)."""
    rows = members.select("label", "node", "sig", "shingles").mapInArrow(_whole_orders, "label long, pass int, prefix binary, node long, sig binary, shingles binary")
    order = ("label", "pass", "prefix", "node")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_deep_blocks(num, den, BLOCK, BLOCK_SHINGLES), "a long, b long")


def _rest_links(spark: SparkSession, members: DataFrame, merged: DataFrame, num: int, den: int) -> DataFrame | None:
    """Links between different components of one dense family; None where each family is one component.

    A link's sets differ in size by den / num at most, so they are in one size class or in
    neighbouring ones.  Blocks hold rows of one class, and either of one large component or of small ones."""
    placed = members.select("node", "label", "n_shingles").join(merged.select("node", F.col("label").alias("comp")), "node", "left")
    placed = materialise(spark, placed.withColumn("comp", F.coalesce("comp", "node")))
    held = placed.groupBy("label", "comp").agg(F.count(F.lit(1)).alias("held"))
    open_ = held.groupBy("label").agg(F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("label")
    if open_.isEmpty():
        return None
    step = float(np.log(den / num) * (1 + 1e-9))
    rows = placed.join(open_, "label").join(held.select("comp", "held"), "comp")
    rows = rows.select("node", "label", "comp", "n_shingles", F.floor(F.log("n_shingles") / step).alias("class"), F.when(F.col("held") > BLOCK, F.col("comp")).alias("large"))
    keys = ["label", "class", "large"]
    full = rows.groupBy(*keys).agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long").alias("parts"))
    full = full.withColumns({"of": F.xxhash64(*keys), "known": F.col("large").isNotNull()})
    rows = rows.withColumn("of", F.xxhash64(*keys)).join(full.select("of", "parts"), "of")
    rows = rows.select("node", "comp", F.xxhash64("of", F.expr("pmod(xxhash64(node, 11), parts)")).alias("block"))
    blocks = full.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).select("label", "class", "large", F.xxhash64("of", "part").alias("block"))
    one, other = (blocks.select("label", *(F.col(c).alias(f"{c}_{k}") for c in ("class", "large", "block"))) for k in "ab")
    apart = F.col("large_a").isNull() | ~F.col("large_a").eqNullSafe(F.col("large_b"))
    near = (F.col("class_b") == F.col("class_a") + 1) | ((F.col("class_a") == F.col("class_b")) & (F.col("block_a") <= F.col("block_b")))
    pairs = one.join(other, "label").filter(apart & near).select(F.col("block_a").alias("low"), F.col("block_b").alias("high"))
    sides = materialise(spark, pairs).select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    met = rows.join(sides, "block").join(members.select("node", "sig", "shingles"), "node")
    return met.groupBy("low", "high").applyInArrow(_confirm(num, den), "a long, b long")


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, depth: int | None = None) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of num / den or more.

    ``docs`` needs doc_id and text; other columns are ignored.  Returns doc_id,
    n_shingles, component_id (the smallest doc_id reachable) and kept (doc_id =
    component_id), one row for each row of ``docs``.

    Null, empty and blank texts have the empty set and link with nothing.  Rows
    of equal texts are one class; rows that repeat a doc_id are copies of one
    document and share its component.  A row without doc_id links with nothing:
    its component_id is null and it is kept.  Texts of any length are compared
    whole, a similarity of just num / den links, and an empty table gives none.
    """
    ship(spark)
    depth = depth or (8 if num / den >= 0.84 else 7)
    texts = docs.select("doc_id", "text")
    signed = materialise(spark, texts.mapInArrow(_sign(size), SIG_SCHEMA))
    usable = signed.filter("doc_id is not null and n_shingles > 0")
    classes = usable.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("node"))
    classes = materialise(spark, classes)
    reps = usable.join(classes.select(F.col("node").alias("doc_id"), "set_hi", "set_lo"), ["doc_id", "set_hi", "set_lo"], "left_semi")
    reps = materialise(spark, reps.select(F.col("doc_id").alias("node"), "n_shingles", "sig"))

    families = components(spark, forest_edges(spark, reps, depth))
    members = families.join(reps, "node")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("shingles"))
    dense = materialise(spark, sizes.filter((F.col("members") > BLOCK) | (F.col("shingles") > BLOCK_SHINGLES)).select("label", F.lit(True).alias("dense")))
    wanted = maybe_in(texts, materialise(spark, id_filter(families)))
    sets = wanted.mapInArrow(_sets(size), "node long, shingles binary")
    members = join_small(members.join(sets, "node"), dense, "label")
    if dense.isEmpty():
        merged = components(spark, _ordered(members.drop("dense").groupBy("label").applyInArrow(_confirm(num, den), "a long, b long")))
    else:
        members = materialise(spark, members)
        deep = materialise(spark, members.filter("dense").dropDuplicates(["node"]))
        sparse = members.filter("dense is null").drop("dense").groupBy("label").applyInArrow(_confirm(num, den), "a long, b long")
        links = materialise(spark, _ordered(sparse.union(_deep_links(spark, deep, num, den))))
        merged = components(spark, links)
        if (rest := _rest_links(spark, deep, merged, num, den)) is not None:
            merged = components(spark, links.union(_ordered(rest)))

    named = classes.join(merged, "node", "left").select("set_hi", "set_lo", F.coalesce("label", "node").alias("component_id"))
    linked = signed.join(named, ["set_hi", "set_lo"], "left")
    own = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return linked.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document of the smallest
    doc_id stays, once; of rows that repeat it, one with words and the least text.  Rows of other
    ids without words and rows without doc_id all stay.

    Only rows whose id may be among those to drop are shuffled; a filter of fixed
    size lets the others pass where they are read.
    """
    verdict = near_duplicates(spark, docs, size, num, den).filter("doc_id is not null")
    odd = verdict.groupBy(F.col("doc_id").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("kept").alias("kept"), F.max("n_shingles").alias("words"))
    odd = materialise(spark, odd.filter("not kept or (n > 1 and words > 0)").select("node", "kept"))
    bitmap = materialise(spark, id_filter(odd))
    passed, asked = maybe_in(docs, bitmap, False), maybe_in(docs, bitmap)
    joined = asked.join(odd, asked["doc_id"] == odd["node"], "left")
    free = joined.filter("node is null").select(*(asked[c] for c in docs.columns))
    held = joined.filter("node is not null and kept").select(*(asked[c] for c in docs.columns))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    least = F.min_by(F.struct(*docs.columns), F.struct(~worded, "text"))
    single = held.groupBy(F.col("doc_id").alias("_id")).agg(least.alias("_row")).select("_row.*")
    return passed.union(free).union(single)
