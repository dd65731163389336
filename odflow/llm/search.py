"""Exact top-k search by inner product with KD-trees per shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odflow.session import materialise, small_side

SHARD_ROWS = 8192
LEAF_ROWS = 256
QUERY_BLOCK = 1024
#: Rows that the coarse splits into shards are fitted on; every row is dealt by them and searched.
SAMPLE_ROWS = 20_000
SAMPLE_PER_CELL = 32
#: Boxes of shards that are compared with a block of queries at once.
PACK_SHARDS = 512
#: A row without an id comes after all others among equal scores.
NO_ID = (1 << 63) - 1
#: Products of whole numbers are exact in floating point up to here.
EXACT = float(1 << 53)


def whole_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v, width): floor(scale * x) of each component; rows that take no part are left out.

    Out are null or empty vectors and vectors with a null or non-finite component.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(
        (F.coalesce(F.size("x"), F.lit(0)) > 0) & F.forall("x", lambda e: F.coalesce(F.abs(e) < float("inf"), F.lit(False)))
    ).select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"), F.size("x").alias("width"))


class Tree:
    """KD-tree over rows of whole numbers: median splits on the widest side, tight bounding boxes.

    Nodes are numbered from the root; ``child`` holds the left child or -1, the right one follows
    it. ``span`` is the run of rows below a node, ``first_id`` the smallest id there. ``numbers`` are the rows'
    own numbers, different also where ids are equal.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, numbers: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.lexsort((numbers, ids))
        rows, ids, numbers = rows[order], ids[order], numbers[order]
        spans, children, k = [(0, len(ids))], [], 0
        while k < len(spans):
            a, b = spans[k]
            if b - a <= leaf_rows:
                children.append(-1)
            else:
                part = rows[a:b]
                side = int((part.max(0) - part.min(0)).argmax())
                half = np.argsort(part[:, side], kind="stable")  # ties keep the order of ids
                rows[a:b], ids[a:b], numbers[a:b] = part[half], ids[a:b][half], numbers[a:b][half]
                children.append(len(spans))
                middle = (a + b) // 2
                spans += [(a, middle), (middle, b)]
            k += 1
        self.rows, self.ids, self.numbers = rows, ids, numbers
        self.span, self.child = np.array(spans), np.array(children)
        self.low = np.stack([rows[a:b].min(0) for a, b in spans])
        self.high = np.stack([rows[a:b].max(0) for a, b in spans])
        self.first_id = np.array([ids[a:b].min() for a, b in spans])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Largest inner product that any point of each node's box can have with each query."""
        return product(np.maximum(queries, 0), self.high) + product(np.minimum(queries, 0), self.low)

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, best: list[tuple[int, int, int]], k: int) -> int:
        """Improve ``best``, a heap of (score, -id, -number) with the worst first, by best-first traversal.

        ``own`` is the query's number, which is no candidate. Nodes are opened by falling bound. A node is
        skipped if it cannot hold a pair better than the kth: a lower bound, or an equal one with larger
        ids. Returns the rows compared.
        """
        queue, compared = [(-int(bounds[0]), int(self.first_id[0]), 0)], 0
        while queue:
            bound, first, node = heapq.heappop(queue)
            if len(best) == k and (-bound, -first) < best[0][:2]:
                if -bound < best[0][0]:
                    break
                continue
            if self.child[node] >= 0:
                for c in (self.child[node], self.child[node] + 1):
                    heapq.heappush(queue, (-int(bounds[c]), int(self.first_id[c]), int(c)))
                continue
            a, b = self.span[node]
            scores, ids, numbers = product(self.rows[a:b], query[None, :])[:, 0], self.ids[a:b], self.numbers[a:b]
            compared += b - a
            if len(best) == k:
                near = scores >= best[0][0]
                scores, ids, numbers = scores[near], ids[near], numbers[near]
            if len(ids) > k + 1:
                top = np.lexsort((numbers, ids, -scores))[: k + 1]  # one more, for the query itself
                scores, ids, numbers = scores[top], ids[top], numbers[top]
            for score, vec, number in zip(scores.tolist(), ids.tolist(), numbers.tolist(), strict=True):
                if number != own:
                    if len(best) < k:
                        heapq.heappush(best, (score, -vec, -number))
                    elif (score, -vec, -number) > best[0]:
                        heapq.heapreplace(best, (score, -vec, -number))
        return compared


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows, exact: by floats where they hold whole numbers exactly, else by integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def coarse_cells(rows: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Median splits of a sample into about ``cells`` parts, as nodes (side, value, left, right); a leaf has side -1.

    The left child takes components up to the value. A part whose rows are all equal is not split.
    """
    nodes: list[tuple[int, float, int, int]] = []
    waiting = [(np.arange(len(rows)), cells)]
    while waiting:
        part, share = waiting.pop(0)
        spread = np.ptp(rows[part], axis=0) if len(part) > 1 else np.zeros(1)
        side = int(spread.argmax())
        if share < 2 or spread[side] == 0:
            nodes.append((-1, 0.0, 0, 0))
            continue
        values = np.sort(rows[part, side])
        value = values[(len(part) - 1) // 2]
        if value == values[-1]:
            value = values[values < value].max()
        low = rows[part, side] <= value
        nodes.append((side, float(value), len(nodes) + len(waiting) + 1, len(nodes) + len(waiting) + 2))
        waiting += [(part[low], share // 2), (part[~low], share - share // 2)]
    return nodes


def dealt(whole: DataFrame, n: int, shard_rows: int) -> DataFrame:
    """``whole`` with ``cell``: the leaf of the coarse splits of its width, or minus the width if that has none."""
    sample = whole.orderBy(F.xxhash64("number"), "number").limit(SAMPLE_ROWS).select("width", "v").toArrow()
    widths = sample.column("width").to_numpy()
    flat = sample.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(widths)])
    splits, first = {}, 0
    for width in np.unique(widths).tolist():
        picked = np.flatnonzero(widths == width)
        cells = min(int(n * len(picked) / len(widths) / shard_rows) + 1, len(picked) // SAMPLE_PER_CELL)
        if cells > 1:
            nodes = coarse_cells(flat[bounds[picked][:, None] + np.arange(width)], cells)
            splits[width] = (np.array(nodes), first)
            first += len(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, lists = batch.column("width").to_numpy(), batch.column("v")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(widths)])[:-1]
            cell = -widths.astype(np.int64)
            for width, (nodes, first) in splits.items():
                at = np.flatnonzero(widths == width)
                if len(at):
                    points, node = flat[starts[at][:, None] + np.arange(width)], np.zeros(len(at), np.int64)
                    while (inner := np.flatnonzero(nodes[node, 0] >= 0)).size:
                        side, value = nodes[node[inner], 0].astype(np.int64), nodes[node[inner], 1]
                        low = points[inner, side] <= value
                        node[inner] = np.where(low, nodes[node[inner], 2], nodes[node[inner], 3]).astype(np.int64)
                    cell[at] = first + node
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return whole.mapInArrow(run, T.StructType([*whole.schema.fields, T.StructField("cell", T.LongType())]))


def packed(rows: DataFrame, key: str) -> DataFrame:
    """(key, width, ids, numbers, vectors, low, high): the rows of each key as bytes, with their bounding box."""

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        points = flat.reshape(n, -1)
        ids = table.column("vec_id").fill_null(NO_ID).to_numpy()
        blobs = {
            "ids": ids, "numbers": table.column("number").to_numpy(), "vectors": flat, "low": points.min(0), "high": points.max(0)
        }
        return pa.table({
            key: pa.array([table.column(key)[0].as_py()], pa.int64()),
            "width": pa.array([points.shape[1]], pa.int32()),
            **{c: pa.array([x.astype("<i8").tobytes()], pa.binary()) for c, x in blobs.items()},
        })

    return rows.groupBy(key).applyInArrow(run, f"{key} long, width int, ids binary, numbers binary, vectors binary, low binary, high binary")


def longs(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i8").copy()


def matrix(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, "<i8").reshape(-1, width).copy()


def packs_of(trees: DataFrame, packs: int) -> DataFrame:
    """(width, pack, shards, lows, highs): the boxes of many shards together."""
    pack = F.pmod(F.xxhash64(F.lit("pack"), "shard"), F.lit(packs)).cast("int").alias("pack")
    boxes = F.array_sort(F.collect_list(F.struct("shard", "low", "high"))).alias("b")
    return trees.groupBy("width", pack).agg(boxes).select(
        "width", "pack", F.col("b.shard").alias("shards"), F.col("b.low").alias("lows"), F.col("b.high").alias("highs")
    )


def query_blocks(asked: DataFrame, blocks: int, packs: int) -> DataFrame:
    """Queries (number, v, width, kth) in blocks of one width, each block once for every pack."""
    block = F.pmod(F.xxhash64(F.lit("query"), "number"), F.lit(blocks)).alias("block")
    rows = asked.groupBy("width", block).agg(F.collect_list(F.struct("number", "v", "kth", "done")).alias("queries"))
    return rows.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))


def box_bounds(batch_row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Query vectors, and the largest product that each (row) can have with a point of each box (column)."""
    width = batch_row["width"]
    queries = np.array([q["v"] for q in batch_row["queries"]], np.int64).reshape(-1, width)
    low, high = (matrix(b"".join(batch_row[c]), width) for c in ("lows", "highs"))
    return queries, product(np.maximum(queries, 0), high) + product(np.minimum(queries, 0), low)


def best_shards(blocks: DataFrame, packs: DataFrame) -> DataFrame:
    """(number, shard): for each query the shard whose box reaches highest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, bounds = box_bounds(row)
                top = bounds.argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([q["number"] for q in row["queries"]], pa.int64()),
                        pa.array(bounds[np.arange(len(top)), top]),
                        pa.array(np.array(row["shards"])[top], pa.int64()),
                    ],
                    names=["number", "bound", "shard"],
                )

    found = blocks.join(packs, ["width", "pack"]).mapInArrow(run, "number long, bound long, shard long")
    return found.groupBy("number").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard"))


WORK = "shard long, numbers binary, asked binary, kth binary"


def open_pairs(blocks: DataFrame, packs: DataFrame) -> DataFrame:
    """(shard, numbers, asked, kth): for each shard the queries of a block whose kth score its box can reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                queries, bounds = box_bounds(row)
                numbers, done = (np.array([q[c] for q in row["queries"]], np.int64) for c in ("number", "done"))
                kth = np.array([-NO_ID if q["kth"] is None else q["kth"] for q in row["queries"]], np.int64)
                shards = np.array(row["shards"], np.int64)
                reached = (bounds >= kth[:, None]) & (shards[None, :] != done[:, None])
                for column in np.flatnonzero(reached.any(0)):
                    at = np.flatnonzero(reached[:, column])
                    blobs = [pa.array([x[at].tobytes()], pa.binary()) for x in (numbers, queries, kth)]
                    yield pa.RecordBatch.from_arrays([pa.array(shards[[column]]), *blobs], names=["shard", "numbers", "asked", "kth"])

    return blocks.join(packs, ["width", "pack"]).mapInArrow(run, WORK)


def seed_work(asked: DataFrame, queries: int, block: int) -> DataFrame:
    """The queries by the one shard they are to search first, in the form of :func:`open_pairs`."""

    def run(table: pa.Table) -> pa.Table:
        numbers = table.column("number").to_numpy().astype("<i8")
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<i8")
        blobs = [numbers, flat, np.full(len(numbers), -NO_ID)]
        return pa.table([pa.array([table.column("shard")[0].as_py()], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in blobs]],
                        names=["shard", "numbers", "asked", "kth"])

    salt = F.pmod(F.xxhash64(F.lit("seed"), "number"), F.lit(max(-(-queries // block), 1)))
    return asked.withColumn("salt", salt).groupBy("shard", "salt").applyInArrow(run, WORK)


def search(trees: DataFrame, work: DataFrame, k: int) -> DataFrame:
    """(query, vec_id, number, score): the best ``k`` rows of a shard for its queries, none worse than the kth known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if held != row["shard"]:
                    tree = Tree(matrix(row["vectors"], row["width"]), longs(row["ids"]), longs(row["own"]))
                    held = row["shard"]
                queries = matrix(row["asked"], row["width"])
                bounds, out = tree.bounds(queries), []
                for own, query, bound, floor in zip(longs(row["numbers"]).tolist(), queries, bounds, longs(row["kth"]).tolist(), strict=True):
                    # stand-ins with ids beyond all others: ties with the kth known stay open
                    best = [(floor, -(1 << 64), 0)] * k if floor > -NO_ID else []
                    tree.search(own, query, bound, best, k)
                    out += [(own, -vec, -number, score) for score, vec, number in best if vec != -(1 << 64)]
                if out:
                    columns = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "vec_id", "number", "score"])

    shards = trees.select("shard", "width", "ids", F.col("numbers").alias("own"), "vectors")
    joined = shards.join(work, "shard").select("shard", "width", "ids", "own", "vectors", "numbers", "asked", "kth")
    return joined.mapInArrow(run, "query long, vec_id long, number long, score long")


def top_k(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    shard_rows: int = SHARD_ROWS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The ``k`` highest inner products of each query with all other rows: (query_id, rank, vec_id, score).

    Input: vec_id, embedding. Vectors become whole numbers by :func:`whole_vectors`; those that it
    leaves out take no part, and vectors of another length than the query's are no candidates for
    it. Queries are the rows whose vec_id is divisible by ``every``; each row is a query and a candidate of its own,
    also where ids repeat, and only the query's own row is left out. Ties go to the smaller vec_id, null
    ids last; with fewer than ``k`` candidates all are returned. An empty table gives no rows.

    Rows are dealt to shards of about ``shard_rows`` by median splits of a bounded sample, crowded cells by their
    numbers too, so that no vector, however common, makes a large shard; each shard is a KD-tree. A query first
    searches the shard whose box reaches highest. Its kth score there is compared with all other boxes, and only
    the pairs of query and shard that are still open are joined; the score goes along and prunes from the start.
    """
    spark = vectors.sparkSession
    whole = materialise(whole_vectors(vectors).withColumn("number", F.monotonically_increasing_id()), "vectors")
    is_query = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    n, n_queries = whole.agg(F.count("*"), F.count_if(is_query)).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    placed = materialise(dealt(whole, n, shard_rows), "cells")
    parts = small_side(placed.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts")))
    part = F.pmod(F.xxhash64("number"), F.col("parts"))
    # cells and parts are numbered below 2^31
    shards = placed.join(parts, "cell").withColumn("shard", F.shiftleft(F.col("cell"), 31) + part)
    trees = materialise(packed(shards.select("shard", "vec_id", "number", "v"), "shard"), "shards")
    packs = -(-trees.count() // PACK_SHARDS)
    blocks = -(-n_queries // query_block)
    boxes = materialise(packs_of(trees, packs), "boxes")
    queries = whole.where(is_query)
    none = {"kth": F.lit(None).cast("long"), "done": F.lit(None).cast("long")}
    first = best_shards(query_blocks(queries.withColumns(none), blocks, packs), boxes)
    asked = materialise(queries.join(first, "number"), "queries")
    seed = materialise(search(trees, seed_work(asked.select("shard", "number", "v"), n_queries, query_block), k), "seed")
    reached = seed.groupBy(F.col("query").alias("number")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    primed = asked.join(reached, "number", "left").withColumns(
        {"kth": F.when(F.col("n") >= k, F.col("least")), "done": F.col("shard")}
    )
    rest = search(trees, open_pairs(query_blocks(primed, blocks, packs), boxes), k)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "number")
    ranked = seed.unionByName(rest).withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    names = asked.select(F.col("number").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query").select(
        "query_id", "rank", F.nullif(F.col("vec_id"), F.lit(NO_ID)).alias("vec_id"), "score"
    )
