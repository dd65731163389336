"""N-gram Jaccard join: MinHash banding, candidate groups, and exact checks on full n-gram sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odflow.llm.common import distinct_of, release_memory, shielded, slices, starts_of, words
from odflow.session import materialise, small_side

WIDTH = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 6
#: Texts compared with each other in one piece of work; larger groups are cut into tiles.
BLOCK = 512
COLUMNS_AT_ONCE = 8192
ODD = np.uint64(0x9E3779B97F4A7C15)
STIR = np.uint64(0xC2B2AE3D27D4EB4F)


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` hashes so that a pair at ``threshold`` meets in one with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text as sorted 64-bit hashes, end to end, and how many each has.

    A text of fewer words than ``width`` has one n-gram, all its words; one without words has none.
    """
    codes, distinct, counts = words(texts)
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct] or [0], np.uint64)
    h = table[codes]
    bounds = starts_of(counts)
    sets = []
    rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = rolled * ODD + h[k : k + len(rolled)]
    rolled = stirred(rolled)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            sets.append(distinct_of(rolled[a : b - width + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                short = short * ODD + x
            sets.append(stirred(short))
        else:
            sets.append(rolled[:0])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate([rolled[:0], *sets]), sizes


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * STIR
    return x ^ (x >> np.uint64(29))


def band_keys(shingles: np.ndarray, sizes: np.ndarray, bands: int, rows: int, seed: int = 17) -> np.ndarray:
    """One key for each band of each text that has n-grams: its ``rows`` MinHash values and the band's number."""
    g = np.random.default_rng(seed)
    xors = g.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    factors = g.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    first = starts_of(sizes[sizes > 0])[:-1]
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    keys = np.empty((len(first), bands), np.int64)
    for band in range(bands):
        key = np.full(len(first), band + 1, np.uint64)
        for j in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat((low ^ xors[j]) * factors[j], first) if len(first) else key
            key = stirred(key * ODD + least.astype(np.uint64))
        keys[:, band] = key.view(np.int64)
    return keys


def sketched(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """``docs`` with _row (a number of its own), _mark (digest of the n-gram set, null without words) and _bands."""
    extra = [
        T.StructField("_row", T.LongType()),
        T.StructField("_mark", T.BinaryType()),
        T.StructField("_bands", T.ArrayType(T.LongType())),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                shingles, sizes = shingle_sets(part.column("text"), width)
                bounds = starts_of(sizes)
                keys = band_keys(shingles, sizes, bands, rows)
                marks = [hashlib.md5(shingles[a:b].tobytes()).digest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                offsets = starts_of(np.where(sizes > 0, bands, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array(np.arange(len(sizes)) + row),
                        pa.array(marks, pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel())),
                    ],
                    names=[*part.schema.names, "_row", "_mark", "_bands"],
                )
                row += len(sizes)
        release_memory()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *extra]))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b): root is the smallest node of its component, itself included.

    Large and small stars in turn: every node hands its larger, then its smaller neighbours to the
    smallest of them, until nothing changes. Each round is a few joins on nodes, and its result
    is written, so the lineage stays short.
    """
    stars = materialise(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "stars",
    )
    state = fingerprint(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where(F.col("a") != F.col("b")).distinct(), "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        stars = materialise(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "stars")
        before, state = state, fingerprint(stars)
        if state == before:
            break
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def fingerprint(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the rows."""
    number = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(number)).first())


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each text of ``left`` and each of ``right`` (positions in ``sets``) reach the Jaccard threshold."""
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    v, owner = values[order], owner[order]
    new = np.concatenate([[True], v[1:] != v[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1  # an n-gram of one text joins no pair
    owner, column = owner[shared], column[shared]
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
    both = np.zeros((len(left), len(right)), np.float32)
    for top in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_AT_ONCE):
        span = slice(*np.searchsorted(column, [top, top + COLUMNS_AT_ONCE]))
        cells = np.zeros((len(sets), min(COLUMNS_AT_ONCE, int(column[-1]) + 1 - top)), np.float32)
        cells[owner[span], column[span] - top] = 1
        both += cells[left] @ cells[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    return both / union >= threshold


def roots_of(links: np.ndarray) -> np.ndarray:
    """Smallest position of the component of each position, for a symmetric matrix of links."""
    label = np.arange(len(links))
    while True:
        best = np.where(links, label[None, :], len(links)).min(1, initial=len(links))
        new = np.minimum(label, best)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def checked_links(work: DataFrame, width: int, threshold: float) -> DataFrame:
    """(node, root, linked): each text's component within a piece of work, and the rows it links to there.

    ``work``: unit, comp, i, j, block, node, copies, text. A piece is a candidate group or a tile
    of one, and a unit holds one tile or some whole small groups. Tile (i, j) compares block i
    with block j, so every pair of a group is compared once.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks()
        shingles, sizes = shingle_sets(rows.column("text").combine_chunks(), width)
        sets = np.split(shingles, starts_of(sizes)[1:-1])
        nodes, copies = rows.column("node").to_pylist(), rows.column("copies").to_numpy()
        block, i, j = (rows.column(c).to_numpy() for c in ("block", "i", "j"))
        pieces: dict[tuple, list[int]] = {}
        for k, key in enumerate(zip(rows.column("comp").to_pylist(), i.tolist(), j.tolist(), strict=True)):
            pieces.setdefault(key, []).append(k)
        out: list[tuple] = []
        for (_, left_block, right_block), members in pieces.items():
            at = np.array(members)
            left = np.flatnonzero(block[at] == left_block)
            right = np.flatnonzero(block[at] == right_block)
            own = linked([sets[k] for k in members], left, right, threshold)
            full = np.zeros((len(at), len(at)), bool)
            full[np.ix_(left, right)] = own
            full |= full.T
            np.fill_diagonal(full, False)
            total = full @ copies[at]
            root = roots_of(full)
            out += [(nodes[k], nodes[members[r]], int(n)) for k, r, n in zip(members, root, total, strict=True)]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["node", "root", "linked"])

    return work.groupBy("unit").applyInArrow(run, "node long, root long, linked long")


def jaccard_join(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    width: int = WIDTH,
    recall: float = RECALL,
    rows: int = ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """``docs`` with class_id, n_links and stays.

    Two documents are linked if the Jaccard similarity of their sets of ``width``-word n-grams is at
    least ``threshold``. n_links counts the other rows a row is linked to, and a class is a connected
    component; class_id is its smallest doc_id, and exactly one row of a class stays: that of the
    smallest id, nulls last.

    1. Documents of one n-gram set (by the digest of the set) are one text with a number of copies;
    the first of their row numbers stands for it from here on. 2. MinHash bands: texts that share a band are candidates; bands follow
       from ``recall``, the chance that a pair just at the threshold shares one. 3. Candidates form
       groups, found through the smallest member of each band's bucket, so no pairs are listed. 4. In
       each group all pairs are compared on full sets, in tiles of ``block`` texts for large groups;
       a task returns a row per text, not per link. 5. Components of true links are the classes.

    Input: doc_id, text and any others, all kept (columns named as the new ones are replaced).
    Texts of fewer than ``width`` words have one n-gram, all their words. Texts without words (null and
    empty ones) are linked to nothing, and each stays. Repeated rows are copies of each other. A class
    whose ids are all null has a null class_id. An empty table gives no rows.
    """
    joined = lambda df: _jaccard_join(df, threshold, width, recall, rows, block)
    return shielded(docs, ("doc_id", "text"), joined, ("class_id", "n_links", "stays"))


def _jaccard_join(base: DataFrame, threshold: float, width: int, recall: float, rows: int, block: int) -> DataFrame:
    bands = bands_for(threshold, recall, rows)
    all_rows = materialise(sketched(base, width, bands, rows), "sketches")
    texts = materialise(
        all_rows.where(F.col("_mark").isNotNull())
        .groupBy(F.col("_mark").alias("mark"), F.col("_bands").alias("bands"))
        .agg(F.count("*").alias("copies"), F.min("_row").alias("node")),
        "texts",
    )
    keys = texts.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")
    pairs = keys.join(buckets, "key").where(F.col("node") != F.col("leader"))
    groups = materialise(components(pairs.select(F.col("node").alias("a"), F.col("leader").alias("b"))), "groups")
    sizes = groups.groupBy("root").agg(F.count("*").alias("m"))
    members = (
        groups.join(sizes, "root")
        .join(texts.select("node", "copies"), "node")
        .withColumn("parts", F.ceil(F.col("m") / block).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.col("root").alias("comp"), "node", "copies", "block", "parts",
            F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        )
    )
    members = materialise(members, "members")
    spread = max(members.count() // block, 1)
    unit = F.when(F.col("parts") > 1, F.xxhash64("comp", "i", "j")).otherwise(F.pmod(F.xxhash64("comp"), F.lit(spread)))
    wanted = small_side(members.select("node").distinct())
    full = all_rows.join(wanted, F.col("_row") == F.col("node"), "left_semi").select("_row", "text")
    work = members.join(full, F.col("node") == F.col("_row")).select(
        unit.alias("unit"), "comp", "i", "j", "block", "node", "copies", "text"
    )
    found = materialise(checked_links(work, width, threshold), "links")
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("linked").alias("linked")).where(F.col("linked") > 0)
    info = (
        texts.select("mark", "node", "copies")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .where((F.col("copies") > 1) | F.col("linked").isNotNull())
        .select("mark", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("links"))
    )
    info = small_side(info)
    known = all_rows.drop("_bands").join(info, F.col("_mark") == F.col("mark"), "left").drop("mark", "_mark")
    own = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    heads = all_rows.select("doc_id", "_row", "_mark").join(info, F.col("_mark") == F.col("mark")).groupBy("root").agg(
        F.min("doc_id").alias("head_id"), F.min(own).getField("_row").alias("head_row")
    )
    heads = small_side(heads.withColumnRenamed("root", "head"))
    alone = F.col("root").isNull()
    return known.join(heads, F.col("root") == F.col("head"), "left").select(
        *base.columns,
        F.when(alone, F.col("doc_id")).otherwise(F.col("head_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        (alone | (F.col("_row") == F.col("head_row"))).alias("stays"),
    )
