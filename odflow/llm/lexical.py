"""Ranked lexical search: term-at-a-time scoring with a limited set of accumulators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odflow.llm.common import SLICE_BYTES, slices, starts_of, words
from odflow.session import materialise

#: Query terms looked up in one pass over the documents; more items are taken in further passes.
BLOCK_TERMS = 200_000
#: Postings that a task indexes at once.
SHARD_POSTINGS = 2_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: For each byte: lower-cased if it belongs to a term, else a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def distinct_terms(text: str) -> Column:
    """The different terms of a text; none for null."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(F.translate(text, UPPER, LOWER), F.lit("")), F.lit(TERM), F.lit(0)))


def folded(texts: pa.Array) -> pa.Array:
    """The texts with terms lower-cased in A to Z and everything between them turned into spaces."""
    texts = texts.fill_null("") if texts.null_count else texts
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = bytes(texts.buffers()[2] or b"")[bounds[0] : bounds[-1]].translate(FOLD)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((bounds - bounds[0]).tobytes()), pa.py_buffer(data))


def term_hits(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, codes, tfs) of documents with a term: its length, and the terms of ``vocabulary`` in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        known = pa.array(vocabulary, pa.string())
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                codes, distinct, counts = words(folded(part.column("text")), as_array=True)
                code = pc.fill_null(pc.index_in(distinct, value_set=known), -1).to_numpy(zero_copy_only=False)[codes]
                doc = np.repeat(np.arange(len(counts)), counts)
                hit = code >= 0
                pair, tf = np.unique(doc[hit].astype(np.int64) * len(vocabulary) + code[hit], return_counts=True)
                found = np.bincount(pair // max(len(vocabulary), 1), minlength=len(counts))
                offsets = pa.array(starts_of(found), pa.int32())
                out = pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(counts),
                        pa.ListArray.from_arrays(offsets, pa.array(pair % max(len(vocabulary), 1), pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32())),
                    ],
                    names=["doc_id", "n", "codes", "tfs"],
                )
                yield out.filter(pa.array(counts > 0))

    return docs.mapInArrow(run, "doc_id long, n long, codes array<int>, tfs array<int>")


class Shard:
    """Postings of some documents by term, with the points that each gives.

    Documents are numbered by id, so that equal scores are settled by the number. ``peak`` is the most
    points that a term gives to any document here.
    """

    def __init__(self, ids, absent, n, counts, codes, tfs, weights: np.ndarray, total: int, length: int):
        self.order = np.lexsort((ids, absent))  # null ids last
        self.ids, self.absent = ids[self.order], absent[self.order]
        place = np.empty(len(ids), np.int64)
        place[self.order] = np.arange(len(ids))
        doc = np.repeat(place, counts)
        m = (100 - 90 + (90 * n * total) // length)[self.order]
        tf = tfs.astype(np.int64)
        points = weights[codes] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        by_term = np.lexsort((doc, codes))
        codes, self.doc, self.points = codes[by_term], doc[by_term], points[by_term]
        self.bounds = np.searchsorted(codes, np.arange(len(weights) + 1))
        self.peak = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(np.diff(self.bounds))
        if len(held):
            self.peak[held] = np.maximum.reduceat(self.points, self.bounds[held])
        self.sums = np.zeros(len(ids), np.int64)
        self.open = np.zeros(len(ids), bool)

    def search(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents here and their points, for terms from the rarest to the most frequent.

        A document gets an accumulator at the first of its terms, as long as the terms from there on could
        still lift it to the kth partial score (or ``least``, the kth score known elsewhere). After that no
        accumulator is made: the remaining postings are looked up for the documents that have one. Also
        returns the number of accumulators.
        """
        terms = terms[self.peak[terms] > 0]
        rest = np.cumsum(self.peak[terms][::-1])[::-1]
        made: list[np.ndarray] = []
        count, survivors = 0, None
        for term, reach in zip(terms.tolist(), rest.tolist(), strict=True):
            a, b = self.bounds[term], self.bounds[term + 1]
            docs, points = self.doc[a:b], self.points[a:b]
            if survivors is None and (reach < least or (count >= k and reach < self.kth(made, k))):
                survivors = np.sort(np.concatenate(made)) if made else np.zeros(0, np.int64)
            if survivors is None:
                fresh = docs[~self.open[docs]]
                self.open[fresh] = True
                made.append(fresh)
                count += len(fresh)
                self.sums[docs] += points
            elif len(survivors) * 8 < len(docs):
                at = np.minimum(np.searchsorted(docs, survivors), len(docs) - 1)
                same = docs[at] == survivors
                self.sums[survivors[same]] += points[at[same]]
            else:
                have = self.open[docs]
                self.sums[docs[have]] += points[have]
        if survivors is None:
            survivors = np.concatenate(made) if made else np.zeros(0, np.int64)
        sums = self.sums[survivors]
        self.sums[survivors], self.open[survivors] = 0, False
        good = sums > 0
        survivors, sums = survivors[good], sums[good]
        top = np.lexsort((survivors, -sums))[:k]
        return survivors[top], sums[top], count

    def kth(self, made: list[np.ndarray], k: int) -> int:
        """The kth partial score so far."""
        sums = self.sums[np.concatenate(made)]
        return int(np.partition(sums, len(sums) - k)[len(sums) - k])


def search_block(hits: DataFrame, queries: list[np.ndarray], weights: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each item in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int]]] = [[] for _ in queries]  # (-score, id is null, id), best first

        def index(parts: list[pa.RecordBatch]) -> None:
            held = pa.Table.from_batches(parts).combine_chunks()
            lists = [held.column(c).combine_chunks() for c in ("codes", "tfs")]
            sizes = np.diff(lists[0].offsets.to_numpy())
            codes, tfs = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            doc_ids = held.column("doc_id").combine_chunks()
            absent = doc_ids.is_null().to_numpy(zero_copy_only=False)
            shard = Shard(
                doc_ids.fill_null(0).to_numpy(zero_copy_only=False), absent, held.column("n").to_numpy(), sizes, codes, tfs,
                weights, total, length,
            )
            for item, terms in enumerate(queries):
                known = best[item]
                docs, scores, _ = shard.search(terms, k, -known[-1][0] if len(known) == k else 0)
                if len(docs):
                    found = zip((-scores).tolist(), shard.absent[docs].tolist(), shard.ids[docs].tolist(), strict=True)
                    best[item] = sorted([*known, *found])[:k]

        parts, held = [], 0
        for batch in batches:
            parts.append(batch)
            held += len(batch.column("codes").flatten())
            if held >= SHARD_POSTINGS:
                index(parts)
                parts, held = [], 0
        if parts:
            index(parts)
        rows = [(item, None if absent else doc, -score) for item, top in enumerate(best) for score, absent, doc in top]
        if rows:
            columns = zip(*rows, strict=True)
            types = (pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item", "doc_id", "score"])

    return hits.mapInArrow(run, "item int, doc_id long, score long")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """For each item the k documents of highest score: item_id, rank (from 1), doc_id, score.

    ``docs`` has doc_id and text, ``items`` item_id and text. Terms are the runs of letters and digits of ASCII and
    of characters beyond ASCII, A to Z lower-cased. A term in df of N documents weighs
    ``floor(1000 * ln((2 N + 2) / (2 df + 1)))``; a document with n of all L terms has
    ``m = 10 + (90 n N) div L`` and gets ``w * ((10^9 tf) div (1000 tf + 8 m))`` for each of the item's terms that it
    holds tf times. Scores of 0 are left out; equal scores go by ascending doc_id.

    Two passes over the documents for a block of items: the first counts terms and keeps the postings of the items'
    terms, the second scores them in shards, rarest term first (:meth:`Shard.search`), and only the k best
    of each item leave a task. A block holds about ``block_terms`` terms, whatever the number of items; those
    terms are what is sent to every task.

    Null and empty texts hold no terms: such a document counts nowhere, such an item has no rows. Every row of
    ``docs`` is a document of its own, also where ids repeat or are null (null ids come last among equals). Equal
    rows of ``items`` are one item; the same item_id with another text is ranked on its own. Empty tables give
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = items.select("item_id", "text").distinct().select("item_id", F.xxhash64("item_id", "text").alias("hash"), distinct_terms("text").alias("terms"))
    wanted = materialise(wanted.where(F.size("terms") > 0), "items")
    blocks = -(-(wanted.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    id_type = items.schema["item_id"].dataType
    out = spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id long, score long")
    results = []
    for b in range(blocks):
        rows = wanted.where(F.pmod("hash", F.lit(blocks)) == b).orderBy("item_id", "hash").collect()
        if rows:
            results.append(materialise(_ranked_block(texts, rows, id_type, k), "ranked"))
    for ranked in results:
        out = out.union(ranked)
    return out


def _ranked_block(texts: DataFrame, rows: list, id_type, k: int) -> DataFrame:
    spark = texts.sparkSession
    vocabulary = sorted({t for r in rows for t in r["terms"]})
    number = {t: i for i, t in enumerate(vocabulary)}
    hits = materialise(term_hits(texts, vocabulary), "hits")
    total, length = hits.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = hits.select(F.explode("codes").alias("code")).groupBy("code").count().collect()  # a row for each query term
    weights = np.zeros(len(vocabulary), np.int64)
    for code, df in held:
        weights[code] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
    queries = []
    for r in rows:
        codes = np.array([number[t] for t in r["terms"]])
        queries.append(codes[np.lexsort((codes, -weights[codes]))])
    found = search_block(hits, queries, weights, total, length, k)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {id_type.simpleString()}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
