"""Shared pieces: reading tables, folds by checksum, Arrow tokenising and row-wise column appends."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text handled at once inside a task, in bytes; a single longer text is handled alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the value written as text, modulo ``modulus``; null for null."""
    return F.crc32(F.col(column).cast("string")) % modulus


def held_out(column: str, modulus: int, rest: int) -> Column:
    """Whether the row belongs to the held-out fold; a null key never does."""
    return F.coalesce(remainder(column, modulus) == rest, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts come to about ``limit`` bytes."""
    ends = np.cumsum(text_bytes(batch.column(column)), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        used = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, used + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def words(texts: pa.Array, as_array: bool = False) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words between ASCII white space: code of each word, the distinct words, words per text.

    Null texts have no words. Codes follow the order of the texts. The distinct words are a list, or
    an Arrow array with ``as_array``.
    """
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)[real]
    counts = np.bincount(owner[real], minlength=len(parts)).astype(np.int64)
    return codes, coded.dictionary if as_array else coded.dictionary.to_pylist(), counts


def release_memory() -> None:
    """Give freed memory back to the system at the end of a task: its Python worker stays and waits for the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offset of each run of ``counts`` items, with the end of the last one."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def ragged(lengths: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Positions of the runs ``picks`` laid end to end, for runs of ``lengths`` stored one after another."""
    offsets, sizes = starts_of(lengths)[:-1][picks], lengths[picks]
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets - (ends - sizes), sizes)


def distinct_of(values: np.ndarray) -> np.ndarray:
    """Distinct values in order, by sorting."""
    v = np.sort(values)
    return v[np.concatenate([[True], v[1:] != v[:-1]])] if len(v) else v


def run_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``counts`` values; empty runs give 0."""
    totals = np.concatenate([[0], np.cumsum(values)])
    bounds = starts_of(counts)
    return totals[bounds[1:]] - totals[bounds[:-1]]


def append_columns(
    df: DataFrame,
    column: str,
    fields: list[T.StructField],
    compute: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``df`` with new columns computed from the texts in ``column``.

    ``compute`` is called once per task and gives the function from texts to arrays.
    A column of the same name is replaced; all others pass through unchanged.
    """
    base = df.drop(*[f.name for f in fields if f.name != column])
    schema = T.StructType([*base.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = compute()
        for batch in batches:
            for part in slices(batch, column, limit):
                new = apply(part.column(column))
                names = [*part.schema.names, *[f.name for f in fields]]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=names)
        release_memory()

    return base.mapInArrow(run, schema)


def shielded(
    docs: DataFrame, needed: tuple[str, ...], apply: Callable[[DataFrame], DataFrame], new: tuple[str, ...] = ()
) -> DataFrame:
    """``apply`` on ``docs``, whose columns other than ``needed`` have neutral names meanwhile.

    So no column clashes with one that ``apply`` makes for itself. The result has the columns of ``docs``, but for
    those that ``new`` replaces, and then the ``new`` ones.
    """
    names = {c: f"kept_{i}" for i, c in enumerate(docs.columns) if c not in needed}
    out = apply(docs.select(*[F.col(f"`{c.replace('`', '``')}`").alias(names.get(c, c)) for c in docs.columns]))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns if c not in new], *new)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int) -> DataFrame:
    """At most ``bound`` labelled training texts as (doc_id, text, label), the ids drawn by hash.

    ``train`` is a condition on doc_id. A doc_id with several labels takes the largest;
    null ids and null labels take no part. The drawn ids are at most ``bound``, which is
    what makes sending them to every executor safe; each gives one text, the least, however
    often it is repeated.
    """
    drawn = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & train)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def drawn_by_key(df: DataFrame, key: str, value: str, order: list[Column], bound: int) -> DataFrame:
    """(key, value) of at most ``bound`` distinct keys, the first in ``order``: the least value of each.

    Bounded however often a key is repeated: the keys are reduced before the limit, and a common
    key leaves every task as one row.
    """
    keys = df.select(key).distinct().orderBy(*order).limit(bound)
    return df.select(key, value).join(F.broadcast(keys), key).groupBy(key).agg(F.min(value).alias(value))


def one_task(df: DataFrame, order: list[Column]) -> DataFrame:
    """A bounded sample brought to one task, in a fixed order."""
    return df.repartition(1).sortWithinPartitions(*order)
