"""Packing by power-of-two decomposition."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from odflow.llm.bpe import ENCODED_BYTES, new_encoder
from odflow.llm.common import ragged, release_memory, slices, starts_of

# A sequence id: bucket, partition, count within both.
BUCKET_SHIFT, PARTITION_SHIFT = 56, 32
PIECES = (
    "start long, length long, ids array<int>, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def binary_lengths(total: int, longest: int) -> list[int]:
    """``total`` as whole ``longest`` pieces followed by the powers of two of the rest, large first."""
    rest = total % longest
    return [longest] * (total // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_power_of_two(
    docs: DataFrame, tokenizer_path: str, longest: int = 2048, end_id: int = 1, id_column: str = "doc_id"
) -> DataFrame:
    """Each document cut into pieces of binary length, in buckets of equal length; every piece is a sequence.

    Input: ``id_column`` and ``text``; other columns are ignored. A document is the ids of its
    text followed by ``end_id``. It becomes ``total // longest`` pieces of ``longest`` ids (a power
    of two), then one piece for each binary digit of the rest, so a sequence never crosses
    documents and no sequence needs padding. Sequences are numbered by bucket: sequence_id holds the
    binary logarithm of the length, then the partition, then a count within both, so a range of ids is
    a bucket and ids rise with the length. Each run of rows comes out ordered by bucket, and
    :func:`write_buckets` gives each bucket a folder. Output: the id, start, length, ids, ids_crc32
    (little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset (always 0).

    Null and empty texts hold the end id alone. Repeated rows and null ids give pieces of their own.
    The numbers need no shuffle and stay the same when a task is run again over the same files.
    An empty table gives no rows.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = new_encoder(tokenizer_path)
        partition = TaskContext.get().partitionId() << PARTITION_SHIFT
        numbered = np.zeros(64, np.int64)  # sequences so far, by bucket
        for batch in batches:
            for part in slices(batch, "text", ENCODED_BYTES):
                text_ids, counts = encoder.encode(part.column("text"))
                ids, totals = np.insert(text_ids, starts_of(counts)[1:], end_id), counts + 1
                cuts = [binary_lengths(int(n), longest) for n in totals]
                pieces = np.fromiter(map(len, cuts), np.int64, len(cuts))
                lengths = np.fromiter((n for c in cuts for n in c), np.int64, int(pieces.sum()))
                bucket = np.frexp(lengths)[1].astype(np.int64) - 1
                order = np.argsort(bucket, kind="stable")
                owner = np.repeat(np.arange(len(cuts)), pieces)[order]
                starts = starts_of(lengths)[:-1][order] - starts_of(totals)[owner]
                ids, lengths, bucket = ids[ragged(lengths, order)], lengths[order], bucket[order]
                held = np.bincount(bucket, minlength=64)
                number = np.arange(len(bucket)) + (numbered - starts_of(held)[:-1])[bucket]
                numbered += held
                bounds = starts_of(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(id_column).take(pa.array(owner)),
                        pa.array(starts),
                        pa.array(lengths),
                        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
                        pa.array(sums, pa.int64()),
                        pa.array(totals[owner]),
                        pa.array((bucket << BUCKET_SHIFT) + partition + number),
                        pa.array(np.zeros(len(lengths), np.int64)),
                    ],
                    names=[id_column, "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )
        release_memory()

    return docs.select(id_column, "text").mapInArrow(run, f"`{id_column}` {id_type}, {PIECES}")


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences with one folder per length, so that a batch is read from one bucket."""
    packed.write.partitionBy("length").parquet(path)
