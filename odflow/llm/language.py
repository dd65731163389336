"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odflow.llm.common import append_columns, slices, starts_of

DIMENSION = 1024
ORDER = 3
UNDETERMINED = "und"
#: Prototypes are sent to every executor: languages x dimension x 4 bytes, 16 MB at most.
MOST_LANGUAGES = 4096
COLUMNS_AT_ONCE = 2048
ROWS_AT_ONCE = 256
UNIT = 1 << 16


class GramSpace:
    """Vectors of letter n-grams: random letter vectors, rotated by place and multiplied."""

    def __init__(self, dimension: int = DIMENSION, order: int = ORDER, seed: int = 7):
        self.dimension, self.order, self.seed = dimension, order, seed
        self.letters: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            signs = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimension)
            self.letters[code] = (2 * signs - 1).astype(np.float32)
        return self.letters[code]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """One row per n-gram; ``grams`` has the code points of each."""
        out = np.ones((len(grams), self.dimension), np.float32)
        for place in range(self.order):
            codes, at = np.unique(grams[:, place], return_inverse=True)
            turned = np.stack([np.roll(self.letter(int(c)), place) for c in codes]) if len(codes) else out[:0]
            out *= turned[at]
        return out

    def grams(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams, the n-gram of each position and the positions of each text.

        Texts are lower-cased; every run of characters that are no letters becomes one space,
        and a space stands before and behind, so n-grams see the ends of words.
        """
        low = pc.utf8_lower(pc.fill_null(texts, ""))
        lengths = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64) + 2
        joined = " " + "  ".join(low.to_pylist()) + " "
        raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) if len(low) else np.empty(0, np.uint32)
        raw = np.where(letter_table()[raw], raw, 32)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        keep = np.ones(len(raw), bool)
        keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32) | (owner[1:] != owner[:-1])
        raw, owner = raw[keep], owner[keep]
        used = np.zeros(CODE_POINTS, bool)
        used[raw] = True
        symbols = np.flatnonzero(used)
        number = np.zeros(CODE_POINTS, np.int64)
        number[symbols] = np.arange(len(symbols))
        code, places = number[raw], max(len(raw) - self.order + 1, 0)
        packed = np.zeros(places, np.int64)
        for place in range(self.order):
            packed = packed * len(symbols) + code[place : place + places]
        real = owner[:places] == owner[self.order - 1 :] if places else np.empty(0, bool)
        packed, whose = packed[real], owner[:places][real]
        kinds, at = numbered(packed, len(symbols) ** self.order)
        parts = np.empty((len(kinds), self.order), np.int64)
        rest = kinds
        for place in range(self.order - 1, -1, -1):
            parts[:, place] = symbols[rest % max(len(symbols), 1)]
            rest = rest // max(len(symbols), 1)
        return parts, at, np.bincount(whose, minlength=len(lengths))

    def bundles(self, texts: pa.Array) -> np.ndarray:
        """Sum of the n-gram vectors of each text."""
        parts, at, counts = self.grams(texts)
        n, bounds = len(counts), starts_of(counts)
        rows = np.repeat(np.arange(n), counts)
        out = np.zeros((n, self.dimension), np.float32)
        for left in range(0, len(parts), COLUMNS_AT_ONCE):
            vectors = self.vectors(parts[left : left + COLUMNS_AT_ONCE])
            for top in range(0, n, ROWS_AT_ONCE):
                span, height = slice(bounds[top], bounds[min(top + ROWS_AT_ONCE, n)]), min(ROWS_AT_ONCE, n - top)
                inside = (at[span] >= left) & (at[span] < left + len(vectors))
                cells = (rows[span][inside] - top) * len(vectors) + at[span][inside] - left
                table = np.bincount(cells, minlength=height * len(vectors)).reshape(height, len(vectors))
                out[top : top + height] += table.astype(np.float32) @ vectors
        return out


CODE_POINTS = 0x110000
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(CODE_POINTS)), bool, CODE_POINTS))
    return _letters[0]


def numbered(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the number of each value; a table if ``most`` is small."""
    if most > 1 << 24:
        return np.unique(values, return_inverse=True)
    used = np.zeros(most, bool)
    used[values] = True
    kinds = np.flatnonzero(used)
    number = np.zeros(most, np.int64)
    number[kinds] = np.arange(len(kinds))
    return kinds, number[values]


def language_profiles(docs: DataFrame, train: Column, space: GramSpace) -> tuple[list[str], np.ndarray]:
    """Languages and the bundles of their training texts, over all rows where ``train`` holds.

    Texts count alike whatever their length: each gives a vector of length UNIT, rounded. A task
    sends one vector per language; the sums are whole numbers, so their order does not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                coded = part.column("lang").dictionary_encode()
                names = coded.dictionary.to_pylist()
                bundles = space.bundles(part.column("text"))
                size = np.linalg.norm(bundles, axis=1, keepdims=True)
                whole = np.rint(bundles / np.maximum(size, 1e-30) * UNIT).astype(np.int64)
                which = coded.indices.to_numpy(zero_copy_only=False)
                for k, name in enumerate(names):
                    totals[name] = totals.get(name, 0) + whole[which == k].sum(0)
        for name, row in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(row)), pa.array(np.arange(len(row)), pa.int32()), pa.array(row)],
                names=["lang", "place", "value"],
            )

    sums = (
        docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("text", "lang")
        .mapInArrow(run, "lang string, place int, value long")
        .groupBy("lang", "place").agg(F.sum("value").alias("value"))
    )
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v"))
    found = rows.select("lang", F.col("v.value").alias("v")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values in lang")
    return [r.lang for r in found], np.array([r.v for r in found], np.float64).reshape(len(found), space.dimension)


def identify_language(
    docs: DataFrame, train: Column, dimension: int = DIMENSION, order: int = ORDER, seed: int = 7
) -> DataFrame:
    """``docs`` with lang_pred and score, learnt from the rows of ``docs`` where ``train`` holds.

    Letters have random vectors of +1 and -1, the same in every task. An n-gram is the product of
    its letters' vectors, each rotated by its place; a text is the sum over its n-grams, and a
    language the sum over its texts at equal length. The prediction is the language of the largest cosine, ties to the first by code
    point; score is that cosine, 0 where it is negative.

    Input: text, lang and any others, all kept (columns named as the new ones are replaced). Rows
    with null text or lang teach nothing. Null texts, texts without a letter and all texts if there
    is nothing to learn from get ``und`` and 0. Whole texts are read whatever their length.
    """
    space = GramSpace(dimension, order, seed)
    names, sums = language_profiles(docs, train, space)
    norms = np.linalg.norm(sums, axis=1, keepdims=True)
    shared = docs.sparkSession.sparkContext.broadcast((sums / np.maximum(norms, 1e-30)).astype(np.float32))

    def compute() -> Callable[[pa.Array], list[pa.Array]]:
        own, profiles = GramSpace(dimension, order, seed), shared.value

        def apply(texts: pa.Array) -> list[pa.Array]:
            if not names:
                return [pa.array([UNDETERMINED] * len(texts), pa.string()), pa.array(np.zeros(len(texts)))]
            bundles = own.bundles(texts)
            size = np.linalg.norm(bundles, axis=1)
            cosines = bundles @ profiles.T / np.maximum(size, 1e-30)[:, None]
            best = cosines.argmax(axis=1)
            known = size > 0
            score = np.where(known, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
            return [pa.array([names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], pa.string()), pa.array(score)]

        return apply

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return append_columns(docs, "text", fields, compute, 2 << 20)
