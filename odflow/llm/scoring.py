"""Language-model scoring: a log-bilinear model trained with noise-contrastive estimation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import run_sums, slices, starts_of, words
from odflow.session import materialise

#: The end of a text as a word; no word is empty.
END = ""
#: Words looked up inside tasks; all others are joined. Their table is bounded by this number.
HEAD_WORDS = 200_000
FLUSH_WORDS = 300_000
#: Tokens shuffled and stepped through at once; longer texts are dealt in pieces.
PIECE_TOKENS = 65_536
#: Averages are summed as whole numbers of this unit.
WHOLE = float(1 << 48)


@dataclass(frozen=True)
class LblRule:
    """``words`` frequent words and the end have symbols of their own, all others share ``classes``.

    Training tokens are dealt into shards of at least ``shard_tokens`` (all of them if there are fewer), at most
    ``most_shards``, so that the number of steps follows from the tokens and not from the files. In each of
    ``rounds`` the shards learn from their part of the tokens, all from the average of the round before.
    """

    words: int = 1000
    classes: int = 64
    width: int = 16
    noise: int = 24
    batch: int = 2048
    rate: float = 0.05
    seed: int = 11
    rounds: int = 4
    shard_tokens: int = 2_000_000
    most_shards: int = 2048


def folded_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words with A to Z lower-cased: codes, distinct words and words per text."""
    return words(pc.ascii_lower(pc.fill_null(texts, "")))


def word_counts(docs: DataFrame, train: Column) -> DataFrame:
    """(word, c) over all training texts, the end included, one partial count per task and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "c"])
            held.clear()
            return out

        for batch in batches:
            held[END] = held.get(END, 0) + batch.num_rows
            for part in slices(batch, "text"):
                codes, distinct, _ = folded_words(part.column("text"))
                for word, c in zip(distinct, np.bincount(codes, minlength=len(distinct)).tolist(), strict=True):
                    if c:
                        held[word] = held.get(word, 0) + c
                if len(held) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    partial = docs.where(train).select("text").mapInArrow(run, "word string, c long")
    return partial.groupBy("word").agg(F.sum("c").alias("c"))


def word_class(word: str, rule: LblRule) -> int:
    """Class of a word without a symbol of its own, by its last two characters."""
    return 1 + rule.words + zlib.crc32(word[-2:].encode()) % rule.classes


def class_column(rule: LblRule) -> Column:
    return F.crc32(F.substring("word", -2, 2)) % rule.classes + 1 + rule.words


class Symbols:
    """Symbols of words: 0 the end, then the frequent words, then the classes."""

    def __init__(self, frequent: list[str], rule: LblRule):
        self.rule = rule
        self.own = {w: i + 1 for i, w in enumerate(frequent)}
        self.size = 1 + rule.words + rule.classes

    def of(self, distinct: list[str]) -> np.ndarray:
        return np.array([self.own.get(w) or word_class(w, self.rule) for w in distinct] + [0], np.int64)

    def stream(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Word codes with the ends put in, tokens per text, symbols, place in the text, distinct words."""
        codes, distinct, counts = folded_words(texts)
        codes = np.insert(codes.astype(np.int64), starts_of(counts)[1:], len(distinct))
        counts = counts + 1
        place = np.arange(len(codes)) - np.repeat(starts_of(counts)[:-1], counts)
        return codes, counts, self.of(distinct)[codes], place, distinct


def contexts(symbols: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before each token and the one before that; the end stands before a text."""
    one, two = np.zeros_like(symbols), np.zeros_like(symbols)
    one[1:], two[2:] = symbols[:-1], symbols[:-2]
    one[place < 1], two[place < 2] = 0, 0
    return one, two


class LogBilinear:
    """Score of w after (a, b): (R[a] C1 + R[b] C2) . Q[w] + bias[w]."""

    def __init__(self, flat: np.ndarray, size: int, width: int):
        cuts = np.cumsum([size * width, size * width, width * width, width * width, size])
        r, q, c1, c2, bias = np.split(flat.astype(np.float32), cuts[:-1])
        self.r, self.q = r.reshape(size, width), q.reshape(size, width)
        self.c1, self.c2, self.bias = c1.reshape(width, width), c2.reshape(width, width), bias

    @classmethod
    def fresh(cls, noise: np.ndarray, rule: LblRule) -> LogBilinear:
        g, size, d = np.random.default_rng(rule.seed), len(noise), rule.width
        parts = [g.normal(0, 0.3, size * d), g.normal(0, 0.1, size * d), np.eye(d).ravel(), 0.5 * np.eye(d).ravel(), np.log(noise)]
        return cls(np.concatenate(parts), size, d)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.c1, self.c2, self.bias)])

    def step(self, a: np.ndarray, b: np.ndarray, w: np.ndarray, log_noise: np.ndarray, drawn: np.ndarray, rule: LblRule, squares: list[np.ndarray]) -> None:
        """One noise-contrastive step: tell each token from ``drawn``, noise shared by the batch."""
        k = len(drawn)
        ra, rb = self.r[a], self.r[b]
        hidden = ra @ self.c1 + rb @ self.c2
        qw, qn = self.q[w], self.q[drawn]
        data = np.einsum("ij,ij->i", hidden, qw) + self.bias[w] - log_noise[w] - np.float32(np.log(k))
        fake = hidden @ qn.T + (self.bias[drawn] - log_noise[drawn] - np.float32(np.log(k)))
        up = (1 - sigmoid(data)).astype(np.float32)
        down = -sigmoid(fake).astype(np.float32)
        d_hidden = up[:, None] * qw + down @ qn
        size = len(self.bias)
        g_q = scattered(w, up[:, None] * hidden, size)
        np.add.at(g_q, drawn, down.T @ hidden)
        g_bias = np.bincount(w, up, size) + np.bincount(drawn, down.sum(0), size)
        g_r = scattered(a, d_hidden @ self.c1.T, size) + scattered(b, d_hidden @ self.c2.T, size)
        grads = [g_r, g_q, ra.T @ d_hidden, rb.T @ d_hidden, g_bias]
        for value, g, s in zip((self.r, self.q, self.c1, self.c2, self.bias), grads, squares, strict=True):
            g = g / len(w)
            s += g * g
            value += (rule.rate * g / (np.sqrt(s) + 1e-6)).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 scores by (a, w) and (b, w), and log10 of the normaliser by (a, b), by matrix products."""
        first = (self.r @ self.c1) @ self.q.T + self.bias
        second = (self.r @ self.c2) @ self.q.T
        top, top2 = first.max(1, keepdims=True), second.max(1, keepdims=True)
        total = np.exp(first - top, dtype=np.float64) @ np.exp(second - top2, dtype=np.float64).T
        z = np.log(np.maximum(total, 1e-300)) + top + top2.T
        unit = np.log(10.0)
        return (first / unit).astype(np.float32), (second / unit).astype(np.float32), (z / unit).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scattered(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sum of ``rows`` by their place ``at``."""
    order = np.argsort(at, kind="stable")
    places = at[order]
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[places[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit numbers from consecutive ones (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def dealt_symbols(texts: DataFrame, symbols: Symbols, shards: int, rule: LblRule) -> DataFrame:
    """(round, shard, key, s): the symbols of each text after two ends, long texts in pieces that overlap by two.

    The key comes from the task and the place of the piece in it, so copies of a text are dealt like others, and
    a task that is run again deals alike.
    """
    shared = texts.sparkSession.sparkContext.broadcast(symbols)
    short = symbols.size < 1 << 15  # what is shuffled is mostly symbols
    kind, name = (np.int16, "smallint") if short else (np.int32, "int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = shared.value, 0
        task = np.uint64(TaskContext.get().partitionId() << 36)
        for batch in batches:
            for part in slices(batch, "text"):
                _, counts, s, _, _ = known.stream(part.column("text"))
                padded = np.insert(s, np.repeat(starts_of(counts)[:-1], 2), 0).astype(kind)
                pieces = -(-counts // PIECE_TOKENS)
                owner = np.repeat(np.arange(len(counts)), pieces)
                skip = (np.arange(len(owner)) - np.repeat(starts_of(pieces)[:-1], pieces)) * PIECE_TOKENS
                lengths = np.minimum(counts[owner] - skip, PIECE_TOKENS) + 2
                begin = starts_of(counts + 2)[:-1][owner] + skip
                take = np.arange(lengths.sum()) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
                key = mixed(task + np.arange(done, done + len(owner), dtype=np.uint64) + np.uint64(rule.seed))
                done += len(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((key % np.uint64(rule.rounds)).astype(np.int32)),
                        pa.array((key // np.uint64(rule.rounds) % np.uint64(shards)).astype(np.int32)),
                        pa.array(key.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(starts_of(lengths), pa.int32()), pa.array(padded[take])),
                    ],
                    names=["round", "shard", "key", "s"],
                )

    return texts.mapInArrow(run, f"round int, shard int, key long, s array<{name}>")


def train_lbl(docs: DataFrame, train: Column, symbols: Symbols, noise: np.ndarray, total: int, rule: LblRule) -> LogBilinear:
    """Parallel training over ``total`` tokens: rounds of steps in shards, then the mean of the shards by tokens.

    Every training token is learnt from once. The squared gradients that set the rates are averaged and handed on as
    the parameters are. Sums over shards are of whole numbers, so they do not depend on the order of arrival.
    """
    shards = max(1, min(rule.most_shards, total // rule.shard_tokens))
    spark = docs.sparkSession
    dealt = materialise(dealt_symbols(docs.where(train).select("text"), symbols, shards, rule), "symbols")
    start, size = LogBilinear.fresh(noise, rule), len(noise)
    state = np.concatenate([start.flat(), np.zeros(len(start.flat()), np.float32)]).astype(np.float64)
    for turn in range(rule.rounds):
        part = dealt.where(F.col("round") == turn).repartition(shards, "shard").sortWithinPartitions("shard", "key")
        sums = part.mapInArrow(shard_trainer(spark.sparkContext.broadcast(state), noise, total, turn, rule), "place int, value long")
        found = sums.groupBy("place").agg(F.sum("value").alias("value")).toPandas().sort_values("place")["value"].to_numpy()
        if len(found):
            state = state + found[1:] / max(found[0], 1)
    return LogBilinear(state[: len(state) // 2], size, rule.width)


def shard_trainer(shared, noise: np.ndarray, total: int, turn: int, rule: LblRule):
    """From rows ordered by shard to what each shard's training moved, times its share of the tokens, in whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, log_noise, edges = shared.value, np.log(noise).astype(np.float32), np.cumsum(noise)
        half = len(state) // 2

        class Shard:
            def __init__(self, number: int):
                self.model = LogBilinear(state[:half].copy(), len(noise), rule.width)
                squares = LogBilinear(state[half:].copy(), len(noise), rule.width)
                self.squares = [squares.r, squares.q, squares.c1, squares.c2, squares.bias]
                self.g = np.random.default_rng([rule.seed, turn, number])
                self.tokens, self.held, self.waiting = 0, 0, []

            def add(self, s: np.ndarray) -> None:
                self.waiting.append(s)
                self.held += len(s) - 2
                if self.held >= PIECE_TOKENS:
                    self.learn()

            def learn(self) -> None:
                if not self.waiting:
                    return
                w, one, two = (np.concatenate([s[2 - k : len(s) - k] for s in self.waiting]) for k in range(3))
                order = self.g.permutation(len(w))
                for i in range(0, len(w), rule.batch):
                    at = order[i : i + rule.batch]
                    drawn = np.minimum(np.searchsorted(edges, self.g.random(rule.noise)), len(noise) - 1)
                    self.model.step(one[at], two[at], w[at], log_noise, drawn, rule, self.squares)
                self.tokens += len(w)
                self.held, self.waiting = 0, []

            def result(self) -> pa.RecordBatch:
                self.learn()
                now = np.concatenate([self.model.flat(), *[x.ravel() for x in self.squares]]).astype(np.float64)
                share = self.tokens / max(total, 1) * WHOLE
                moved = np.rint(np.concatenate([[1.0], now - state]) * share).astype(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(now)), pa.int32()), pa.array(moved)], names=["place", "value"])

        number, shard = -1, None
        for batch in batches:
            numbers, lists = batch.column("shard").to_numpy(zero_copy_only=False), batch.column("s")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = starts_of(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            for k in range(batch.num_rows):
                if numbers[k] != number:
                    if shard:
                        yield shard.result()
                    number, shard = int(numbers[k]), Shard(int(numbers[k]))
                shard.add(flat[bounds[k] : bounds[k + 1]])
        if shard:
            yield shard.result()

    return run


def score_texts(docs: DataFrame, train: Column, rule: LblRule = LblRule(), head_words: int = HEAD_WORDS) -> DataFrame:
    """Per document: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score.

    Input: doc_id and text; other columns are ignored. Tokens are the words of the text with A to Z
    lower-cased, then one end. ``base_score`` is the add-one unigram log10 probability with the
    counts of all rows where ``train`` holds. ``score`` is that of the log-bilinear model: the
    symbol of a token is predicted from the two before it by a softmax over all symbols, normalised
    exactly; a word without a symbol of its own is then drawn within its class by add-one counts.
    Words never seen share one place of their class.

    Counts and training cover every training row; how well the model is trained follows from the number of
    tokens, not from how the table is split (see :class:`LblRule`). The ``head_words`` most frequent words (a bounded
    table) are looked up inside the tasks; the rest, rare by then, are joined by word. Null and empty
    texts hold the end alone. Repeated rows are scored alike and null ids are rows like others. With no
    training rows all words are unknown and the model is its start. An empty table gives no rows.
    """
    counts = materialise(word_counts(docs, train), "words")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ranked = counts.where(F.col("word") != END).orderBy(F.desc("c"), "word")
    head = [(r["word"], r["c"]) for r in ranked.limit(head_words).toLocalIterator()]
    frequent = [w for w, _ in head[: rule.words]]
    symbols = Symbols(frequent, rule)
    own = docs.sparkSession.createDataFrame([(w,) for w in [*frequent, END]], "word string")
    rare = counts.join(F.broadcast(own), "word", "left_anti").withColumn("symbol", class_column(rule))
    by_class = {r["symbol"]: (r["c"], r["v"]) for r in rare.groupBy("symbol").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()}
    ends = counts.where(F.col("word") == END).first()
    mass = np.ones(symbols.size)
    mass[0] += ends["c"] if ends else 0
    mass[1 : 1 + len(frequent)] += [c for _, c in head[: rule.words]]
    sizes = np.ones(symbols.size)  # what a class divides by: its tokens, its words and the unseen
    for s, (c, v) in by_class.items():
        mass[s] += c
        sizes[s] = c + v + 1
    model = train_lbl(docs, train, symbols, mass / mass.sum(), total, rule)
    base_total = float(total + kinds + 1)
    known = {**dict(head), END: ends["c"]} if ends else dict(head)
    shared = docs.sparkSession.sparkContext.broadcast((symbols, known, model.flat(), sizes))
    width = rule.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_symbols, count_of, flat, class_sizes = shared.value
        first, second, z = LogBilinear(flat, known_symbols.size, width).tables()
        first_class, key = 1 + known_symbols.rule.words, TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                codes, tokens, s, place, distinct = known_symbols.stream(part.column("text"))
                one, two = contexts(s, place)
                logp = (first[one, s] + second[two, s] - z[one, two]).astype(np.float64)
                c = np.array([count_of.get(w, 0) for w in distinct] + [count_of.get(END, 0)], np.float64)[codes]
                seen = c > 0
                classed = s >= first_class
                inner = np.where(classed & seen, np.log10((c + 1) / class_sizes[s]), 0.0)
                base = np.where(seen, np.log10((c + 1) / base_total), 0.0)
                tail = np.flatnonzero(~seen & (codes < len(distinct)))
                owner = np.repeat(np.arange(len(tokens)), tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(len(tokens)) + key),
                        part.column("doc_id"),
                        part.column("trained"),
                        pa.array(tokens),
                        pa.array(run_sums(seen.astype(np.int64), tokens)),
                        # the end counts as unknown where nothing was learnt
                        pa.array(run_sums(base, tokens) + (0.0 if count_of.get(END) else -np.log10(base_total))),
                        pa.array(run_sums(logp + inner, tokens)),
                        pa.ListArray.from_arrays(
                            pa.array(starts_of(np.bincount(owner[tail], minlength=len(tokens))), pa.int32()),
                            pa.array(distinct, pa.string()).take(pa.array(codes[tail])),
                        ),
                    ],
                    names=["key", "doc_id", "trained", "n_tokens", "known", "base", "model", "tail"],
                )
                key += len(tokens)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.select("doc_id", "text", train.alias("trained")).mapInArrow(
        run,
        f"key long, doc_id {id_type}, trained boolean, n_tokens long, known long, base double, model double, tail array<string>",
    )
    parts = materialise(parts, "scored")
    size_of = F.element_at(F.array(*[F.lit(float(x)) for x in sizes[1 + rule.words :]]), (class_column(rule) - rule.words).cast("int"))
    rest = (
        parts.select("key", F.explode("tail").alias("word"))
        .groupBy("key", "word").agg(F.count("*").alias("n"))
        .join(counts, "word", "left")
        .select(
            "key",
            F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("n_known"),
            (F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(base_total))).alias("base_rest"),
            (F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 1) / size_of)).alias("model_rest"),
        )
        .groupBy("key").agg(*[F.sum(x).alias(x) for x in ("n_known", "base_rest", "model_rest")])
    )
    zero = F.lit(0.0)
    return parts.drop("tail").join(rest, "key", "left").select(
        "doc_id",
        "trained",
        "n_tokens",
        (F.col("known") + F.coalesce("n_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rest", zero)).alias("base_score"),
        (F.col("model") + F.coalesce("model_rest", zero)).alias("score"),
    )
