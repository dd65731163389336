"""Byte-level BPE encoding in batched numpy merge rounds, and decoding."""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm.common import ragged, release_memory, run_sums, slices, starts_of, words

#: Text encoded at once, in bytes: each of its different words is encoded once.
ENCODED_BYTES = 2 << 20
#: Pieces of more symbols are merged by a queue, whose time does not grow with the number of rounds.
LONG_PIECE = 100
NO_RANK = np.int32(np.iinfo(np.int32).max)
# Byte classes of ASCII text, lower-cased.
LETTER, DIGIT, OTHER = 1, 2, 3


def byte_symbols() -> dict[int, str]:
    """The visible character that stands for each byte: itself if printable, else the next one from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + k) for k, b in enumerate(hidden)}}


class Merges:
    """The merge list as sorted pair keys; merges many words at once."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        self.shift, self.kind = (16, np.uint32) if len(vocab) <= 1 << 16 else (32, np.uint64)
        keys = self.key(left, right)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.rank_of: dict[int, int] | None = None
        # Where every symbol is made before a pair uses it, equal pairs of a word may be merged in one round.
        made_at = np.full(max(vocab.values()) + 1, -1)
        made_at[self.made[::-1]] = np.arange(len(pairs))[::-1]
        rank = np.arange(len(pairs))
        self.ordered = bool(np.all((made_at[left] < rank) & (made_at[right] < rank)) if len(pairs) else True)

    def key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(self.kind) << self.kind(self.shift) | right.astype(self.kind)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair by binary search, NO_RANK if it is never merged."""
        if not len(self.keys):
            return np.full(len(left), NO_RANK)
        wanted = self.key(left, right)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NO_RANK)

    def merge(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of pieces laid end to end, and their number by piece, after all merges.

        In each round every piece merges its pair of lowest rank, wherever it occurs, from the left.
        """
        out = np.zeros(len(counts), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # pieces, their symbols end to end
        for k in np.flatnonzero(counts > LONG_PIECE):
            a = int(counts[:k].sum())
            got = self.merge_long(symbols[a : a + counts[k]])
            out[k] = len(got)
            done.append((np.array([k]), got))
        piece = np.flatnonzero((counts > 0) & (counts <= LONG_PIECE))
        symbols, sizes = symbols[ragged(counts, piece)], counts[piece]
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        rank = np.full(len(symbols), NO_RANK)
        open_pairs = np.flatnonzero(~last)
        rank[open_pairs] = self.lookup(symbols[open_pairs], symbols[open_pairs + 1])
        while len(piece):
            best = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            ready = best == NO_RANK
            if ready.all() or ready.mean() > 0.1:
                mine = np.repeat(ready, sizes)
                out[piece[ready]] = sizes[ready]
                done.append((piece[ready], symbols[mine]))
                piece, sizes, best = piece[~ready], sizes[~ready], best[~ready]
                symbols, rank, last = symbols[~mine], rank[~mine], last[~mine]
                if not len(piece):
                    break
            best[best == NO_RANK] = -1  # finished, but not yet put away
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            if not self.ordered:
                owner = np.searchsorted(np.cumsum(sizes), at, "right")
                at = at[np.concatenate([[True], owner[1:] != owner[:-1]])]
            elif len(at) > 1 and (np.diff(at) == 1).any():  # like "aaa": every other one of a run
                begins = np.concatenate([[True], np.diff(at) != 1])
                run = np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            last[at] = last[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            sizes = np.add.reduceat(keep, np.cumsum(sizes) - sizes, dtype=np.int64)
            symbols, rank, last = symbols[keep], rank[keep], last[keep]
            at = at - np.arange(len(at))
            rank[at] = NO_RANK
            changed = np.concatenate([at, at[at > 0] - 1])
            changed = changed[~last[changed]]
            rank[changed] = self.lookup(symbols[changed], symbols[changed + 1])
        merged = np.zeros(int(out.sum()), np.int32)
        begin = starts_of(out)[:-1]
        for pieces, got in done:
            n = out[pieces]
            merged[np.arange(len(got)) + np.repeat(begin[pieces] - (np.cumsum(n) - n), n)] = got
        return merged, out

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one long piece: pairs wait in a queue by rank and place."""
        if self.rank_of is None:
            self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        ranks, shift, made = self.rank_of, self.shift, self.made
        sym, n = symbols.tolist(), len(symbols)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        queue = [(r, k) for k in range(n - 1) if (r := ranks.get(sym[k] << shift | sym[k + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, k = heapq.heappop(queue)
            follow = after[k]
            if sym[k] < 0 or follow < 0 or ranks.get(sym[k] << shift | sym[follow]) != rank:
                continue
            sym[k], sym[follow], after[k] = int(made[rank]), -1, after[follow]
            if after[k] >= 0:
                before[after[k]] = k
            for place in (before[k], k):
                if place >= 0 and after[place] >= 0:
                    r = ranks.get(sym[place] << shift | sym[after[place]])
                    if r is not None:
                        heapq.heappush(queue, (r, place))
        return np.array([s for s in sym if s >= 0], np.int32)


class Encoder:
    """Token ids of texts under a tokenizer file, each different word of a slice encoded once.

    For byte-level vocabularies that drop white space and mark the end of a piece, as CLIP's does: text is
    composed and lower-cased, then cut into contractions, runs of letters, single digits and runs of other
    characters. Composition never reaches across ASCII white space, so the ids of a text are those of its
    words. Words of ASCII and of letters below U+0300, where nothing composes, are lower-cased and cut in numpy;
    others are normalised and cut by the tokenizer's own rules, and only their merges are made here. Special
    tokens are found in the raw word, as the file says.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        cutting = spec["pre_tokenizer"].get("pretokenizers", [])
        if (
            model.get("type") != "BPE" or not suffix or model.get("continuing_subword_prefix") or model.get("ignore_merges")
            or model.get("dropout") or [c["type"] for c in cutting] != ["Split", "ByteLevel"] or spec.get("post_processor")
            or spec.get("decoder") or [n["type"] for n in spec["normalizer"].get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
        ):
            raise ValueError("not a byte-level BPE with word ends, lower case and dropped white space")
        self.rules = Tokenizer.from_file(path)
        self.merges = Merges(vocab, model["merges"])
        shown = byte_symbols()
        self.inner = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.final = np.array([vocab[shown[b] + suffix] for b in range(256)], np.int32)
        self.byte_of = np.zeros(max(map(ord, shown.values())) + 1, np.uint8)
        self.byte_of[[ord(c) for c in shown.values()]] = list(shown)
        self.special = {t["content"]: t["id"] for t in added}
        self.marks = [t.encode() for t in self.special]
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.tokens = pa.array([names.get(i) for i in range(max(names) + 1)], pa.large_string())
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.lower = lower
        kind = np.full(256, OTHER, np.uint8)
        kind[97:123], kind[48:58] = LETTER, DIGIT
        self.kind = kind
        self.latin()

    def latin(self) -> None:
        """Lower case and class of U+0080 to U+02FF, asked from the rules; class 0 where it takes more than a table."""
        self.low_pair = np.zeros((12 * 64, 2), np.uint8)  # by code point less 128, as UTF-8
        self.pair_kind = np.zeros(12 * 64, np.uint8)
        cut = self.rules.pre_tokenizer.pre_tokenize_str
        for c in range(128, 0x300):
            low = self.rules.normalizer.normalize_str(chr(c))
            pair = low.encode()
            if len(low) == 1 and len(pair) == 2 and pair[0] < 0xCC:
                self.low_pair[c - 128] = list(pair)
                self.pair_kind[c - 128] = LETTER if len(cut(f"a{low}a")) == 1 else OTHER if len(cut(f"!{low}!")) == 1 else 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids laid end to end, and the number of ids of each text; a null text has none."""
        codes, distinct, counts = words(texts, as_array=True)
        ids, sizes = self.encode_words(distinct)
        return ids[ragged(sizes, codes)], run_sums(sizes[codes], counts)

    def encode_words(self, found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without ASCII white space, end to end, and their number by word."""
        bounds = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1].astype(np.int64)
        raw = np.frombuffer(found.buffers()[2] or b"", np.uint8)[bounds[0] if len(bounds) else 0 :]
        sizes = np.diff(bounds)
        raw = raw[: int(sizes.sum())]
        kind, low = self.kind[self.lower[raw]], self.lower[raw]
        lead = np.flatnonzero((raw >= 0xC2) & (raw < 0xCC))
        point = (raw[lead].astype(np.int64) - 0xC2) * 64 + (raw[lead + 1] - 0x80)
        kind[raw >= 128] = 0
        kind[lead] = kind[lead + 1] = self.pair_kind[point]
        low[lead], low[lead + 1] = self.low_pair[point].T
        odd = run_sums(kind == 0, sizes) > 0
        for mark in self.marks:
            head = (raw[:-1] == mark[0]) & (raw[1:] == (mark + b"\0")[1]) if len(mark) > 1 else raw[:-1] == mark[0]
            odd[np.searchsorted(np.cumsum(sizes), np.flatnonzero(head), "right")] = True
        plain = np.flatnonzero(~odd)
        take = ragged(sizes, plain)
        flat = low[take]
        begins = self.piece_starts(flat, kind[take], sizes[plain])
        symbols, lengths = self.symbols_of(flat, begins)
        plain_pieces = run_sums(begins, sizes[plain])
        others = np.flatnonzero(odd)
        more, more_lengths, more_pieces = self.odd_words(found.take(pa.array(others)).to_pylist())
        ids, counts = self.merges.merge(np.concatenate([symbols, more]), np.concatenate([lengths, more_lengths]))
        pieces = np.concatenate([plain_pieces, more_pieces])
        by_word = run_sums(counts, pieces)
        place = np.argsort(np.concatenate([plain, others]), kind="stable")  # back to the order of the words
        return ids[ragged(by_word, place)], by_word[place]

    def piece_starts(self, flat: np.ndarray, kind: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where pieces begin in lower-case words laid end to end, given the class of each byte."""
        n = len(flat)
        first = np.zeros(n + 4, bool)
        first[np.cumsum(sizes) - sizes] = True
        first[n:] = True
        begins = first.copy()
        begins[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        ahead = np.concatenate([flat, np.zeros(4, np.uint8)])
        at = np.flatnonzero((flat == ord("'")) & begins[:n])
        at = at[~first[at + 1]]
        one = np.isin(ahead[at + 1], list(b"stmd"))
        second = ahead[at + 2]
        two = ((ahead[at + 1] == ord("l")) & (second == ord("l"))) | (
            ((ahead[at + 1] == ord("r")) | (ahead[at + 1] == ord("v"))) & (second == ord("e"))
        )
        two &= ~first[at + 2] & ~one
        begins[at[one | two] + 1] = False
        begins[at[one] + 2] = True
        begins[at[two] + 3] = True
        return begins[:n]

    def symbols_of(self, flat: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of bytes cut into pieces, and the symbols by piece."""
        ends = np.concatenate([begins[1:], [True]]) if len(flat) else begins
        starts = np.flatnonzero(begins)
        return np.where(ends, self.final[flat], self.inner[flat]), np.diff(np.append(starts, len(flat)))

    def odd_words(self, found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, symbols by piece and pieces by word, of words with special tokens or beyond ASCII."""
        parts: list[str] = []
        owner: list[int] = []
        special: dict[int, int] = {}  # part: id
        for k, word in enumerate(found):
            for i, part in enumerate(self.cut_special.split(word) if self.special else [word]):
                if part:
                    if i % 2:
                        special[len(parts)] = self.special[part]
                    parts.append(part)
                    owner.append(k)
        shown: list[str] = []
        part_of: list[int] = []
        plain = [k for k in range(len(parts)) if k not in special]
        if plain:
            joined = "\n".join(parts[k] for k in plain)
            text = self.rules.normalizer.normalize_str(joined)
            if not re.search(r"[^\S\n]", joined) and text.count(" ") == len(plain) - 1:
                spaces = np.array([m.start() for m in re.finditer(" ", text)], np.int64)
                cut = self.rules.pre_tokenizer.pre_tokenize_str(text)
                shown = [piece for piece, _ in cut]
                part_of = np.array(plain)[np.searchsorted(spaces, [a for _, (a, _) in cut])].tolist()
            else:  # white space beyond ASCII inside a word
                for k in plain:
                    cut = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(parts[k]))
                    shown += [piece for piece, _ in cut]
                    part_of += [k] * len(cut)
        flat = self.byte_of[np.frombuffer("".join(shown).encode("utf-32-le"), np.uint32)]
        lengths = np.fromiter(map(len, shown), np.int64, len(shown))
        begins = np.zeros(len(flat), bool)
        begins[np.cumsum(lengths) - lengths] = True
        symbols, _ = self.symbols_of(flat, begins)
        where = np.array(part_of, np.int64)
        if special:
            at = np.searchsorted(where, list(special))
            symbols = np.insert(symbols, starts_of(lengths)[at], list(special.values()))
            lengths = np.insert(lengths, at, 1)
            where = np.insert(where, at, list(special))
        pieces = np.bincount(np.array(owner, np.int64)[where], minlength=len(found)).astype(np.int64)
        return symbols.astype(np.int32), lengths, pieces

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of runs of ids: their tokens with a space between; ids of no token are left out."""
        inside = (ids >= 0) & (ids < len(self.tokens))
        tokens = self.tokens.take(pa.array(np.where(inside, ids, 0)))
        real = inside & tokens.is_valid().to_numpy(zero_copy_only=False)
        if not real.all():
            tokens, counts = tokens.filter(pa.array(real)), run_sums(real, counts)
        lists = pa.ListArray.from_arrays(pa.array(starts_of(counts), pa.int32()), tokens)
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


def new_encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    encoder = Encoder(path)
    release_memory()  # what reading the file took
    return encoder


def encode_texts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ids array<int>: each whole text as the tokenizers library encodes it, without added tokens.

    ``path`` is a tokenizer file that every executor can read. Null and empty texts have no ids; rows, also
    repeated ones and those with null ids, are handled one by one; columns other than ``ids`` pass through,
    one of that name is replaced. An empty table gives no rows. A text is encoded whole, whatever its length.
    """
    return _appended(docs, path, text, "ids array<int>", lambda encoder, ids, counts: [_lists(ids, counts)])


def encode_and_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens long, ids binary (little-endian unsigned 32-bit) and decoded string.

    ``decoded`` is the library's decoding of the ids, special tokens included. Odd rows are handled as
    :func:`encode_texts` does; a text without ids is decoded to the empty string.
    """

    def columns(encoder: Encoder, ids: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
        data = pa.py_buffer(ids.astype("<u4").tobytes())
        offsets = pa.py_buffer((4 * starts_of(counts)).astype(np.int32).tobytes())
        return [pa.array(counts), pa.Array.from_buffers(pa.binary(), len(counts), [None, offsets, data]), encoder.decode(ids, counts)]

    return _appended(docs, path, text, "n_tokens long, ids binary, decoded string", columns)


def decode_ids(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with decoded string: the text of the array ``ids``; null if the array is null, null ids are left out."""
    kept = [c for c in rows.columns if c.lower() != "decoded"]
    schema = ", ".join(f"`{c.replace('`', '``')}` {rows.schema[c].dataType.simpleString()}" for c in kept) + ", decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = new_encoder(path)
        for batch in batches:
            lists = batch.column(ids)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
            texts = pc.if_else(lists.is_valid(), encoder.decode(flat, counts), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return rows.select(*[F.col(f"`{c.replace('`', '``')}`") for c in kept]).mapInArrow(run, schema)


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts_of(counts), pa.int32()), pa.array(ids, pa.int32()))


def _appended(docs: DataFrame, path: str, text: str, fields: str, columns) -> DataFrame:
    new = [f.strip().split(" ")[0] for f in fields.split(",")]
    if text in new:
        raise ValueError(f"{text} is a column of the result")
    kept = [c for c in docs.columns if c.lower() not in new]
    schema = ", ".join(f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", " + fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = new_encoder(path)
        for batch in batches:
            for part in slices(batch, text, ENCODED_BYTES):
                ids, counts = encoder.encode(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns(encoder, ids, counts)], names=[*part.schema.names, *new])
        release_memory()

    return docs.select(*[F.col(f"`{c.replace('`', '``')}`") for c in kept]).mapInArrow(run, schema)
