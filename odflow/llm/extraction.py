"""HTML extraction: blocks of a page labelled by a bidirectional LSTM over tag paths and words."""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odflow.llm.common import append_columns, drawn_by_key, one_task, slices

#: Pages and runs of blocks used for training at most, and the blocks of a run at most: long pages are
#: cut into runs. All blocks of all pages are labelled.
TRAINING_PAGES = 1200
TRAINING_BLOCKS = 300
#: A path names so many of the outermost and of the innermost open elements, and so many words of an element's
#: attributes: features of a block, its text is whole.
PATH_ENDS, PATH_WORDS = 16, 16
#: Pages of more blocks are read by the network in parts of so many, the state handed on.
READ_BLOCKS = 4096

TAG = re.compile(
    r"<!--|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+>|[^>]*+>)", re.S
)
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
# HTML element names by their role.
RAW = ("script", "style")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
CLOSED_BY_SAME = {"li", "p", "td", "th", "tr", "dt", "dd", "option"}
MAIN = {"article", "main"}
MAIN_NAMES = {"article", "body-text", "content", "entry", "main", "post", "story"}
OTHER = {"aside", "button", "footer", "form", "head", "nav", "noscript", "option", "select", "textarea", "title", "header"}
OTHER_NAMES = {
    "ad", "ads", "advert", "advertisement", "banner", "breadcrumb", "comment", "comments", "consent", "cookie", "footer", "header",
    "login", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "share", "sidebar", "social",
    "sponsored", "subscribe", "toolbar", "widget",
}


@dataclass(frozen=True)
class Block:
    """A run of text between block-level tags: the names above it, its text, and its letters within links."""

    path: tuple[str, ...]
    text: str
    linked: int


class OpenElements:
    """The open elements of a page, each found by name without a walk through the others."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.walls: list[int] = []  # places of those that only their own end closes
        self.named: list[tuple[str, ...]] = []  # tag and words of the block-level ones
        self.links = 0
        self.known: tuple[str, ...] | None = None

    def add(self, tag: str, words: tuple[str, ...]) -> None:
        place = len(self.tags)
        self.tags.append(tag)
        self.places.setdefault(tag, []).append(place)
        if tag in INLINE:
            self.links += tag == "a"
        else:
            self.named.append((tag, *words))
            self.known = None
            if tag not in CLOSED_BY_SAME:
                self.walls.append(place)

    def close_from(self, place: int) -> None:
        while len(self.tags) > place:
            tag = self.tags.pop()
            self.places[tag].pop()
            if tag in INLINE:
                self.links -= tag == "a"
            else:
                self.named.pop()
                self.known = None
                if tag not in CLOSED_BY_SAME:
                    self.walls.pop()

    def close(self, tag: str) -> None:
        """An end tag closes the innermost of its name, with all inside; without one it closes nothing."""
        if self.places.get(tag):
            self.close_from(self.places[tag][-1])

    def make_room(self, tag: str) -> None:
        """A block-level start tag closes an open element of its kind, or a paragraph, within the last wall."""
        wall = self.walls[-1] if self.walls else -1
        last = [self.places[t][-1] for t in {tag, "p"} & CLOSED_BY_SAME if self.places.get(t)]
        if last and max(last) > wall:
            self.close_from(max(last))

    def path(self) -> tuple[str, ...]:
        """Tags and words of the outermost and innermost block-level elements; blocks of one element share it."""
        if self.known is None:
            shown = self.named if len(self.named) <= 2 * PATH_ENDS else self.named[:PATH_ENDS] + self.named[-PATH_ENDS:]
            self.known = tuple(x for names in shown for x in names)
        return self.known


def page_blocks(page: str) -> list[Block]:
    """The blocks of a page in order; scripts, styles and comments have none. Time is linear in the page.

    The path holds the open elements from the outermost, each followed by the words of its class, id
    and role with a dot before them, within PATH_ENDS and PATH_WORDS. Elements that HTML lets stay open are
    closed by the next of their kind or by the end of what holds them. A comment that is not closed ends at
    its first ``>``.
    """
    out: list[Block] = []
    stack = OpenElements()
    held: list[str] = []
    linked, no_more_ends = 0, False

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            out.append(Block(stack.path(), text, linked))
        held.clear()
        linked = 0

    def text_of(piece: str) -> None:
        nonlocal linked
        if piece:
            held.append(piece)
            if stack.links:
                linked += len(piece)

    end, at = page.rfind(">") + 1, 0
    while (tag := TAG.search(page, at, end)) is not None:
        text_of(page[at : tag.start()])
        at = tag.end()
        if tag[0] == "<!--":
            close = -1 if no_more_ends else page.find("-->", at)
            no_more_ends = close < 0
            at = close + 3 if close >= 0 else page.find(">", at) + 1
            continue
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name == "br":
            held.append(" ")
            continue
        if name not in INLINE:
            flush()
        if tag[1]:
            stack.close(name)
            continue
        if name in RAW:
            closing = re.compile(rf"</{name}", re.I).search(page, at)
            at = closing.start() if closing else len(page)
            continue
        if name in VOID:
            continue
        words: list[str] = []
        if name not in INLINE:
            stack.make_room(name)
            for m in ATTRIBUTE.finditer(tag[3]):
                words += [f".{w.lower()}" for w in re.split(r"[\s_]+", m[1] or m[2] or m[3] or "", maxsplit=PATH_WORDS)[:PATH_WORDS] if w]
        stack.add(name, tuple(words[:PATH_WORDS]))
    text_of(page[at:] if at < len(page) else "")
    flush()
    return out


def teacher(path: tuple[str, ...], text: str, linked: int, page_has_main: bool) -> int:
    """Training label from the names above a block: 1 for the article, 0 for all else."""
    inside = False
    for x in path:
        plain = x[1:] if x[0] == "." else x
        parts = {plain, *plain.split("-")}
        if (x[0] != "." and x in MAIN) or (x[0] == "." and parts & MAIN_NAMES):
            inside = True
        if (x[0] != "." and x in OTHER) or (x[0] == "." and parts & OTHER_NAMES):
            return 0
    if page_has_main:
        return int(inside)
    return int(len(text) >= 80 and linked * 3 < len(text))


def page_labels(blocks: list[Block]) -> list[int]:
    marked = any(x in MAIN or (x[0] == "." and {x[1:], *x[1:].split("-")} & MAIN_NAMES) for b in blocks for x in b.path)
    return [teacher(b.path, b.text, b.linked, marked) for b in blocks]


# Other ways to write the parts of a page, for training pages of other build.
MAIN_FORMS = [("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post"), ("section", ".entry"), ("div", ".story"), ("div", ".main-content")]
OTHER_FORMS = [
    ("nav", "ul", "li"), ("div", ".menu", "ul", "li"), ("header",), ("div", ".header"), ("footer",), ("div", ".footer"), ("aside",),
    ("div", ".sidebar"), ("div", ".ad"), ("div", ".advert"), ("div", ".cookie", ".notice"), ("div", ".banner"), ("form",), ("section", ".comments", "p"),
    ("div", ".comments", "div", ".comment", "p"), ("div", ".related"), ("div", ".share"), ("div", ".newsletter"), ("ul", ".breadcrumb", "li"),
]


def varied(blocks: list[Block], labels: list[int], others: list[Block], g: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The page built otherwise: another wrapper for its article, and strange blocks put around it."""
    form = MAIN_FORMS[g.integers(len(MAIN_FORMS))]
    out, marks = [], []

    def strange() -> None:
        path = ("html", "body", *OTHER_FORMS[g.integers(len(OTHER_FORMS))])
        for _ in range(g.integers(1, 4)):
            text = others[g.integers(len(others))].text
            cut = int(g.integers(8, 200))
            out.append(Block(path, text[:cut], min(len(text), cut) if g.random() < 0.3 else 0))
            marks.append(0)

    before = 0
    for b, y in zip(blocks, labels, strict=True):
        if y != before and g.random() < 0.5:
            strange()
        before = y
        path = b.path
        if "article" in path:
            k = path.index("article")
            path = (*path[:k], *form, *path[k + 1 :])
        out.append(Block(path, b.text, b.linked))
        marks.append(y)
    if g.random() < 0.7:
        strange()
    return out, marks


PATH_PLACES, WORD_PLACES, FACTS = 96, 32, 8
INPUTS = PATH_PLACES + WORD_PLACES + FACTS


class Featurer:
    """Vectors of blocks: hashed names of the path, hashed words, and a few facts."""

    def __init__(self) -> None:
        self.paths: dict[tuple[str, ...], np.ndarray] = {}

    def path_vector(self, path: tuple[str, ...]) -> np.ndarray:
        if path not in self.paths:
            if len(self.paths) > 5_000:
                self.paths = {}
            v = np.zeros(PATH_PLACES, np.float32)
            names = [x for x in path if x not in ("html", "body")]
            for x in {y for n in names for y in ((n, *("." + p for p in n[1:].split("-"))) if n[0] == "." else (n,))}:
                h = zlib.crc32(x.encode())
                v[h % PATH_PLACES] += 1.0 if h >> 31 else -1.0
            self.paths[path] = v
        return self.paths[path]

    def page(self, blocks: list[Block], start: int = 0, total: int | None = None) -> np.ndarray:
        """Vectors of a page, or of its run of blocks from ``start`` if the page has ``total``."""
        total = len(blocks) if total is None else total
        out = np.zeros((len(blocks), INPUTS), np.float32)
        for k, b in enumerate(blocks):
            out[k, :PATH_PLACES] = self.path_vector(b.path)
            places = [zlib.crc32(w.encode()) % WORD_PLACES for w in b.text.split(" ")]
            out[k, PATH_PLACES : PATH_PLACES + WORD_PLACES] = np.bincount(places, minlength=WORD_PLACES) / len(places)
            n = len(b.text)
            ends = b.text.count(".") + b.text.count(",")
            out[k, -FACTS:] = (
                np.log(n) / 5, np.log(len(places)) / 4, min(b.linked / n, 1), ends / len(places), len(b.path) / 10,
                (start + k) / total, b.text[-1] in ".!?", start + k == 0,
            )
        return out


class BiLstm:
    """Two LSTMs, one from each end, and a logistic output for each block."""

    SHAPES = ("fx", "fh", "fb", "bx", "bh", "bb", "wo", "bo")

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts

    @classmethod
    def fresh(cls, inputs: int, hidden: int, seed: int) -> BiLstm:
        g = np.random.default_rng(seed)
        parts = []
        for _ in range(2):
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1  # remember at first
            parts += [g.normal(0, inputs**-0.5, (inputs, 4 * hidden)), g.normal(0, hidden**-0.5, (hidden, 4 * hidden)), bias]
        return cls([p.astype(np.float32) for p in (*parts, g.normal(0, 0.2, 2 * hidden), np.zeros(1))])

    @staticmethod
    def run(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool, begin: tuple | None = None) -> tuple[np.ndarray, list]:
        """Hidden states of a batch (steps, pages, inputs), with what the way back needs if ``keep``, else with the last state."""
        steps, n, h = len(x), x.shape[1], len(wh)
        pre = x @ wx + b
        state, cell = begin or (np.zeros((n, h), np.float32), np.zeros((n, h), np.float32))
        out, kept = np.empty((steps, n, h), np.float32), []
        for t in range(steps):
            z = pre[t] + state @ wh
            i, f, o = gate(z[:, :h]), gate(z[:, h : 2 * h]), gate(z[:, 3 * h :])
            c = np.tanh(z[:, 2 * h : 3 * h])
            last = cell
            cell = f * last + i * c
            tall = np.tanh(cell)
            if keep:
                kept.append((state, last, i, f, o, c, tall))
            state = o * tall
            out[t] = state
        return out, kept if keep else [state, cell]

    def read_long(self, vectors: Callable[[int, int], np.ndarray], total: int) -> np.ndarray:
        """Probabilities of one long page, given by parts: ``vectors(a, b)`` are those of blocks a to b."""
        fx, fh, fb, bx, bh, bb, wo, bo = self.parts
        cuts = [(a, min(a + READ_BLOCKS, total)) for a in range(0, total, READ_BLOCKS)]
        out, state = np.zeros(total, np.float32), None
        for a, b in cuts:
            h, state = self.run(vectors(a, b)[:, None, :], fx, fh, fb, False, state)
            out[a:b] = h[:, 0] @ wo[: len(fh)]
        state = None
        for a, b in reversed(cuts):
            h, state = self.run(vectors(a, b)[::-1, None, :], bx, bh, bb, False, state)
            out[a:b] += h[::-1, 0] @ wo[len(fh) :]
        return gate(out + bo[0])

    @staticmethod
    def back(x: np.ndarray, d_out: np.ndarray, wx: np.ndarray, wh: np.ndarray, kept: list) -> list[np.ndarray]:
        n, h = x.shape[1], len(wh)
        d_state, d_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        gx, gh, gb = np.zeros_like(wx), np.zeros_like(wh), np.zeros(4 * h, np.float32)
        for t in range(len(x) - 1, -1, -1):
            before, last, i, f, o, c, tall = kept[t]
            ds = d_out[t] + d_state
            dc = d_cell + ds * o * (1 - tall * tall)
            dz = np.concatenate([dc * c * i * (1 - i), dc * last * f * (1 - f), dc * i * (1 - c * c), ds * tall * o * (1 - o)], 1)
            gx += x[t].T @ dz
            gh += before.T @ dz
            gb += dz.sum(0)
            d_state, d_cell = dz @ wh.T, dc * f
        return [gx, gh, gb]

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple:
        """Probabilities (steps, pages); the backward net reads each page from its own end."""
        fx, fh, fb, bx, bh, bb, wo, bo = self.parts
        turn = np.abs(np.arange(len(x))[:, None] - (lengths[None, :] - 1))
        turn = np.where(np.arange(len(x))[:, None] < lengths[None, :], turn, np.arange(len(x))[:, None])
        pages = np.arange(x.shape[1])[None, :]
        turned = x[turn, pages]
        ahead, kept_a = self.run(x, fx, fh, fb, keep)
        behind, kept_b = self.run(turned, bx, bh, bb, keep)
        h = np.concatenate([ahead, behind[turn, pages]], 2)
        return gate(h @ wo + bo[0]), h, turned, turn, pages, kept_a, kept_b

    def gradient(self, x: np.ndarray, y: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        fx, fh, fb, bx, bh, bb, wo, bo = self.parts
        p, h, turned, turn, pages, kept_a, kept_b = self.forward(x, lengths, True)
        real = np.arange(len(x))[:, None] < lengths[None, :]
        d = np.where(real, p - y, 0).astype(np.float32) / max(real.sum(), 1)
        dh = d[:, :, None] * wo
        half = len(fh)
        d_behind = dh[:, :, half:][turn, pages]
        return [
            *self.back(x, dh[:, :, :half], fx, fh, kept_a),
            *self.back(turned, d_behind, bx, bh, kept_b),
            np.einsum("tn,tnh->h", d, h), np.array([d.sum()], np.float32),
        ]


def gate(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def batches_of(vectors: list[np.ndarray], cells: int = 8192) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Pages of like length together: their numbers, padded inputs (steps, pages, inputs) and lengths."""
    order = sorted(range(len(vectors)), key=lambda k: len(vectors[k]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and len(vectors[order[stop]]) * (stop + 1 - at) <= cells:
            stop += 1
        some = order[at:stop]
        lengths = np.array([len(vectors[k]) for k in some])
        x = np.zeros((lengths.max(), len(some), INPUTS), np.float32)
        for n, k in enumerate(some):
            x[: lengths[n], n] = vectors[k]
        yield some, x, lengths
        at = stop


@dataclass(frozen=True)
class Run:
    """Blocks of a page that training reads at once, with their labels and their place in the page."""

    blocks: list[Block]
    labels: list[int]
    start: int
    total: int


def runs_of(page: list[Block], most: int, run_blocks: int = TRAINING_BLOCKS) -> list[Run]:
    """The page in runs of at most ``run_blocks``, labelled as a whole; at most ``most`` of them, dealt by chance."""
    labels, starts = page_labels(page), range(0, len(page), run_blocks)
    order = np.random.default_rng(zlib.crc32(" ".join(b.text for b in page).encode("utf-8", "replace"))).permutation(len(starts))[:most]
    cuts = [slice(starts[k], starts[k] + run_blocks) for k in order]
    return [Run(page[c], labels[c], c.start, len(page)) for c in cuts]


def fit_labeller(runs: list[Run], hidden: int = 24, epochs: int = 6, rate: float = 0.01, seed: int = 9) -> BiLstm:
    """Train on each run as it is and once built otherwise, by Adam over small batches of runs."""
    g = np.random.default_rng(seed)
    others = [b for r in runs for b in r.blocks]
    both = [(r.blocks, r.labels) for r in runs] + [varied(r.blocks, r.labels, others, g) for r in runs]
    featurer = Featurer()
    vectors = [featurer.page(p, r.start, r.total + len(p) - len(r.blocks)) for (p, _), r in zip(both, runs * 2, strict=True)]
    targets = [np.array(m, np.float32) for _, m in both]
    net = BiLstm.fresh(INPUTS, hidden, seed)
    first, second = [np.zeros_like(p) for p in net.parts], [np.zeros_like(p) for p in net.parts]
    steps = [(some, x, lengths) for some, x, lengths in batches_of(vectors, 1024)]
    n = 0
    for _ in range(epochs):
        for k in g.permutation(len(steps)):
            some, x, lengths = steps[k]
            y = np.zeros(x.shape[:2], np.float32)
            for column, page in enumerate(some):
                y[: lengths[column], column] = targets[page]
            n += 1
            for i, grad in enumerate(net.gradient(x, y, lengths)):
                grad = np.clip(grad, -1, 1)
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                net.parts[i] = (net.parts[i] - rate * (first[i] / (1 - 0.9**n)) / (np.sqrt(second[i] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
    return net


def with_blocks(pages: DataFrame) -> DataFrame:
    """The pages that have text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                yield part.filter(pa.array([bool(page_blocks(h)) for h in part.column("html").to_pylist()], pa.bool_()))

    return pages.mapInArrow(run, pages.schema)


def labeller(pages: DataFrame, bound: int, run_blocks: int = TRAINING_BLOCKS) -> BiLstm | None:
    """The network, learnt in one task from at most ``bound`` different pages, drawn by a hash of their html.

    If none of these has text, as many are drawn from the pages that have.
    """
    keyed = pages.select(F.xxhash64("html").alias("key"), "html").where(F.length("html") > 0)
    return learnt(keyed, bound, run_blocks) or learnt(with_blocks(keyed), bound, run_blocks)


def learnt(keyed: DataFrame, bound: int, run_blocks: int) -> BiLstm | None:
    """The network from the pages with the ``bound`` lowest keys; None if these have no text.

    A page of at most ``run_blocks`` is one run, a longer one is cut. Every page gives its first
    run before any gives a second, and so on, up to ``bound`` runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: list[tuple[int, int, Run]] = []
        pages = 0
        for batch in batches:
            for part in slices(batch, "html"):
                for html in part.column("html").to_pylist():
                    read += [(turn, pages, r) for turn, r in enumerate(runs_of(page_blocks(html), bound, run_blocks))]
                    pages += 1
                    if len(read) > 2 * bound:
                        read = sorted(read, key=lambda x: x[:2])[:bound]
        read = sorted(sorted(read, key=lambda x: x[:2])[:bound], key=lambda x: (x[1], x[0]))
        if read:
            net = fit_labeller([r for _, _, r in read])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(net.parts))),
                    pa.array([list(p.shape) for p in net.parts], pa.list_(pa.int64())),
                    pa.array([p.ravel() for p in net.parts], pa.list_(pa.float32())),
                ],
                names=["part", "shape", "values"],
            )

    drawn = drawn_by_key(keyed, "key", "html", [F.col("key")], bound)
    task = one_task(drawn, [F.col("key")])
    found = sorted(task.mapInArrow(run, "part long, shape array<long>, values array<float>").collect())
    return BiLstm([np.array(r["values"], np.float32).reshape(r["shape"]) for r in found]) if found else None


def extract_main_text(
    pages: DataFrame, threshold: float = 0.5, bound: int = TRAINING_PAGES, run_blocks: int = TRAINING_BLOCKS
) -> DataFrame:
    """``pages`` with text (main text of html) and n_chars (its code points).

    A page is cut into blocks at block-level tags. Every block is a vector of its tag path, its words
    (both hashed) and a few facts; a bidirectional LSTM reads all blocks of the page and gives each the
    probability of belonging to the article. Those at ``threshold`` or above are joined in order by a
    space. The network learns in one task from at most ``bound`` different pages drawn by hash, long
    ones cut into runs of ``run_blocks`` blocks; its labels come from the names of elements and classes there, and
    each run is also shown with other names and with strange blocks put in. Every block of every page is labelled, whatever their number.

    Input: html and any others, all kept (columns named as the new ones are replaced). Null and empty
    pages and pages without text give an empty text; broken markup is read as far as it goes, in time linear
    in its length. Equal pages get equal texts, a row each, whatever their id; the network sees them once. An
    empty table gives no rows.
    """
    net = labeller(pages, bound, run_blocks)
    parts = net.parts if net else None

    def compute() -> Callable[[pa.Array], list[pa.Array]]:
        featurer = Featurer()

        def chosen(blocks: list[Block], chances: np.ndarray) -> str:
            return " ".join(b.text for b, q in zip(blocks, chances, strict=True) if q >= threshold)

        def apply(htmls: pa.Array) -> list[pa.Array]:
            read = [page_blocks(h) if h else [] for h in htmls.to_pylist()]
            texts = [""] * len(read)
            full = [k for k, blocks in enumerate(read) if blocks]
            if full and parts:
                model = BiLstm(parts)
                short = [k for k in full if len(read[k]) <= READ_BLOCKS]
                for some, x, lengths in batches_of([featurer.page(read[k]) for k in short]):
                    p = model.forward(x, lengths)[0]
                    for column, n in enumerate(some):
                        texts[short[n]] = chosen(read[short[n]], p[: lengths[column], column])
                for k in full:
                    if len(blocks := read[k]) > READ_BLOCKS:
                        part = lambda a, b, blocks=blocks: featurer.page(blocks[a:b], a, len(blocks))
                        texts[k] = chosen(blocks, model.read_long(part, len(blocks)))
            return [pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]

        return apply

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return append_columns(pages, "html", fields, compute)
