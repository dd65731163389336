from __future__ import annotations

import collections
import math
import random
import re
import unicodedata

import numpy as np
import pytest

from odflow.llm import extraction, rules
from odflow.llm.extraction import extract_main_text, page_blocks
from odflow.llm.rules import chi2_cdf, chi2_quantile, outlier_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts_of(text):
    t = text or ""
    w = WORD.findall(t)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_rules_on_odd_rows_and_outliers(docs_of, odd_rows):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 8)))
    rows = [(100 + i, " ".join(word() for _ in range(r.randint(30, 80))) + ".", "en", "a") for i in range(150)]
    rows += [(300 + i, " ".join(word() + "#*$%" for _ in range(50)), "en", "a") for i in range(20)]
    rows += [(400, "one two three four five six seven eight nine\n" * 3, "en", "a"), (401, "alone in its group " + " ".join(map(str, range(20))), "xx", None)]
    out = outlier_rules(docs_of(rows + odd_rows)).collect()
    texts = collections.defaultdict(list)
    for d, t, *_ in rows + odd_rows:
        texts[d].append(counts_of(t))
    for x in out:
        got = (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)
        assert got in texts[x.doc_id]
        assert x.base_failed == (got[0] < 10 or 100 * got[4] > 20 * got[0])
    kept = {x.doc_id: x.kept for x in out}
    assert all(kept[100 + i] for i in range(150)) and not any(kept[300 + i] for i in range(20))
    assert not kept[400] and kept[401] and not kept[1]
    assert outlier_rules(docs_of([])).count() == 0


def test_rules_stay_in_the_engine(docs_of, odd_rows):
    plan = outlier_rules(docs_of(odd_rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_chi_squared():
    assert chi2_cdf(5.991464547, 2) == pytest.approx(0.95, abs=1e-8)
    assert chi2_quantile(0.95, 5) == pytest.approx(11.0704976935, abs=1e-6)


def test_blocks():
    page = "<p>a<b>b</b> &amp; <a href='x'>li\nnk</a><p>two<!-- no <p> --><script>var x='<p>'</script><ul><li>i<li>j</ul>tail < 3"
    got = [(b.path, b.text) for b in page_blocks(page)]
    assert got == [(("p",), "ab & li nk"), (("p",), "two"), (("ul", "li"), "i"), (("ul", "li"), "j"), ((), "tail < 3")]
    assert page_blocks("<div class='side bar' id=x>t")[0].path == ("div", ".side", ".bar", ".x")
    assert page_blocks("") == [] and page_blocks("<script>never closed") == []


def test_extraction(spark):
    r = random.Random(5)
    say = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    rows, want = [], {}
    for i in range(400):
        body = [say(r.randint(3, 60)) + "." for _ in range(r.randint(1, 8))]
        want[i] = " ".join(body)
        menu = "".join(f"<li><a href='/{k}'>{say(1)}</a></li>" for k in range(5))
        rows.append((i, "u", f"<html><head><title>{say(4)}</title><style>p{{}}</style></head><body><nav><ul>{menu}</ul></nav><div class=\"ad\">{say(8)}</div>"
                     f"<article>{''.join(f'<p>{b}</p>' for b in body)}</article><footer>&copy; {say(6)}</footer></body></html>"))
    body = [say(40) + "." for _ in range(3)]
    want[900] = " ".join(body)
    rows.append((900, "u", f"<body><div class='menu'><a>{say(3)}</a></div><main>{''.join(f'<p>{b}' for b in body)}</main><div class='comments'><p>{say(30)}</p></div>"))
    rows += [(901, None, None), (902, "u", ""), (903, "u", "<html><body></body></html>"), (0, "u", rows[0][2])]
    rows.append((904, "u", "<article>" + "<p>a few words, again and again.</p>" * 20_000 + "</article>"))
    want |= {901: "", 902: "", 903: ""}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'other' AS text", "1 AS score")
    out = extract_main_text(pages, bound=300).collect()
    assert len(out) == len(rows)
    right = sum(x.text == want[x.page_id] for x in out if x.page_id in want)
    assert right / (len(out) - 1) > 0.98
    assert all(x.n_chars == len(x.text) and x.score == 1 for x in out)
    assert {x.text for x in out if x.page_id in (901, 902, 903)} == {""}
    long = next(x for x in out if x.page_id == 904)
    assert long.n_chars > 0.9 * 20_000 * 31
    assert extract_main_text(pages.where("false")).count() == 0


@pytest.mark.parametrize("n_pages", [1, 20])
def test_extraction_learns_from_long_pages(spark, n_pages):
    def page(i):
        body = [f"p{i} n{k} some words of the article, told at length." for k in range(320)]
        menu = "".join(f"<li><a href='/{k}'>go{k}</a></li>" for k in range(30))
        return f"<body><nav><ul>{menu}</ul></nav><article>{''.join(f'<p>{b}</p>' for b in body)}</article><footer>end {i}</footer></body>", " ".join(body)

    made = [page(i) for i in range(n_pages)]
    rows = [(i, "u", html) for i, (html, _) in enumerate(made)]
    out = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), bound=30).collect()
    assert all(abs(x.n_chars / len(made[x.page_id][1]) - 1) < 0.1 for x in out)


def test_extraction_learns_from_few_different_pages(spark):
    html = "<body><nav>go</nav><article><p>some words of the only article, told at length.</p></article></body>"
    rows = [(i, "u", "<script>no text</script>" + " " * i) for i in range(60)] + [(100 + i, "u", html) for i in range(60)]
    out = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), bound=3).collect()
    assert {x.text for x in out if x.page_id < 100} == {""} and all(x.n_chars > 0 for x in out if x.page_id >= 100)


def slow_blocks(page):
    """Texts of the blocks with the rules written plainly: a list of open elements, walked every time."""
    import html
    import re

    out, stack, held, at = [], [], [], 0
    end = page.rfind(">") + 1

    def flush():
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append((tuple(t for t in stack if t not in extraction.INLINE), text))
        held.clear()

    while m := extraction.TAG.search(page, at, end):
        held.append(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            close = page.find("-->", at)
            at = close + 3 if close >= 0 else page.find(">", at) + 1
            continue
        name = (m[2] or "").lower()
        if name == "br":
            held.append(" ")
        if not name or name == "br":
            continue
        if name not in extraction.INLINE:
            flush()
        if m[1]:
            if name in stack:
                del stack[len(stack) - 1 - stack[::-1].index(name) :]
        elif name in extraction.RAW:
            close = re.compile(f"</{name}", re.I).search(page, at)
            at = close.start() if close else len(page)
        elif name not in extraction.VOID:
            if name not in extraction.INLINE:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k] not in extraction.CLOSED_BY_SAME | extraction.INLINE:
                        break
                    if stack[k] in (name, "p"):
                        del stack[k:]
                        break
            stack.append(name)
    held.append(page[at:])
    flush()
    return out


def test_blocks_agree_with_a_plain_walk():
    draw = random.Random(8)
    bits = ["<div>", "</div>", "<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<b>", "</b>", "<a href='x'>", "</a>", "<td>", "<dt>", "<dd>"]
    bits += ["<br>", "<img>", "<!-- x > y -->", "<!-- open >", "<script>a<b</script>", "word ", "&amp; ", "< ", "</span>", "<!doctype html>"]
    for _ in range(400):
        page = "".join(draw.choices(bits, k=draw.randint(0, 40)))
        assert [(b.path, b.text) for b in extraction.page_blocks(page)] == slow_blocks(page), page


@pytest.mark.parametrize("page", [
    "<!-- >" * 170_000, "<div>x" * 170_000, "<b>" * 170_000 + "<dt>x</dt>" * 58_000, "<div>" * 100_000 + "</span>x" * 58_000,
    '<div class="' + "a " * 250_000 + '">' + "<p>x" * 130_000, '<div class="a b c d e f g h i j k l m n o p">x' * 22_000, "<" * 1_000_000,
])
def test_hostile_pages_take_linear_time_and_little_memory(page):
    import time
    import tracemalloc

    start = time.process_time()
    extraction.page_blocks(page)
    assert time.process_time() - start < 5
    tracemalloc.start()
    extraction.page_blocks(page[: len(page) // 4])
    assert tracemalloc.get_traced_memory()[1] < 50 << 20
    tracemalloc.stop()


def test_long_pages_are_read_in_parts_with_the_same_result():
    net, featurer = extraction.BiLstm.fresh(extraction.INPUTS, 24, 1), extraction.Featurer()
    page = extraction.page_blocks("".join(f"<div><p>words {k} and more</p></div>" for k in range(9000)))
    whole = net.forward(featurer.page(page)[:, None, :], np.array([len(page)]))[0][:, 0]
    parts = net.read_long(lambda a, b: featurer.page(page[a:b], a, len(page)), len(page))
    assert len(page) > 2 * extraction.READ_BLOCKS and np.abs(whole - parts).max() < 1e-5


def slow_distances(vectors, steps=4):
    """Minimum covariance determinant by sorting: concentration steps from medians, on one group."""
    names, floors = list(rules.FLOORS), np.array(list(rules.FLOORS.values()))
    factor, h = rules.consistency(len(names)), int(np.ceil(rules.KEPT_SHARE * len(vectors)))
    centre = np.median(vectors, axis=0)
    spread = 1.4826 * np.median(np.abs(vectors - centre), axis=0)
    inverse = np.diag(1 / (spread**2 + floors**2))
    for _ in range(steps):
        moved = vectors - centre
        near = np.argsort(np.einsum("ij,jk,ik->i", moved, inverse, moved), kind="stable")[:h]
        centre = vectors[near].mean(0)
        cov = (vectors[near] - centre).T @ (vectors[near] - centre) / h * factor + np.diag(floors**2)
        inverse = np.linalg.inv(cov)
    moved = vectors - centre
    return np.einsum("ij,jk,ik->i", moved, inverse, moved)


def test_verdicts_agree_with_a_sorting_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = {r.doc_id: r for r in outlier_rules(docs, ("lang",)).collect()}
    groups = collections.defaultdict(list)
    for d in docs.collect():
        text = d.text or ""
        words, chars, symbols, dup, repeats = counts_of(text)
        if out[d.doc_id].base_failed:
            continue
        lines = [x for x in text.split("\n") if WORD.search(x)]
        capitals = sum(unicodedata.category(c) == "Lu" for c in text)
        vector = [math.log(chars / words), math.log1p(100 * symbols / chars), math.log1p(100 * dup / len(lines)),
                  math.log1p(100 * repeats / words), math.sqrt(capitals / chars)]
        groups[d.lang].append((d.doc_id, vector))
    cut = chi2_quantile(1 - rules.TAIL, 5)
    checked = 0
    for members in groups.values():
        if len(members) < 40:
            continue
        want = slow_distances(np.array([v for _, v in members]))
        got = np.array([out[i].distance for i, _ in members])
        assert np.median(np.abs(got / want - 1)) < 0.1
        clear = np.abs(np.log(want / cut)) > 0.3  # bins let a few texts more into the inner share
        kept = np.array([out[i].kept for i, _ in members])
        assert (kept == (want <= cut))[clear].all()
        checked += len(members)
    assert checked > 300
