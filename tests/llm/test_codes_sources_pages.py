"""Operators 11 to 13 against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkloom.llm import codes, divergence, pages, queries

# ---------------------------------------------------------------------------------------------------------------- 11


def plain_codes(rows, parts, entries, rounds):
    """(id: (code, error, label_error), digest) of rows (id, label, vector), by loops."""
    kept = sorted((r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: r[0])
    x = {r[0]: [math.floor(256 * v) for v in r[2]] for r in kept}
    width = len(kept[0][2]) // parts
    cut = {i: [v[p * width : (p + 1) * width] for p in range(parts)] for i, v in x.items()}
    books = [[list(cut[r[0]][p]) for r in kept[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, entry, strict=True)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for i in cut:
                own[nearest(p, cut[i][p])[1]].append(cut[i][p])
            for e, vs in own.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = {i: [nearest(p, cut[i][p]) for p in range(parts)] for i in cut}
    error = {i: sum(d for d, _ in f) for i, f in found.items()}
    of_label = Counter()
    for i, label, _ in kept:
        of_label[label] += error[i]
    digest = hashlib.sha256(",".join(str(c) for part in books for entry in part for c in entry).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in found[i]), error[i], of_label[label]) for i, label, _ in kept}, digest


VECTORS = "vec_id long, embedding array<double>, label int, id string, code int"


def vectors(rows):
    return [(i, v, label, "clash", 7) for i, label, v in rows]


def test_codes_against_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [None, 0, 1][i % 3], rng.normal(0, 0.2, 32).round(3).tolist()) for i in range(300)]
    rows += [(400 + i, 1, rows[5][2]) for i in range(40)]  # a group of copies
    rows += [(500, 1, None), (501, 1, [None] * 32), (502, 1, [float("nan")] * 32), (503, 1, [float("-inf")] * 32), (504, 9, [-3000.5] * 32), (505, 9, [2.0**19] * 32)]
    kept, codes.BLOCK = codes.BLOCK, 37
    try:
        out, books = codes.compress_vectors(spark, spark.createDataFrame(vectors(rows), VECTORS).repartition(5))
        got = {r.vec_id: (r.code, r.error, r.label_error) for r in out.collect()}
    finally:
        codes.BLOCK = kept
    assert (got, codes.books_digest(books)) == plain_codes(rows, 16, 64, 2)


def test_codes_of_odd_vectors(spark):
    few = [(2, 0, [0.1] * 16), (1, 0, [0.2] * 16), (1, 0, [0.2] * 16), (3, 0, [0.1] * 15), (4, None, []), (5, None, [1e7] * 16), (None, 1, [0.3] * 16)]
    out, books = codes.compress_vectors(spark, spark.createDataFrame(vectors(few), VECTORS))
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()), key=str)
    one, two, three = "00" * 16, "02" * 16, "03" * 16
    # of entries that are the same the first is taken, so the second copy's entry stays unused
    assert got == sorted([(1, one, 0, 0), (1, one, 0, 0), (2, two, 0, 0), (3, None, None, 0), (4, None, None, None), (5, None, None, None), (None, three, 0, 0)], key=str)
    assert books.shape == (16, 4, 1) and books[0, :, 0].tolist() == [51, 51, 25, 76]
    none, books = codes.compress_vectors(spark, spark.createDataFrame([], VECTORS))
    assert none.count() == 0 and codes.books_digest(books) == hashlib.sha256(b"").hexdigest()


def test_part_distances_in_both_widths():
    rng = np.random.default_rng(0)
    for span in (200, 1 << 27):
        x, entries = rng.integers(-span, span, (50, 4)), rng.integers(-span, span, (7, 4))
        kinds, places = zip(*(np.unique(x[:, d], return_inverse=True) for d in range(4)), strict=True)
        got = codes.part_distances(list(kinds), np.array(places), entries)
        assert (got == ((x[:, None] - entries[None]) ** 2).sum(axis=2)).all() and got.dtype == (np.int32 if span == 200 else np.int64)


# ---------------------------------------------------------------------------------------------------------------- 12


def plain_divergence(docs, least, top):
    """Rows (lang, source, part, item, value, rank) of docs (lang, source, text), by loops over all terms and groups."""
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(fold))) for a, b, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in in_docs.items() if n >= least}
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in own}}
        all_of = sum(counts.values(), Counter())

        def rate(c, t):
            return 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023

        for s in counts:
            pairs = [(-sum((rate(counts[s], t) - rate(counts[o], t)) ** 2 // (rate(counts[s], t) + rate(counts[o], t)) for t in kept), o) for o in counts if o != s]
            terms = [(-((rate(counts[s], t) - rate(all_of, t)) ** 2 // (rate(counts[s], t) + rate(all_of, t))), t) for t in kept if counts[s][t] and rate(counts[s], t) > rate(all_of, t)]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


DOCS = "doc_id long, text string, lang string, source string, n double, term string"


@pytest.mark.parametrize("sizes", [{}, {"POSTINGS": 16, "SLAB": 2, "CELLS": 8, "HELD": 20, "PIECE": 40}])
def test_divergence_against_loops(spark, edges, sizes):
    rng = np.random.default_rng(5)
    letters = ["alpha", "beta", "Gamma", "delta", "Éps", "ζeta", "eta", "theta", "iota", "kap", "a", "B"]
    docs = [(rng.choice(["en", "de"]), rng.choice(list("pqrstuv") + ["é"]), " ,".join(rng.choice(letters, rng.integers(0, 60), p=np.array([12 - k for k in range(12)]) / 78))) for _ in range(160)]
    docs += [("en", "hot", "alpha beta alpha")] * 80 + [("en", None, None), (None, "p", ""), (None, None, "12 3"), ("fr", "solo", "mot " * 3), ("en", "long", "gamma " * 5000)]
    df = spark.createDataFrame([(i, t, a, s, 0.0, "clash") for i, (a, s, t) in enumerate(docs)], DOCS).repartition(6)
    kept = {k: getattr(divergence, k) for k in sizes}
    try:
        for k, v in sizes.items():
            setattr(divergence, k, v)
        got = sorted(tuple(r) for r in divergence.source_divergence(spark, df, least_docs=10, top=4).collect())
    finally:
        for k, v in kept.items():
            setattr(divergence, k, v)
    assert got == plain_divergence(docs, 10, 4)


def test_divergence_of_little(spark, edges, nothing):
    assert divergence.source_divergence(spark, nothing).count() == 0
    docs = [(r.lang, r.source, r.text) for r in edges.collect()]
    for least in (1, 10):
        got = sorted(tuple(r) for r in divergence.source_divergence(spark, edges, least_docs=least).collect())
        assert got == plain_divergence(docs, least, 10)


# ---------------------------------------------------------------------------------------------------------------- 13

PROSE = "It was the first of the long days in which the river rose to the edge of the town, and all of us were there to see it."
OTHER = "The mayor said that he had not slept, that the wall would hold, and that it was a matter of time until help was on the way."
NOTICE = "We use cookies to make this site work for you and to see how it is used; by going on you say that this is fine with you."

PAGES = {
    "article": (
        f"<html><head><title>The river</title><style>p {{ a: '</p>' }}</style></head><body class='has-sidebar'><header><a href='/'>Home</a><p>{OTHER}</p></header><nav><ul><li><a href=a>A</a><li><a href=b>B</a></ul></nav>"
        f"<article><header><h1>The river</h1></header><p>{PROSE}<p>Sh is.<p>{OTHER} <span class='ad'>Buy &amp; save</span> And more.<div class='share'>Share this with all of the people that you know</div></article>"
        f"<aside><p>{PROSE}</p></aside><section id=comments><article class=comment-body><p>{OTHER}</p></article></section><form>{PROSE}<input></form><footer>{PROSE}</footer></body></html>",
        ["The river", PROSE, "Sh is.", f"{OTHER} And more."],
    ),
    "divs": (
        f"<DIV ID='cookie-notice'><P>{NOTICE}</P></DIV><div class=menu><a href=x>One</a> | <a href=y>Two</a></div><div id=content><h2>Title &lt;b&gt; &eacute;&#233;&#xe9;&nbsp;x</h2><p>{PROSE}</p>"
        f"<ul><li>one of them<li>two of them</ul><p>{OTHER}</p></div><div class='sidebar'><p>{PROSE}</p></div><div class='reader-comments'><p>{PROSE}</p></div><div class='legal'>{OTHER}</div>",
        ["Title <b> ééé x", PROSE, "one of them", "two of them", OTHER],
    ),
    "no hints": (
        f"<p><a href=1>Start</a> <a href=2>News</a></p><p>{PROSE}</p><p>Short one.</p><p>{OTHER}</p><p><a href=3>{OTHER}</a></p><p>Contact us</p>",
        [PROSE, "Short one.", OTHER],
    ),
    "wrapper": (f"<div class='page with-sidebar sidebar'><p>{PROSE}</p><p>{OTHER}</p></div>", [PROSE, OTHER]),
    "open ends": (f"<main><p>a < b && c > d, {PROSE}<br>{OTHER}<table><tr><td>of the one<td>of the two</table><b><p>{PROSE}</b> &am <a title='x > y' href='z'>z</a></main", [f"a < b && c > d, {PROSE} {OTHER}", "of the one", "of the two", f"{PROSE} &am z"]),
    "quotes": (f"<article><p title=don't>{PROSE}</p><p title=\"a > b\" data-x='<p>'>{OTHER}</p><!-- {PROSE} --><!-->still<script>if (a</b) '<p>'</script> here</article>", [PROSE, OTHER, "still here"]),
    "no prose": ("<nav><a href=a>a</a></nav><article><h1>x | y</h1><p>qwx zzk | prt | mnop | vvv | kkk lll mmm ppp rrr ttt zzz</p><p>b</p></article><footer>of the</footer>", ["x | y", "qwx zzk | prt | mnop | vvv | kkk lll mmm ppp rrr ttt zzz", "b"]),
    "empty": ("", []),
    "no text": ("<html><body><nav>of the menu</nav></body></html>", []),
    "script only": ("<script>" + "x" * 50, []),
    "deep": ("<div>" * 3000 + f"<p>{PROSE}" + "</div>" * 3000, [PROSE]),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text_of_made_pages(name):
    page, expected = PAGES[name]
    assert pages.main_text(page).split("\n") == (expected or [""])


def test_pages_of_the_table(spark, sf):
    """The articles of the table's pages, as their markup shows them."""
    import html

    for r, page in zip(queries.op13_html_extraction(spark, sf).orderBy("page_id").collect(), spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect(), strict=True):
        article = re.search("(?s)<article>(.*?)</article>", page.html)[1]
        own = [" ".join(html.unescape(re.sub("</?b>|<br>", "", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert (r.page_id, r.url, r.text, r.n_chars) == (page.page_id, page.url, "\n".join(x for x in own if x), len(r.text))


def test_pages_with_odd_rows(spark):
    page = PAGES["no hints"]
    rows = [(1, page[0], "clash"), (1, page[0], "clash"), (None, None, None), (2, "", "x"), (3, "<p>" + PROSE * 20_000, "long")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in pages.extract_text(df).collect()), key=lambda r: (r[0], r[1]))
    text = "\n".join(page[1])
    assert [g[:1] + g[2:] for g in got] == [(0, 0), (1, len(text)), (1, len(text)), (2, 0), (3, len(PROSE) * 20_000)] and got[1][1] == text
    assert pages.extract_text(df.where("false")).count() == 0
    listed = pages.page_blocks(df.where("page_id = 1").limit(1)).orderBy("place").collect()
    assert [r.text for r in listed if r.kept] == page[1] and [r.place for r in listed] == list(range(len(listed)))


def test_nearest_decided_label():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = rng.integers(1, 12)
        label, run, heading, otherwise = rng.integers(-1, 2, n), np.cumsum(rng.integers(0, 2, n)), rng.integers(0, 2, n) == 1, rng.choice([-1, 1], n)
        expected = []
        for i in range(n):
            known = [j for j in range(n) if run[j] == run[i] and label[j] != 0]
            if label[i] or not known:
                expected.append(label[i] or otherwise[i])
            else:
                expected.append(label[min(known, key=lambda j: (abs(i - j), (j < i) if heading[i] else (j > i)))])
        assert pages.inherit(label, run, heading, otherwise).tolist() == expected
