"""Operators over pages, embeddings and the benchmark, and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from shoprank.llm import decontaminate, html_text, pivot_search, url_filter
from shoprank.llm.common import table
from shoprank.llm.queries import QUERIES

from ..conftest import SF_SMALL
from . import brute
from .brute import DOCS, clashing, frame

# ---- op4 ----------------------------------------------------------------------------------------------------

URLS = [
    (1, "http://A.example.org/en/1x?q=/es/"), (2, "https://example.org/es/7"), (3, "https://sub.Example.ORG/en/2"), (4, "http://example.org"),
    (5, "http://notexample.org/es/"), (6, "http://x.com/fr/1#a"), (7, "http://com/de/"), (8, "http://x.com/en/"), (9, None), (10, ""),
    (11, "no scheme org/"), (12, "a://b://c/d"), (13, "http://x.net/" + "y" * 5000), (8, "http://x.com/en/"), (None, "http://é.org/fr/")]


def plain_rule(url):
    import re

    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = host.translate(brute.UP)
    fits = [(h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None)))


def test_url_rules(spark):
    df = clashing(spark.createDataFrame(URLS, "page_id long, url string").drop("host"))
    got = Counter((r.page_id, r.host, r.path, r.rule) for r in url_filter.url_verdicts(df).collect())
    assert got == Counter((i, *plain_rule(u)[:3]) for i, u in URLS)
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string")).collect() == []


def plain_scores(rows, order=5):
    """Witten-Bell models of both classes and scores of the texts without a rule, character by character."""
    count = {c: Counter() for c in "ab"}

    def grams(t):
        p = url_filter.START * order + t + url_filter.END
        return [p[i:i + order + 1] for i in range(len(t) + 1)]

    for t, c in rows:
        if c:
            for w in grams(t):
                for k in range(order + 1):
                    count[c][w[order - k:]] += 1
    follow = {c: {} for c in "ab"}
    for c in "ab":
        for g, n in count[c].items():
            follow[c].setdefault((len(g), g[:-1]), []).append(n)

    def prob(c, g):
        below = prob(c, g[1:]) if len(g) > 1 else 1 / 256
        ns = follow[c].get((len(g), g[:-1]))
        return (count[c][g] + len(ns) * below) / (sum(ns) + len(ns)) if ns else below

    return {t: sum(round((math.log2(prob("a", w)) - math.log2(prob("b", w))) * 1e6) for w in grams(t)) / (len(t) + 1) / 1e6 for t, c in rows if not c}


def test_url_model_against_plain_counts(spark):
    from pyspark.sql import functions as F

    out = url_filter.url_verdicts(table(spark, SF_SMALL, "pages", "page_id", "url")).collect()
    url = {r.page_id: r.url for r in table(spark, SF_SMALL, "pages", "page_id", "url").collect()}
    verdict = {u: plain_rule(u)[3] for u in url.values()}
    t = spark.createDataFrame([(u.translate(brute.UP), v) for u, v in verdict.items()], "t string, ruled string")
    held = {r.t for r in t.withColumn("held", F.pmod(F.xxhash64(F.lit(1), "t", "ruled"), F.lit(url_filter.CALIBRATION_FOLDS)) == 0).where("held").collect()}
    rows = [(u.translate(brute.UP), {"allow": "a", "block": "b", None: ""}[v]) for u, v in verdict.items() if v is None or u.translate(brute.UP) not in held]
    want = plain_scores(sorted(set(rows)))
    for r in out:
        assert (r.host, r.path, r.rule) == plain_rule(url[r.page_id])[:3]
        if r.rule is None:
            assert r.score == pytest.approx(want[url[r.page_id].translate(brute.UP)], abs=2e-6)
            assert r.verdict == ("allow" if r.score >= r.threshold else "block")
        else:
            assert r.verdict == plain_rule(url[r.page_id])[3]


def test_url_filter_is_native(spark):
    plan = QUERIES["op4_url_markov_filter"](spark, SF_SMALL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- op7 ----------------------------------------------------------------------------------------------------

def plain_top(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.floor(np.array([v for _, v in rows], np.float64) * 1024).astype(np.int64)
    out = set()
    for i, v in queries:
        s = x @ np.floor(np.array(v, np.float64) * 1024).astype(np.int64)
        own = np.flatnonzero(ids != i)
        out |= {(i, n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(own[np.lexsort((ids[own], -s[own]))][:k])}
    return out


def test_top_k_ties_clusters_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "TILE_ROWS", 16)
    monkeypatch.setattr(pivot_search, "PIVOTS", 6)
    rnd = np.random.default_rng(8)
    x = [*(rnd.normal(size=(150, 6)) * 0.05 + 1), *rnd.normal(size=(100, 6)) * 3, *[np.ones(6)] * 20, np.zeros(6)]
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [1.0, 2.0]), (904, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = pivot_search.top_k(df, df.where("vec_id % 7 = 0"), k=5).collect()
    assert {tuple(r) for r in got} == plain_top(rows, [r for r in rows if r[0] % 7 == 0], 5) and len(got) == len(set(got))


def test_top_k_of_repeated_query_rows(spark):
    rnd = np.random.default_rng(9)
    rows = [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(rnd.normal(size=(120, 5)))]
    rows += [rows[0]] * 2 + [(7, [1.0, -2.0, 3.0, 0.5, 0.25])]  # a row three times, and two vectors of one id
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [tuple(r) for r in pivot_search.top_k(df, df.where("vec_id % 7 = 0"), k=10).collect()]
    queries = {(i, tuple(v)) for i, v in rows if i % 7 == 0}
    want = Counter(x for q in queries for x in plain_top(rows, [q], 10))
    assert Counter(got) == want and len(got) == 10 * len(queries)


def test_top_k_query(spark):
    rows = [tuple(r) for r in table(spark, SF_SMALL, "embeddings", "vec_id", "embedding").collect()]
    got = pivot_search.op7_pivot_topk(spark, SF_SMALL).collect()
    assert {tuple(r) for r in got} == plain_top(rows, [r for r in rows if r[0] % 100 == 0], 10)


def test_top_k_empty_and_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in pivot_search.top_k(df, df).collect()} == {(0, 1, 100, 524288), (100, 1, 0, 524288)}
    assert pivot_search.top_k(df.limit(0), df).collect() == []


def test_top_k_of_wide_components(spark, monkeypatch):
    """Components beyond the index's bound, in candidates, in queries, in both, and in all rows."""
    monkeypatch.setattr(pivot_search, "TILE_ROWS", 8)
    rnd = np.random.default_rng(9)
    x = rnd.normal(size=(120, 4)) * np.where(rnd.random(120) < 0.2, 2e5, 3)[:, None]
    x[5], x[6] = 1.0e5, 1.0e5
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)]
    bad = [(900, [1e300, 1.0, 1.0, 1.0]), (901, [float(1 << 30), 0.0, 0.0, 0.0])]  # no score of theirs would fit
    for some in (rows, [r for r in rows if max(map(abs, r[1])) > 1024]):
        df = spark.createDataFrame(some + bad, "vec_id long, embedding array<double>")
        got = pivot_search.top_k(df, df.where("vec_id % 3 = 0"), k=4).collect()
        assert {tuple(r) for r in got} == plain_top(some, [r for r in some if r[0] % 3 == 0], 4) and len(got) == len(set(got))


def test_products_are_exact():
    rnd = np.random.default_rng(1)
    q, x = (rnd.integers(-(1 << 28), 1 << 28, (7, 9)).astype(np.int32) for _ in range(2))
    assert pivot_search.products(q, x).tolist() == [[sum(int(a) * int(b) for a, b in zip(u, v)) for v in x] for u in q]


# ---- op9 ----------------------------------------------------------------------------------------------------

def page(i, article, extra=""):
    return (f"<!DOCTYPE html><html><head><title>T{i}</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body>"
            f"<header><a href='/'>Site</a></header><nav><ul>" + "".join(f"<li><a>m{j}</a></li>" for j in range(2 + i % 3)) + "</ul></nav>"
            f"<!-- <p>hidden --> <div class='cookie-notice'>We use cookies</div>{extra}{article}"
            f"<section id='comments'><p>First!</p></section><form>Your name <input></form><footer>&copy; site</footer></body></html>")


def test_main_texts(spark):
    art = "<article><h1>A &amp; B {i}</h1><p>One\n two&nbsp;<b>three</b> {i}<p>Four &lt;five&gt;<br>six</article>"
    rows = [(i, f"http://h.org/{i}", page(i, art.format(i=i), "<aside>side</aside>" if i % 2 else "")) for i in range(6)]
    rows += [(50 + i, f"http://plain.net/{i}", page(i, f"<div class='wrap'><div><h5>Same line</h5><p>Own text {i} of this page</p><p>More {i}</p></div></div>"))
             for i in range(6)]
    rows += [(90, None, None), (91, "x", ""), (92, "http://h.org/z", "<p>cut <b>off &amp; here"), (92, "http://h.org/z", "<p>cut <b>off &amp; here"),
             (93, "http://long.org/", "<article>" + "<p>word</p>" * 5000 + "</article>"), (94, "http://t.org", "no markup <"), (None, "http://n.org", "<p>x</p>")]
    got = Counter((r.page_id, r.text) for r in html_text.main_texts(clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect())
    want = Counter((i, f"A & B {i}\n\nOne two three {i}\n\nFour <five> six") for i in range(6))
    want += Counter((50 + i, f"Own text {i} of this page\n\nMore {i}") for i in range(6))
    want += Counter([(90, ""), (91, ""), (92, "cut off & here"), (92, "cut off & here"), (93, "\n\n".join(["word"] * 5000)), (94, "no markup"), (None, "x")])
    assert got == want
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def texts(spark, rows):
    return {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_wrapper_decides_within_articles(spark):
    """Template lines go from articles, and an article of template texts only is not the main text."""
    art = "<article><div class='box'>Read more on our site</div><h1>Title {i}</h1><p>Own text {i} <b>here</b></p><div>&copy; us</div></article>"
    promo = "<html><body><article><p>Buy now</p></article><div class='x'><h2>Head {i}</h2><p>Long own text number {i}</p></div></body></html>"
    rows = [(i, f"http://a.org/{i}", page(i, art.format(i=i))) for i in range(5)] + [(10 + i, f"http://b.org/{i}", promo.format(i=i)) for i in range(5)]
    want = {i: f"Title {i}\n\nOwn text {i} here" for i in range(5)} | {10 + i: f"Head {i}\n\nLong own text number {i}" for i in range(5)}
    assert texts(spark, rows) == want
    alone = texts(spark, [(0, "http://a.org/0", rows[0][2])])  # the wrapper of one page knows no template
    assert alone == {0: "Read more on our site\n\nTitle 0\n\nOwn text 0 here\n\n© us"}


def test_main_text_is_not_lost(spark):
    body = "<html><head><title>T</title></head><body class='{c}'><nav>menu</nav><div class='page-widget'>{x}</div><div id='comments'>Hm</div></body></html>"
    rows = [(i, f"http://a{i}.org/", body.format(c=c, x=f"<article><h1>A</h1><p>Text {i} of the page</p></article>")) for i, c in enumerate(["has-sidebar", "tag-python", "x"])]
    rows += [(10, "http://c.org/", body.format(c="no-sidebar", x="<h1>A</h1><p>Text without an article element</p>"))]
    same = "<html><body><div><h1>Heading</h1><p>The only paragraph</p></div></body></html>"
    rows += [(20 + i, f"http://d.org/{i}", same) for i in range(6)]
    want = {i: f"A\n\nText {i} of the page" for i in range(3)} | {10: "A\n\nText without an article element"}
    assert texts(spark, rows) == want | {20 + i: "Heading\n\nThe only paragraph" for i in range(6)}


def test_shared_titles_stay(spark):
    art = "<article><h1>Title {i}</h1><h2>Summary</h2><p>Text {i} one</p><h2>Background</h2><p>Text {i} two</p><h3>Conclusion</h3><p>End {i}</p><div>Read more</div></article>"
    rows = [(i, f"http://a.org/{i}", page(i, art.format(i=i) if i % 2 else art.format(i=i).replace("<h2>Background</h2>", ""))) for i in range(9)]
    want = {i: f"Title {i}\n\nSummary\n\nText {i} one\n\n" + ("Background\n\n" if i % 2 else "") + f"Text {i} two\n\nConclusion\n\nEnd {i}" for i in range(9)}
    assert texts(spark, rows) == want


def test_deep_pages(spark):
    """Elements nested 100,000 deep, closed or not, block and inline, and lists in paragraphs: no text is lost."""
    n = 100_000
    rows = [(1, "http://a.org/1", "<article>" + "<div>" * n + "deep" + "</div>" * n + "<p>after</p></article>"),
            (2, "http://a.org/2", "<article>" + "<div>" * 1200 + "x<p>one<div>two</div>three"),
            (3, "http://a.org/3", "<article>" + "<b>" * n + "bold" + "</b>" * n + " plain</article>"),
            (4, "http://a.org/4", "<article><p>a<li>" + "<div>" * n + "b</article>"),
            (5, "http://a.org/5", "<article>" + "<ul><li>i" * 5000 + "</article>")]
    want = {1: "deep\n\nafter", 2: "x\n\none\n\ntwo\n\nthree", 3: "bold plain", 4: "a\n\nb", 5: "\n\n".join(["i"] * 5000)}
    assert texts(spark, rows) == want
    assert texts(spark, rows[:2] + [(9, "http://a.org/9", "<article>" + "<section>" * 3000 + "y")]) == {1: want[1], 2: want[2], 9: "y"}


def test_wrappers_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(html_text, "PARTIALS", 3)
    art = "<article><h1>T {i}</h1><p>Own {i} text</p><div>Read more</div></article>"
    df = spark.createDataFrame([(i, "http://a.org/x", page(i, art.format(i=i))) for i in range(60)], "page_id long, url string, html string")
    got = {(r.page_id, r.text) for r in html_text.main_texts(df.repartition(30)).collect()}
    assert got == {(i, f"T {i}\n\nOwn {i} text") for i in range(60)}


def test_wrapper_parts():
    one = html_text.expression(html_text.parse("<ul><li>a</li><li>b</li></ul><p>x</p><hr><p>x</p><hr>"))
    two = html_text.expression(html_text.parse("<p>y</p>"))
    e = html_text.merge(one, two)
    ul = e.parts[0]
    assert ul.optional and ul.parts[0].repeated and [p.key for p in e.parts][1].startswith("(p hr)")


def test_page_query(spark):
    import html
    import re

    pages = {r.page_id: r for r in table(spark, SF_SMALL, "pages").collect()}
    for r in html_text.op9_wrapper_extraction(spark, SF_SMALL).collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id].html, re.S)[1]
        body = re.sub(r"<[a-zA-Z/][^<>]*\Z", "", body)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(x for x in blocks if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


# ---- op10 ---------------------------------------------------------------------------------------------------

def test_leaks_of_whole_and_reworded_passages(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(rnd.randint(4, 9)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(18, 50)))) for i in range(12)] + [(50, None), (51, ""), (0, "x y")]
    text = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], set()
    for i in range(12):
        w = items[i][1].split()
        rows.append((i, f"{text(40)} {items[i][1].upper()}, {text(60)}", "en", "a"))
        for j in range(0, len(w) - 6, 7):  # every seventh word is another
            w[j] = word()
        rows.append((100 + i, f"{text(90)} {' '.join(w)} {text(10)}", "en", "a"))
        rows.append((200 + i, f"{text(30)} {' '.join(items[i][1].split()[:5])} {text(80)}", "en", "a"))  # a phrase is no leak
        want |= {(i, i), (100 + i, i)}
    rows += [(300, None, "en", "a"), (301, "", "en", "a"), (302, text(20_000) + " " + items[3][1], "en", "a"), (0, rows[0][1], "en", "a")]
    want.add((302, 3))
    rows += [(1000 + i, text(100), "en", "a") for i in range(150)]
    got = decontaminate.leaks(clashing(frame(spark, rows)), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(frame(spark), nothing).collect() == []
    assert decontaminate.leaks(frame(spark).limit(0), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_leak_query_against_every_pair(spark):
    """The whole query against checks of every item at every place of every document, without any search."""
    docs = table(spark, SF_SMALL, "documents", "doc_id", "text").collect()
    items = [(r.item_id, decontaminate._words_of_text(r.text)) for r in table(spark, SF_SMALL, "benchmark", "item_id", "text").collect()]
    got = {(r.doc_id, r.item_id) for r in decontaminate.op10_latent_decontamination(spark, SF_SMALL).collect()}
    words = {d.doc_id: decontaminate._words_of_text(d.text) for d in docs}
    held = Counter(w for x in words.values() for w in set(x.tolist()))
    gone = {tuple(x[i:i + decontaminate.GRAM].tolist()) for _, x in items for i in range(len(x) - decontaminate.GRAM + 1)}
    for x in words.values():  # words within the benchmark's own runs don't count as held
        mine, outside = x.tolist(), set()
        inside = np.zeros(len(mine), bool)
        for i in range(len(mine) - decontaminate.GRAM + 1):
            if tuple(mine[i:i + decontaminate.GRAM]) in gone:
                inside[i:i + decontaminate.GRAM] = True
        outside = {w for w, hide in zip(mine, inside) if not hide}
        held.subtract(set(mine) - outside)
    want = set()
    for item_id, x in items:
        heavy = {w for w in x.tolist() if max(held[w], 1) < max(decontaminate.COMMON * len(docs), 2.0)}
        one = decontaminate._Item(item_id, x, heavy)
        for d, y in words.items():
            n, size = len(y), len(x)
            if len(set(x.tolist()) & set(y.tolist())) < 0.5 * len(set(x.tolist())) * 0.5:
                continue  # fewer words in common than any share needs
            for first in {*range(0, max(1, n - decontaminate.WINDOW), decontaminate.STRIDE), max(0, n - decontaminate.WINDOW)}:
                part = y[max(0, first - size):first + decontaminate.WINDOW + size].tolist()
                _, share, answer = one.check(part)
                if share >= decontaminate.SHARE or (answer and share >= decontaminate.SHARE_WITH_ANSWER):
                    want.add((d, item_id))
                    break
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 3


@pytest.mark.parametrize("n, size", [(500, 38), (2000, 38), (300, 300)])
def test_leak_recall_of_many_and_long_items(spark, n, size):
    """Exact copies, and copies with every seventh word replaced, of items drawn from the same words."""
    rnd = random.Random(n + size)
    words = ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(7)) for _ in range(4000)]
    draw = lambda k: [rnd.choice(words) for _ in range(k)]
    items = [(i, " ".join(draw(size))) for i in range(n)]
    rows, want = [], set()
    for i, text in items:
        w = text.split()
        if i % 2:
            w[::7] = draw(len(w[::7]))
        rows.append((i, " ".join([*draw(rnd.randint(5, 25)), *w, *draw(20)]), "en", "a"))
        want.add((i, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & want) >= 0.99 * n and {x for x in want if x[0] % 2 == 0} <= got and len(got - want) <= 0.01 * n


def test_leaks_of_an_item_that_many_documents_hold(spark):
    rnd = random.Random(8)
    draw = lambda k: ["".join(rnd.choice("abcdefghiklmnoprstu") for _ in range(7)) for _ in range(k)]
    hot = draw(30)
    other = hot[:]
    other[::7] = draw(5)
    items = spark.createDataFrame([(0, " ".join(hot)), (1, "to be"), (2, "a")], "item_id long, text string")
    rows = [(i, " ".join([*draw(30), *(hot if i % 3 == 0 else other if i % 8 == 1 else []), *draw(30)]), "en", "a") for i in range(120)]
    want = {(i, 0) for i in range(120) if i % 3 == 0 or i % 8 == 1}
    for part, most in ((rows, 120), (rows[:3], 3), (rows[:1], 1)):
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, part), items).collect()}
        assert got == {x for x in want if x[0] < most}
    rows = [(i, "to be or not" if i < 15 else "a to b be", "en", "a") for i in range(20)]  # items of common words only
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame(spark, rows), items).collect()}
    assert {(i, 1) for i in range(15)} <= got and {(i, 2) for i in range(15, 20)} <= got


def test_common_subsequence():
    rnd = random.Random(6)
    for _ in range(200):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randint(0, 12))] for _ in "ab")
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1][j + 1] = d[i][j] + 1 if a[i] == b[j] else max(d[i][j + 1], d[i + 1][j])
        assert decontaminate.common_subsequence(decontaminate._bits(a), len(a), b) == d[-1][-1]


def test_retrieval_recall(spark):
    """Leaks found through the latent space against all documents that hold an item word for word."""
    items = {r.item_id: r.text for r in table(spark, SF_SMALL, "benchmark").collect()}
    docs = {r.doc_id: r.text for r in table(spark, SF_SMALL, "documents", "doc_id", "text").collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_latent_decontamination"](spark, SF_SMALL).collect()}
    assert exact and len(exact & got) >= 0.9 * len(exact)


# ---- pipeline -----------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, tmp_path):
    """Every stage against its contract on rows that go wrong easily, with the columns of documents kept."""
    docs = clashing(frame(spark, [(*r, len(r[1] or "")) for r in DOCS], brute.SCHEMA + ", n_chars long"))
    cols, at = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF_SMALL)
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        before, at = at, spark.read.parquet(path)
        seen[name] = at
        if name == "packing":
            break
        assert at.columns == cols
        ids = Counter(r.doc_id for r in at.select("doc_id").collect())
        if name == "language_id":
            assert {3, 4, 5, 10}.isdisjoint(ids) and {1, 6, 8, 9, 11, None} <= set(ids)
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            want = {d for d, _, c in brute.jaccard_components(rows) if d == c}
            assert set(ids) - {None} == want - {None} and all(n == 1 for d, n in ids.items() if d is not None)
        if name == "repeated_passages":
            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            want = Counter((d, k.decode("utf-8", "ignore")) for d, _, n, _, k in brute.without_repeats(rows, 200) if k or not n)
            assert Counter((r.doc_id, r.text) for r in at.select("doc_id", "text").collect()) == want
            assert all(r.n_chars == len(r.text) for r in at.select("text", "n_chars").collect())
    assert {r.doc_id for r in at.select("doc_id").collect()} == set(ids)


def test_pipeline_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    docs = table(spark, SF_SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_SMALL)
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert zlib.crc32(b"") == 0 and all(0 < r.length <= 2048 for r in got)
