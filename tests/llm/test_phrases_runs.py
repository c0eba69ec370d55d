"""Collocations, SimHash components and periodic runs against plain versions of their contracts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from shoprank.llm import collocations, periodic, simhash
from shoprank.llm.common import table
from shoprank.llm.queries import ORACLE, QUERIES

from ..conftest import SF_SMALL
from . import brute
from .brute import DOCS, clashing, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")

# ---- op11 ---------------------------------------------------------------------------------------------------


def plain_phrases(rows, most=3, least=10, top=2000, cover=50):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = defaultdict(list)
    for (lang, p), a in cand.items():
        if any(lang == g and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= cover * a
               for (g, q), b in cand.items()):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:top])}


def phrase_rows(seed):
    rnd = random.Random(seed)
    vocab = ["a", "b", "c", "Dé", "e f", "日本"]
    rows = [(None, "en"), ("", "en"), (" \t ", None), ("...!?", "de"), ("no lang here", None)]
    for _ in range(300):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(0, 40))]
        rows.append(("".join(w + rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", "]) for w in words), rnd.choice(["en", "de", None])))
    rows += [("the same long line of words without any stop that is here many times over and over again", "en")] * 12
    return rows


@pytest.mark.parametrize("most, parts", [(3, 1), (3, 7), (4, 3), (2, 3)])
def test_phrases(spark, monkeypatch, most, parts):
    monkeypatch.setattr(collocations, "HELD", 40)
    monkeypatch.setattr(collocations, "BLOCK", 200)
    monkeypatch.setattr(collocations, "TRIGGER", 3)
    monkeypatch.setattr(collocations, "SHORT", 4)
    monkeypatch.setattr(collocations, "PART", 50)
    monkeypatch.setattr(collocations, "LONGEST", 12)
    monkeypatch.setattr(collocations, "SLOTS", 1 << 10)
    rows = phrase_rows(most * 10 + parts)
    df = clashing(spark.createDataFrame(rows, "text string, lang string").repartition(parts))
    got = {tuple(r) for r in collocations.collocations(df, max_words=most, top=50).collect()}
    assert got == plain_phrases(rows, most, top=50) and len(got) > 50


def test_parse_counts_overlaps_once():
    words = [b"%d" % (i * i % 7) for i in range(200)]
    whole, _ = collocations.parsed(words, 2)
    assert len(whole) > 3
    again = []
    for c in whole:
        again += c.split() if c.endswith(b"\n") else c.split()[:-2]
    assert again == words and all(c.split()[-2:] == d.split()[:2] for c, d in zip(whole, whole[1:]))


def test_phrases_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, "en"), ("x y", "en")], empty.schema)).collect() == []


def test_phrase_arithmetic_is_exact(spark):
    big = 3 * 10**11 + 7
    rows = spark.createDataFrame([(big, big + 11, big + 5)], "a long, l long, r long")
    got = rows.selectExpr("1000000 * CAST(a AS DECIMAL(16)) * CAST(a AS DECIMAL(16)) DIV (CAST(l AS DECIMAL(16)) * CAST(r AS DECIMAL(16))) AS s").first().s
    assert got == 10**6 * big * big // ((big + 11) * (big + 5))


def test_phrase_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    res = con.execute(ORACLE["op11_phrase_collocations"])
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    got = QUERIES["op11_phrase_collocations"](spark, SF_SMALL)
    assert got.columns == cols and Counter(map(tuple, got.collect())) == Counter(want) and want


# ---- op12 ---------------------------------------------------------------------------------------------------


def plain_fingerprint(text, k=3):
    w = WORD.findall((text or "").translate(brute.UP))
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def plain_components(rows, radius=2):
    fps = [f for _, f in rows]
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = list(root)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return Counter((d, f"{f:016x}", least.get(find(f))) for d, f in rows)


def test_simhash_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 1000)
    got = Counter(map(tuple, simhash.simhash_components(clashing(frame(spark))).collect()))
    assert got == plain_components([(d, plain_fingerprint(t)) for d, t, *_ in DOCS])
    assert simhash.simhash_components(frame(spark).where("false")).collect() == []


def test_every_close_pair_shares_a_table():
    for radius in (2, 4):
        family = simhash.masks(radius)
        assert len(family) == 2 ** (radius + 1) - 1 and {m.bit_count() for m in family} <= {32, 33, 34, 35, 36, 37, 38, 39, 40}
    family = simhash.masks(2)
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in family) for i in range(64) for j in range(i + 1))


@pytest.mark.parametrize("group", [1, 3, 32])
@pytest.mark.parametrize("radius", [2, 4])
def test_links_of_clusters(spark, monkeypatch, group, radius):
    """Chains and dense balls of fingerprints, small and large keys, keys cut by partitions."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rnd = random.Random(group)
    fps = set()
    for _ in range(25):
        x = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 4, 40])):
            fps.add(x)
            for _ in range(rnd.randint(1, 4)):
                x ^= 1 << rnd.choice([rnd.randrange(64), rnd.randrange(3)])
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(simhash._signed(f),) for _, f in rows], "fp long").repartition(5)
    links = [(r.fp % 2**64, r.other % 2**64) for r in simhash.fingerprint_links(df, radius).collect()]
    assert all(0 < (a ^ b).bit_count() <= radius for a, b in links)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = plain_components(rows, radius)
    by = defaultdict(set)
    for i, f in rows:
        by[find(f)].add(i)
    assert Counter((i, f"{f:016x}", min(by[find(f)])) for i, f in rows) == want


def test_null_ids_carry_links(spark, monkeypatch):
    a, b, c = 0b1, 0b111, 0b11111
    monkeypatch.setattr(simhash, "fingerprints", lambda df, *_: df.selectExpr("doc_id", "CAST(text AS long) AS fp"))
    df = spark.createDataFrame([(7, str(a)), (None, str(b)), (3, str(c)), (None, str(255 << 40))], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect()}
    assert got == {(7, 3), (None, 3), (3, 3), (None, None)}


def test_simhash_query(spark):
    got = Counter(map(tuple, QUERIES["op12_covering_simhash"](spark, SF_SMALL).collect()))
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in table(spark, SF_SMALL, "documents", "doc_id", "text").collect()]
    assert got == plain_components(rows)


# ---- op13 ---------------------------------------------------------------------------------------------------


def plain_runs(w, least=24, times=3):
    n, seen = len(w), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(least, times * p):
                seen.setdefault((s, i + p - s), p)
    return sorted(((s, size, p) for (s, size), p in seen.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, plant=True):
    w = WORD.findall(text or "")
    n = len(w)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, size, p in runs for i in range(s + p, s + size)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{size},{p}\n" for s, size, p in runs), " ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest)


def test_runs_of_random_sequences():
    rnd = random.Random(4)
    total = 0
    for _ in range(600):
        n, letters, w = rnd.randint(0, 120), rnd.choice([1, 2, 2, 3, 5]), []
        while len(w) < n:
            w += [rnd.randrange(letters) for _ in range(rnd.randint(1, 6))] if rnd.random() < 0.4 or not w else w[-rnd.randint(1, 8):] * rnd.randint(1, 6)
        for least, times in ((24, 3), (3, 3), (6, 3), (9, 4)):
            want = plain_runs(w[:n], least, times)
            assert periodic.word_runs(np.array(w[:n], np.int32), least, times) == want
            total += len(want)
    assert total > 3000


def test_suffix_tree_against_plain_prefixes():
    rnd = random.Random(5)
    for _ in range(60):
        w = np.array([rnd.randrange(rnd.choice([1, 2, 4])) for _ in range(rnd.randint(1, 60))])
        tree = periodic.SuffixTree(w)
        text = w.tolist()
        assert sorted(range(len(text)), key=lambda i: text[i:]) == sorted(range(len(text)), key=lambda i: int(tree.rank[i]))
        i, j = (np.array(x) for x in zip(*[(i, j) for i in range(len(text) + 1) for j in range(len(text) + 1) if i != j]))
        plain = [next((k for k, (a, b) in enumerate(zip(text[x:], text[y:])) if a != b), len(text) - max(x, y)) for x, y in zip(i.tolist(), j.tolist())]
        assert tree.common(i, j).tolist() == plain


def test_runs_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic, "PART", 300)
    more = [(i, " ".join(["Ab", "ab", "é x"] * 12) + " end " + "z " * 30, "en", "a") for i in range(100, 130)]
    df = clashing(frame(spark, DOCS + more))
    got = Counter((r.doc_id, tuple((x.start, x.length, x.period) for x in r.runs), r.start, r.length, r.period, r.collapsed)
                  for r in periodic.periodic_runs(df).collect())
    want = Counter()
    for d, t, *_ in DOCS + more:
        w = WORD.findall(t or "")
        runs = plain_runs(w) if len(w) < 5000 else []  # the long texts of DOCS have a period of over a third
        gone = {i for s, size, p in runs for i in range(s + p, s + size)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0]), default=(None,) * 3)
        want[d, tuple(runs), *best, " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    assert got == want
    assert periodic.periodic_runs(frame(spark).where("false")).collect() == []
    with pytest.raises(ValueError):
        periodic.word_runs(np.zeros(9, np.int32), 24, 2)


def test_long_period_in_a_long_text():
    w = np.resize(np.random.default_rng(3).integers(0, 5000, 40_000), 150_000).astype(np.int32)
    w[:10] = 9999
    assert periodic.word_runs(w) == [(10, 149_990, 40_000)]


def test_periodic_query(spark):
    got = Counter(map(tuple, QUERIES["op13_periodic_runs"](spark, SF_SMALL).collect()))
    rows = table(spark, SF_SMALL, "documents", "doc_id", "text").collect()
    want = Counter(plain_row(r.doc_id, r.text) for r in rows if len(r.text or "") < 15_000)
    assert not want - got and sum(want.values()) > 150 and any(r[1] for r in want)
