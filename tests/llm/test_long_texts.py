"""Texts much longer than a block: the same results as with blocks that hold them whole, and bounded working memory."""

import random
import tracemalloc

import numpy as np

from shoprank.llm import common, decontaminate, jaccard, langid, suffix_dedup, toxicity
from shoprank.llm.common import table

from ..conftest import SF_SMALL
from . import brute


def long_rows():
    rnd = random.Random(6)
    words = ["alpha", "Bravo", "charlie", "delta", "écho", "fox", "golf-", "hôtel", "x1"] + [f"w{i}" for i in range(300)]
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\n", "  ", ". "]) for _ in range(n))
    base = text(9000)
    cut = len(base) // 3
    return [(1, base), (2, base[:cut] + "changed here " + base[cut:]), (3, base[2000:2600] + text(3000)), (4, text(50)), (5, "y" * 30_000), (6, "z " * 9000), (7, None), (8, "")]


def test_parts_hold_every_word_once():
    for _, text in long_rows():
        data = np.frombuffer((text or "").encode(), np.uint8)
        parts = list(common.spaced_parts(data, 700))
        assert b"".join(data[a:b].tobytes() for a, b in parts) == data.tobytes()
        assert [w for a, b in parts for w in data[a:b].tobytes().split()] == data.tobytes().split()


def test_sets_of_parts_are_the_whole_sets(monkeypatch):
    for _, text in long_rows():
        data = np.frombuffer((text or "").encode(), np.uint8)
        offs = np.array([0, len(data)])
        whole = [x.tolist() for x in jaccard.shingle_sets(data, offs)], [x.tolist() for x in decontaminate._hashed_words(data, offs)]
        with monkeypatch.context() as m:
            m.setattr(common, "BLOCK_BYTES", 700)
            assert ([x.tolist() for x in jaccard.shingle_sets(data, offs)], [x.tolist() for x in decontaminate._hashed_words(data, offs)]) == whole


def test_windows_of_parts_are_the_whole_windows(monkeypatch):
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 101, 20_000).astype(np.uint8)
    whole = suffix_dedup.pieces(data, np.array([0, len(data)]))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1500)
    by = {}
    for base, part, offs in suffix_dedup._parts(data, np.array([0, len(data)]), 200):
        _, first, windows, anchor = suffix_dedup.pieces(part, offs)
        for f, w, a in zip((first + base).tolist(), windows.tolist(), (anchor + base).tolist()):
            for i in range(f, f + w):
                assert i not in by
                by[i] = a
    want = {i: a for f, w, a in zip(whole[1].tolist(), whole[2].tolist(), whole[3].tolist()) for i in range(f, f + w)}
    assert by == want and len(by) == len(data) - 199


def test_covered_runs():
    got = suffix_dedup._gone(np.array([50, 0, 10, 90, 60]), np.array([60, 5, 40, 95, 70]))
    assert [x.tolist() for x in got] == [[0, 10, 50, 90], [5, 40, 70, 95]]


def test_features_of_parts_are_the_whole_features(spark, monkeypatch):
    rows = table(spark, SF_SMALL, "documents", "text").collect()
    lexicon = toxicity.Lexicon(["blorpish", "snark"])
    raw = np.frombuffer(("\n".join(r.text for r in rows[:30]) + " blorpis 'snark' he said " + rows[31].text + " snark").lower().encode(), np.uint8)
    offs = np.array([0, len(raw)])
    whole = toxicity.features(raw, offs, lexicon)
    monkeypatch.setattr(common, "BLOCK_BYTES", 900)
    assert toxicity.features(raw, offs, lexicon).tolist() == whole.tolist() and whole[0, 0] == 1


def test_three_megabytes_through_spark(spark):
    """Texts of several blocks: near copies, a passage across a block's edge, a language change."""
    rnd = random.Random(8)
    words = [f"w{i:x}q" for i in range(200_000)]
    base = " ".join(rnd.choice(words) for _ in range(420_000))
    raw = base.encode()
    assert len(raw) > 2.5 * (1 << 20)
    mid, edge = len(raw) // 2, 1 << 20
    passage = raw[edge - 500:edge + 700].decode()
    alone = " ".join(rnd.choice(words) for _ in range(300_000))
    rows = [(1, base), (2, base[:mid] + "#" + base[mid:]), (3, "before " + passage + " after"), (4, alone)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.without_repeats(df).collect()}
    assert got[1] == (len(raw), len(raw), 1, b"") and got[2] == (len(raw) + 1, len(raw), 2, b"#")
    assert len(passage) <= got[3][1] <= len(passage) + 2 and got[3][2] == 1  # blanks beside the passage may be the same too
    assert got[4] == (len(alone), 0, 0, alone.encode())
    sets = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert sets == {d: (len(brute.shingles(t)), {2: 1}.get(d, d)) for d, t in rows}
    known = {r.lang: r.text for r in table(spark, SF_SMALL, "documents", "text", "lang").where("n_chars > 1500").collect()}
    mixed = " ".join([known["de"]] * 900) + " " + " ".join([known["en"]] * 700)
    model = langid.learn(table(spark, SF_SMALL, "documents"))
    r = langid.label(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model).first()
    assert len(mixed.encode()) > (1 << 21) and r.lang_pred == ("de" if len(known["de"]) * 900 > len(known["en"]) * 700 else "en")
    assert r.spans[0].first == 0 and {s.lang for s in r.spans} >= {"de", "en"} and all(x.end <= y.first for x, y in zip(r.spans, r.spans[1:]))
    assert r.spans[-1].end >= len(mixed.encode()) - 5


def test_working_memory_of_a_long_text():
    """Word hashing and piece cutting of 24 MB take a few bytes a byte, not fifty."""
    data = np.frombuffer(b" ".join(b"word%d" % (i % 50_000) for i in range(2_400_000)), np.uint8)
    offs = np.array([0, len(data)])
    tracemalloc.start()
    jaccard.shingle_sets(data, offs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    for _, part, at in suffix_dedup._parts(data, offs, 200):
        suffix_dedup.pieces(part, at)
    pieces = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 * len(data) and pieces < 8 * len(data)
