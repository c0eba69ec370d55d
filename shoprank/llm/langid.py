"""Language identification of mixed texts: script ranges, per-word scores, Viterbi with a switching penalty.

Learning counts, per language, the letter trigrams of its words (hashed to a fixed number of buckets) and the bytes
of each script. A word's script leaves as candidates the languages that are written in it; its score in a language
is the sum of its trigrams' smoothed log-probabilities. The best path through a text's words, where every change of
language costs ``penalty``, labels spans; the text's language is the one whose spans hold most letter bytes.

Distribution: learning is one pass with counts summed inside each task before they are shuffled; the model is
languages x BUCKETS numbers whatever the input's size (that bound is checked before it is sent to the workers).
Labelling is one pass without a shuffle; a long text is handled whole, many texts advance through the path search
together.

Null texts, empty texts and texts without a letter get ``und`` and score 0. Without any labelled row all texts get
``und``. Repeated rows get equal labels; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, spaced_parts, table, text_blocks, tidied, with_fields

BUCKETS = 1 << 16
PENALTY = 12.0
#: A language is a candidate for a script that holds at least this share of its letters.
SCRIPT_SHARE = 0.01
#: Score per word of a language that the word's script rules out.
RULED_OUT = -200.0
#: Most languages that a model may have (256 KB each).
MAX_LANGUAGES = 256

#: Script by first code point of its ranges; a range ends where the next begins.
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1800, "Mongolian"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x3040, "Kana"), (0x3400, "Han"),
    (0xAC00, "Hangul"), (0xD7B0, "Other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})


def _fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin-1 capitals (two bytes, C3 80 to C3 9E); other bytes as they are."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[second] += 32
    return out


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of words: a-z, and those of signs beyond ASCII but for Latin-1 signs and general punctuation."""
    ok = ((data >= 97) & (data <= 122)) | (data >= 0x80)
    c2 = np.flatnonzero(data == 0xC2)
    ok[c2] = False
    ok[c2 + 1] = False
    for a, lo, hi in ((0xE2, 0x80, 0x81), (0xE3, 0x80, 0x80)):
        x = np.flatnonzero(data == a)
        x = x[(data[x + 1] >= lo) & (data[x + 1] <= hi)]
        for k in range(3):
            ok[x + k] = False
    x = np.flatnonzero((data == 0xC3))
    x = x[(data[x + 1] == 0x97) | (data[x + 1] == 0xB7)]
    ok[x] = False
    ok[x + 1] = False
    return ok


def _script_of_word(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index into SCRIPTS by the first code point of each word."""
    b = data[starts].astype(np.int32)
    n = len(data) - 1
    x, y = (data[np.minimum(starts + k, n)].astype(np.int32) & 0x3F for k in (1, 2))
    cp = np.where(b < 0x80, b, np.where(b < 0xE0, (b & 0x1F) << 6 | x, np.where(b < 0xF0, (b & 0x0F) << 12 | x << 6 | y, 0xFFFF)))
    first = np.array([a for a, _ in SCRIPT_RANGES])
    ids = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES], np.int32)
    return ids[np.searchsorted(first, cp, side="right") - 1]


def words_of(data: np.ndarray, offs: np.ndarray):
    """(start, end, row, script, trigram bucket of every word byte) of a block of texts."""
    low = _fold_case(data)
    ok = _letters(low)
    low[~ok] = 0
    edge = np.zeros(len(low) + 1, bool)
    edge[offs] = True
    before, after = np.zeros_like(low), np.zeros_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    before[edge[:-1]] = 0
    after[edge[1:]] = 0
    starts = np.flatnonzero(ok & (before == 0))
    ends = np.flatnonzero(ok & (after == 0)) + 1
    at = np.flatnonzero(ok)
    code = (before[at].astype(np.uint32) << np.uint32(16)) | (low[at].astype(np.uint32) << np.uint32(8)) | after[at]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    row = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, row, _script_of_word(low, starts) if len(starts) else row, bucket


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray, np.ndarray, int]:
    """(languages, log-probabilities [BUCKETS, languages], candidates [scripts, languages], commonest) of labelled rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for lo, hi, data, offs in text_blocks(batch, "text"):
                if not len(data):
                    continue
                starts, ends, row, script, bucket = words_of(data, offs)
                size = ends - starts
                for lang in set(langs[lo:hi]):
                    mine = langs[lo:hi][row] == lang
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS + len(SCRIPTS), np.int64)
                    own = np.repeat(mine, size)
                    sums[lang][:BUCKETS] += np.bincount(bucket[own], minlength=BUCKETS)
                    sums[lang][BUCKETS:] += np.bincount(script[mine], weights=size[mine], minlength=len(SCRIPTS)).astype(np.int64)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])],
                                             names=["lang", "bucket", "n"])

    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(tidied(count), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got: dict[str, list] = {}
    # at most BUCKETS + scripts rows a language; the language bound is checked as rows arrive
    for r in counts.toLocalIterator():
        got.setdefault(r.lang, []).append((r.bucket, r.n))
        if len(got) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(got)
    c = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    for i, x in enumerate(langs):
        b, n = np.array(got[x]).T
        c[b, i] = n
    logp = np.log((c[:BUCKETS] + 0.5) / (c[:BUCKETS].sum(0) + 0.5 * BUCKETS)).astype(np.float32)
    share = c[BUCKETS:] / np.maximum(c[BUCKETS:].sum(0), 1)
    cand = share >= SCRIPT_SHARE
    cand[~cand.any(1)] = True
    return langs, logp, cand, int(c[:BUCKETS].sum(0).argmax()) if langs else 0


def best_paths(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Language of every word on its text's best path.

    scores [words, languages]; text d has the words first[d] .. first[d]+count[d]-1. All texts step together, longest
    first, so the number of steps is the longest text's number of words.
    """
    order = np.argsort(-count, kind="stable")
    at, num = first[order], count[order]
    steps = int(num[0]) if len(num) else 0
    active = len(num) - np.searchsorted(num[::-1], np.arange(1, steps + 1), side="left")
    stay = np.ones(scores.shape, bool)
    best = np.zeros(len(scores), np.uint8)
    v = np.zeros((len(num), scores.shape[1]), np.float64)
    for t in range(steps):
        k = active[t]
        w = at[:k] + t
        u = v[:k]
        if t:
            top = u.max(1, keepdims=True)
            top -= penalty
            stay[w] = u >= top
            np.maximum(u, top, out=u)
        u += scores[w]
        best[w] = u.argmax(1)
    path = np.zeros(len(scores), np.uint8)
    now = np.zeros(len(num), np.uint8)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        w = at[:k] + t
        new = active[t + 1] if t + 1 < steps else 0
        now[new:k] = best[w[new:]]
        path[w] = now[:k]
        if t:
            leave = ~stay[w, now[:k]]
            now[:k][leave] = best[w[leave] - 1]
    return path


def label(df: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray, int], text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
          penalty: float = PENALTY) -> DataFrame:
    """Columns ``carry`` with (lang_pred, score, spans) of every row; a span is (first byte, end byte, lang) of words of one language.

    score: the share of the text's letter bytes in spans of its language. A text whose only letters are outside the word ranges
    (ordinals and the like) gets the commonest language with score 0.
    """
    langs, logp, cand, common = model
    shut = np.where(cand, np.float32(0), np.float32(RULED_OUT)).astype(np.float32)
    sent = df.sparkSession.sparkContext.broadcast((langs, logp, shut))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        langs, logp, shut = sent.value
        names = np.array([*langs, "und"], object)
        letter = regex.compile(r"\p{L}")
        width = max(1, len(langs))
        part = max(1 << 16, (6 << 20) // width)
        for batch in batches:
            for lo, hi, data, offs in text_blocks(batch, text_col, 2 << 20):
                n = hi - lo
                s, e, r, m = [], [], [], []
                a = 0
                while a < n and langs:  # scores are made in smaller parts, paths are sought over all
                    b = min(n, max(a + 1, int(np.searchsorted(offs, offs[a] + part, side="right")) - 1))
                    # a long text is scored part by part
                    own = data[offs[a]:offs[b]]
                    parts = spaced_parts(own, part) if b == a + 1 and len(own) > 2 * part else [(0, len(own))] if len(own) else []
                    for x, y in parts:
                        starts, ends, row, script, bucket = words_of(own[x:y], offs[a:b + 1] - offs[a] if (x, y) == (0, len(own)) else np.array([0, y - x]))
                        if len(starts):
                            size = ends - starts
                            heads = np.cumsum(size) - size
                            m.append(np.add.reduceat(logp[bucket], heads, axis=0) + shut[script])
                            s.append(starts + offs[a] + x)
                            e.append(ends + offs[a] + x)
                            r.append(row + a)
                    a = b
                pred, score, spans = np.full(n, len(langs)), np.zeros(n), [[] for _ in range(n)]
                if s:
                    s, e, r, m = np.concatenate(s), np.concatenate(e), np.concatenate(r), np.concatenate(m)
                    count = np.bincount(r, minlength=n)
                    path = best_paths(m, np.cumsum(count) - count, count, penalty)
                    held = np.bincount(r * width + path, weights=e - s, minlength=n * width).reshape(n, width)
                    has = count > 0
                    pred = np.where(has, held.argmax(1), len(langs))
                    score = np.where(has, held.max(1) / np.maximum(held.sum(1), 1), 0.0)
                    turn = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (r[1:] != r[:-1])]))
                    last = np.append(turn[1:], len(path)) - 1
                    base = offs[r[turn]]
                    for d, x, y, z in zip(r[turn].tolist(), (s[turn] - base).tolist(), (e[last] - base).tolist(), path[turn].tolist()):
                        spans[d].append({"first": x, "end": y, "lang": langs[z]})
                for d in np.flatnonzero(_doubtful(data, offs)).tolist():
                    text = data[offs[d]:offs[d + 1]].tobytes().decode("utf-8", "replace")
                    if not letter.search(text):
                        pred[d], score[d], spans[d] = len(langs), 0.0, []
                    elif pred[d] == len(langs) and langs:
                        pred[d] = common
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, n) for c in batch.columns), pa.array(names[pred].tolist(), pa.string()), pa.array(score),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))],
                    names=[*batch.schema.names, "lang_pred", "score", "spans"])

    rows = df.select(*carry) if text_col in carry else df.select(*carry, text_col)
    out = rows.mapInArrow(tidied(run), with_fields(rows, "lang_pred string, score double, spans array<struct<first:long,end:long,lang:string>>"))
    return out.select(*carry, "lang_pred", "score", "spans")


def _doubtful(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts without an ASCII letter."""
    low = data | 32
    seen = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    return seen[offs[1:]] == seen[offs[:-1]]


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """Labels of every row by a model learned from the rows whose fold (crc32 of the id mod 4) is not 2.

    The columns carried (the id if none) must not be named lang_pred, score or spans.
    """
    model = learn(df.where(fold(F.col(id_col), 4) != 2), text_col, lang_col)
    return label(df, model, text_col, carry or (id_col,))


def op6_language_viterbi(spark, sf_dir: str) -> DataFrame:
    """Language of every document."""
    out = identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score",
                      F.size("spans").alias("n_spans"))
