"""Plain versions of the operators' contracts, and rows that go wrong easily."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))

#: doc_id, text, lang, source: nulls, empty and very long texts, white space only, ties, repeated rows, no letters.
DOCS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a"),
    (2, "the QUICK brown fox jumps over the lazy dog and runs away.", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n ", "de", "b"),
    (6, "one two three", "en", None),
    (7, "ONE two three", "en", "c"),
    (8, LONG, "en", "a"),
    (9, LONG + " tail", "en", "a"),
    (None, "a row without an id but with some words in it", "en", "a"),
    (10, "12345 67890 !!! ???", "en", "a"),
    (11, "Überraschung für alle – 日本語 и кириллица ok", "de", "a"),
    (12, PASSAGE, "en", "a"),
    (13, "before " + PASSAGE + " after", "en", "a"),
    (14, "<|endoftext|> it's don't we'll\r\n\u00a0 x", "en", "a"),
    (15, "ab" * 400, "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows=DOCS, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def clashing(df):
    """The frame with extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    for c in ("th", "spans", "whole", "kept", "score", "lang_pred", "fp", "n", "part", "shard", "rank", "h", "t", "k1", "host", "wrapper"):
        df = df.withColumn(c, F.lit(c))
    return df


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if len(w) >= k:
        return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def jaccard_components(rows):
    """rows: (id, text), ids may repeat -> Counter of (id, set size, component)."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in by[x] if j < i)
        for j, k in shared.items():
            if 100 * k >= 80 * (len(s) + len(sets[j]) - k):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def without_repeats(rows, length):
    """rows: (id, text) -> [(id, bytes, removed, spans, kept bytes)]."""
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), spans, kept))
    return out


def best_fit_decreasing(lengths, capacity):
    """Remaining capacities of the sequences that piece-by-piece best fit makes."""
    free = []
    for x in sorted(lengths, reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= x]
        if fits:
            free[min(fits)[1]] -= x
        else:
            free.append(capacity - x)
    return sorted(free)
