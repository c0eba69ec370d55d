"""Benchmark decontamination by latent semantic retrieval, longest common subsequences and answer checks.

1. Term weights: log(1 + documents / (holders + 1)), which is never 0. Holders are the documents that hold a word outside
   the runs of ``GRAM`` words that they share with the benchmark, so copies of a passage don't make its words common.
2. Latent spaces: items are cut into passages of ``WINDOW`` words (one per ``STRIDE``), passages are dealt to spaces of
   ``SPACE`` at most, and each space gets the randomised SVD of its passages' TF-IDF matrix, with as many directions as
   it takes for every passage to keep ``ENERGY`` of its squared length. Spaces are fitted in tasks.
3. Candidates: every window of ``WINDOW`` words of every document (one per ``STRIDE``) is projected; items with a passage
   whose projection has a cosine of ``COSINE`` or more with it are its candidates. The window's length counts all its
   words, those unknown to the benchmark with the weight of a word that no document holds. Windows that hold an item
   word for word are candidates whatever their cosine (each item is looked up by its rarest word).
4. Check: the longest common subsequence of the item's words and the words around the window, as a share of the
   item's words, over all words and over weighted words, whichever is less; an item is leaked into a document at
   ``SHARE``, or at ``SHARE_WITH_ANSWER`` if its last ``ANSWER`` words stand there in a row. So reordered or partly
   reworded passages are found, and single shared phrases are not.

Distribution: two passes over the documents without a shuffle. The benchmark is worked on in blocks of about
``PASSAGES`` passages, so what is sent to the workers is bounded: items, weights, and at most SPACE directions a space.

Null and empty texts and items match nothing. A benchmark of no items gives no rows, like an empty table. Repeated rows
and repeated items give one row per (doc_id, item_id). Null ids match like others. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_words, mix64, powers, ragged, span_hashes, table, text_blocks, tidied
from .langid import _fold_case
from .toxicity import words_of

WINDOW, STRIDE = 16, 8
SPACE, ENERGY = 256, 0.9
PASSAGES = 4096
GRAM = 4
COMMON = 0.2
COSINE = 0.25
SHARE, SHARE_WITH_ANSWER, ANSWER = 0.65, 0.5, 5
RESULT = "doc_id long, item_id long, cosine double, lcs int, item_words int, share double, answer boolean"


def _hashed_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hash, text) of a block of texts, folded, punctuation left out."""

    def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        low = _fold_case(data)
        starts, ends, row = words_of(low, offs)
        return starts, ends, row, span_hashes(low, starts, ends).astype(np.uint64)

    _, _, row, key = long_words(words, data, offs)
    return key, row


def _words_of_text(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return _hashed_words(raw, np.array([0, len(raw)]))[0] if len(raw) else np.zeros(0, np.uint64)


def _grams(words: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hash of the run of GRAM words from each of ``begin`` on."""
    out = np.zeros(len(begin), np.uint64)
    for i in range(GRAM):
        out = mix64(out + words[begin + i])
    return out


def holders(docs: DataFrame, vocabulary: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Number of documents that hold each word of a sorted ``vocabulary`` outside runs of sorted ``grams``."""
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, runs = sent.value
        n = np.zeros(len(known), np.int64)
        for batch in batches:
            for lo, hi, data, offs in text_blocks(batch, "text"):
                if len(data):
                    word, row = _hashed_words(data, offs)
                    at = np.searchsorted(known, word)
                    at[at == len(known)] = 0
                    hit = known[at] == word
                    # runs of GRAM known words in one text, looked up in the benchmark's
                    solid = np.concatenate([[0], np.cumsum(hit)])
                    begin = np.flatnonzero(solid[GRAM:] - solid[:-GRAM] == GRAM) if len(word) >= GRAM else np.zeros(0, np.int64)
                    begin = begin[row[begin] == row[begin + GRAM - 1]]
                    if len(begin) and len(runs):
                        begin = begin[_held(runs, _grams(word, begin))]
                        for i in range(GRAM):
                            hit[begin + i] = False
                    seen = np.unique(row[hit] * len(known) + at[hit])
                    n += np.bincount(seen % len(known), minlength=len(known))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["term", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    counts = docs.select("text").mapInArrow(tidied(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for r in counts.collect():  # a row per benchmark word at most
        out[r.term] = r.n
    return out


def _held(have: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key is in the sorted, non-empty ``have``."""
    at = np.searchsorted(have, keys)
    at[at == len(have)] = 0
    return have[at] == keys


def passages(words: np.ndarray) -> list[np.ndarray]:
    """An item's windows: one per STRIDE words, the last one at its end."""
    last = max(0, len(words) - WINDOW)
    return [words[i:i + WINDOW] for i in sorted({*range(0, last, STRIDE), last})]


def randomised_svd(a: np.ndarray, energy: float = ENERGY, turns: int = 2) -> np.ndarray:
    """[columns, rank] right singular directions of ``a`` (rows of length 1), by subspace iteration: the fewest that leave
    every row ``energy`` of its squared length. The subspace is doubled until it does; at full rank it holds every row."""
    most = min(a.shape)
    size = min(64, most)
    while True:
        q = np.random.default_rng(29).standard_normal((a.shape[1], size))
        for _ in range(turns + 1):
            q = np.linalg.qr(a.T @ (a @ q))[0]
        y = a @ q
        value, turn = np.linalg.eigh(y.T @ y)
        turn = turn[:, np.argsort(-value)]
        kept = np.cumsum((y @ turn) ** 2, axis=1).min(0)
        if kept[-1] >= energy or size == most:
            rank = int(np.argmax(kept >= energy)) + 1 if kept[-1] >= energy else size
            return (q @ turn[:, :rank]).astype(np.float32)
        size = min(2 * size, most)


def _space(part: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, [terms, rank] their part of a projection, [passages, rank] unit queries, item of each) of the passages
    (item, terms, weights) of one space."""
    terms = np.unique(np.concatenate([t for _, t, _ in part]))
    a = np.zeros((len(part), len(terms)))
    own = np.zeros(len(terms))
    for i, (_, t, w) in enumerate(part):
        col = np.searchsorted(terms, t)
        np.add.at(a[i], col, w)
        own[col] = w
    a /= np.linalg.norm(a, axis=1)[:, None]
    v = randomised_svd(a)
    q = a.astype(np.float32) @ v
    q /= np.maximum(np.linalg.norm(q, axis=1), 1e-9)[:, None]
    return terms, v * own[:, None].astype(np.float32), q, np.array([i for i, _, _ in part])


def spaces(docs: DataFrame, items: list[tuple], vocabulary: np.ndarray, weight: np.ndarray) -> list[tuple]:
    """The latent spaces of a block of items, fitted in one task each."""
    cut = []
    for i, (_, x) in enumerate(items):
        for p in passages(x):
            t = np.searchsorted(vocabulary, p)
            cut.append((i, t, weight[t]))
    n = -(-len(cut) // SPACE)
    parts = [cut[len(cut) * k // n:len(cut) * (k + 1) // n] for k in range(n)]
    return docs.sparkSession.sparkContext.parallelize(parts, n).map(_space).collect()


def common_subsequence(item: dict, n: int, words: list) -> int:
    """Length of the longest common subsequence; item: bit set of positions by word, n: its number of positions."""
    full = (1 << n) - 1
    v = full
    for w in words:
        m = item.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _bits(words: list) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class _Item:
    def __init__(self, item_id, words: np.ndarray, heavy: set):
        self.id, self.words = item_id, words.tolist()
        self.n = len(self.words)
        self.bits = _bits(self.words)
        self.core = [w for w in self.words if w in heavy]
        self.core_bits = _bits(self.core)
        self.heavy = heavy
        self.tail = self.words[-ANSWER:]

    def check(self, words: list) -> tuple[int, float, bool]:
        """(common subsequence, share, whether the answer stands there) within the words around a window."""
        lcs = common_subsequence(self.bits, self.n, words)
        share = lcs / self.n
        if self.core:
            share = min(share, common_subsequence(self.core_bits, len(self.core), [w for w in words if w in self.heavy]) / len(self.core))
        k = len(self.tail)
        answer = any(words[i:i + k] == self.tail for i in range(len(words) - k + 1) if words[i] == self.tail[0])
        return lcs, share, answer


def _windows(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, text) of the windows of a block: one per STRIDE words, the last one of a text at its end."""
    count = np.bincount(row, minlength=rows)
    base = np.cumsum(count) - count
    k = np.where(count > WINDOW, -(-(count - WINDOW) // STRIDE) + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(rows), k)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)
    first = np.minimum(nth * STRIDE, np.maximum(count[text] - WINDOW, 0))
    return base[text] + first, base[text] + np.minimum(first + WINDOW, count[text]), text


class _Exact:
    """Looks up items word for word: where an item's rarest word stands, the words around it are compared by hash."""

    def __init__(self, items: list[tuple], vocabulary: np.ndarray, weight: np.ndarray):
        at = [np.searchsorted(vocabulary, x) for _, x in items]
        self.back = np.array([int(weight[t].argmax()) for t in at])
        self.size = np.array([len(t) for t in at])
        key = np.array([t[k] for t, k in zip(at, self.back)])
        self.order = np.argsort(key, kind="stable")
        self.first = np.searchsorted(key[self.order], np.arange(len(vocabulary) + 1))
        self.hash = np.array([(x * powers(len(x))).sum(dtype=np.uint64) for _, x in items])

    def find(self, word: np.ndarray, row: np.ndarray, at: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, item) of every copy; ``at``: place of each word in the vocabulary where ``hit``."""
        pos = np.flatnonzero(hit & (self.first[at + 1] > self.first[at]))
        n = self.first[at[pos] + 1] - self.first[at[pos]]
        item = self.order[ragged(self.first[at[pos]], n)]
        begin = np.repeat(pos, n) - self.back[item]
        end = begin + self.size[item]
        ok = (begin >= 0) & (end <= len(word))
        item, begin, end = item[ok], begin[ok], end[ok]
        power = powers(len(word) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * power[:-1], dtype=np.uint64)])
        ok = (row[begin] == row[end - 1]) & (total[end] - total[begin] == self.hash[item] * power[begin])
        return begin[ok], item[ok]


def _search(docs: DataFrame, items: list[tuple], vocabulary: np.ndarray, weight: np.ndarray, heavy: np.ndarray, unknown: float,
            latent: list[tuple]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((items, vocabulary, weight, heavy, latent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known, w, rare, latent = sent.value
        heavy = set(known[rare].tolist())
        objects = [_Item(i, x, heavy) for i, x in items]
        exact = _Exact(items, known, w)
        size, core_size = np.array([o.n for o in objects]), np.array([len(o.core) for o in objects])
        members = np.unique(np.concatenate([j * len(known) + np.searchsorted(known, x) for j, (_, x) in enumerate(items)]))
        least = min(SHARE, SHARE_WITH_ANSWER)
        column = []  # each vocabulary word's row in each space
        for terms, *_ in latent:
            column.append(np.full(len(known), -1, np.int32))
            column[-1][terms] = np.arange(len(terms))
        for batch in batches:
            ids = batch.column(0)
            best: dict[tuple, tuple] = {}
            for lo, hi, data, offs in text_blocks(batch, "text"):
                if not len(data):
                    continue
                word, row = _hashed_words(data, offs)
                if not len(word):
                    continue
                at = np.searchsorted(known, word)
                at[at == len(known)] = 0
                hit = known[at] == word
                own = np.where(hit, w[at], unknown) ** 2
                square = np.concatenate([[0.0], np.cumsum(own)])
                first, end, text = _windows(row, hi - lo)
                length = np.sqrt(square[end] - square[first])
                win, who, near = [], [], []  # candidates: window, item, cosine
                spots = np.flatnonzero(hit)
                for (_, mine, q, owner), col in zip(latent, column):
                    local = col[at[spots]]
                    use, local = spots[local >= 0], local[local >= 0]
                    before = np.searchsorted(use, np.arange(len(word) + 1))
                    part = np.concatenate([[0.0], np.cumsum(own[use])])
                    a, n = before[first], before[end] - before[first]
                    # a projection is no longer than the part of the window that the space knows
                    go = np.flatnonzero((n > 0) & (np.sqrt(part[a + n] - part[a]) >= (COSINE - 1e-6) * length))
                    for c in range(0, len(go), 1024):
                        g = go[c:c + 1024]
                        put = np.add.reduceat(mine[local[ragged(a[g], n[g])]], np.cumsum(n[g]) - n[g], axis=0)
                        cos = (put @ q.T) / np.maximum(length[g], 1e-9)[:, None]
                        i, j = np.nonzero(cos >= COSINE)
                        win.append(g[i])
                        who.append(owner[j])
                        near.append(cos[i, j])
                bounds = np.searchsorted(row, np.arange(hi - lo + 1))
                base = np.searchsorted(text, np.arange(hi - lo + 1))
                x, j = exact.find(word, row, at, hit)
                win.append(np.minimum(base[row[x]] + (x - bounds[row[x]]) // STRIDE, base[row[x] + 1] - 1))
                who.append(j)
                near.append(np.zeros(len(x)))
                win, who, near = (np.concatenate(y) for y in (win, who, near))
                order = np.lexsort((-near, who, win))
                win, who, near = win[order], who[order], near[order]
                one = np.ones(len(win), bool)
                one[1:] = (win[1:] != win[:-1]) | (who[1:] != who[:-1])
                win, who, near = win[one], who[one], near[one]
                # the words around the window; those of the item's among them bound the common subsequence
                x0 = np.maximum(bounds[text[win]], first[win] - size[who])
                x1 = np.minimum(bounds[text[win] + 1], end[win] + size[who])
                may = np.zeros(len(win), bool)
                s0, s1 = np.searchsorted(spots, x0), np.searchsorted(spots, x1)
                for c in range(0, len(win), 4096):
                    z = slice(c, c + 4096)
                    n = s1[z] - s0[z]
                    term = at[spots[ragged(s0[z], n)]]
                    mine = _held(members, np.repeat(who[z], n) * len(known) + term)
                    total = np.concatenate([[0], np.cumsum(mine)])
                    core = np.concatenate([[0], np.cumsum(mine & rare[term])])
                    stop = np.cumsum(n)
                    may[z] = (total[stop] - total[stop - n] >= least * size[who[z]]) & (core[stop] - core[stop - n] >= least * core_size[who[z]])
                for i, j, cosine, x, y in zip(*(v[may].tolist() for v in (win, who, near, x0, x1))):
                    item = objects[j]
                    r = int(text[i])
                    lcs, share, answer = item.check(word[x:y].tolist())
                    if share >= SHARE or (answer and share >= SHARE_WITH_ANSWER):
                        key, new = (lo + r, item.id), (share, cosine, lcs, item.n, answer)
                        if key not in best or new > best[key]:
                            best[key] = new
            if best:
                k = list(best)
                share, cosine, lcs, n, answer = zip(*best.values())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([x for x, _ in k])), pa.array([x for _, x in k], pa.int64()), pa.array(cosine, pa.float64()),
                     pa.array(lcs, pa.int32()), pa.array(n, pa.int32()), pa.array(share, pa.float64()), pa.array(answer, pa.bool_())],
                    names=["doc_id", "item_id", "cosine", "lcs", "item_words", "share", "answer"])

    return docs.mapInArrow(tidied(run), RESULT)


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that leaked into it: RESULT."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).distinct()
    total = max(1, docs.count())
    cuts = F.size(F.split("text", r"\s+")) / STRIDE + 1
    blocks = max(1, math.ceil((items.agg(F.sum(cuts)).first()[0] or 0) / PASSAGES))
    out = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        own = [(r.item_id, _words_of_text(r.text)) for r in block.collect()]  # about PASSAGES passages
        own = [(i, x) for i, x in own if len(x)]
        if not own:
            continue
        vocabulary = np.unique(np.concatenate([x for _, x in own]))
        grams = np.unique(np.concatenate([_grams(x, np.arange(len(x) - GRAM + 1)) for _, x in own]))
        held = holders(docs, vocabulary, grams)
        unknown = math.log1p(total)
        weight = np.log1p(total / (held + 1))
        heavy = np.maximum(held, 1) < max(COMMON * total, 2.0)
        found = _search(docs, own, vocabulary, weight, heavy, unknown, spaces(docs, own, vocabulary, weight))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], RESULT)
    one = F.max(F.struct("share", "cosine", "lcs", "item_words", "answer")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(one).select("doc_id", "item_id", "b.cosine", "b.lcs", "b.item_words", "b.share", "b.answer")


def op10_latent_decontamination(spark, sf_dir: str) -> DataFrame:
    """Leaks of all benchmark items into all documents."""
    return leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
