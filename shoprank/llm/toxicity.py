"""Toxicity: Levenshtein automata over a lexicon trie find (misspelled) terms, context windows weigh each find.

Learning uses a bounded sample of labelled rows (``SAMPLE`` rows at most, smallest id hashes first):
- the lexicon is the words whose share among toxic texts is at least ``ODDS`` times that among clean texts, with a
  log-likelihood ratio of at least ``EVIDENCE``;
- a linear model over the finds' context-window scores is fitted to the labels.

Finding: each word of a text is looked up as it is; a word that isn't a term but shares a deletion of one UTF-8 character with one
is given to its Levenshtein automaton (insertion, deletion, substitution or exchange of neighbours, ``EDITS`` in all),
which is intersected with the lexicon trie, so that branches no edit can save are never entered.

Weighing: a find's window is ``WINDOW`` words to either side within its line. Its score falls if it stands in
quotation marks or a reporting sign precedes it, and rises with the other finds in the window. A text's features are
sums and maxima of these scores; long texts are read whole.

Distribution: every step is one pass over the texts without a shuffle of texts; the labelled sample's bound makes it
safe to broadcast. Word counts are summed in the task first; the lexicon and the fit come from bounded numbers of rows.

Null and empty texts have no finds and get the score of a text without finds. Rows without a label are scored like
others. Without labelled rows of both kinds every score is 0. Repeated rows get equal scores; repeated labels of one id
count as toxic if any of them does. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, long_words, ragged, span_hashes, table, text_blocks, tidied, unit_hash, with_fields, written
from .langid import _fold_case

SAMPLE = 40_000
ODDS = 10.0
#: and whose log-likelihood ratio against one common share is at least this.
EVIDENCE = 25.0
#: A term occurs in at least this many toxic texts, and this share of them.
LEAST_TEXTS, LEAST_SHARE = 3, 0.001
EDITS = 1
#: Shorter terms are found as they are only.
FUZZY_LENGTH = 5
#: A term is found as it is only if its misspellings stand in more than this share of the clean texts, in at least
#: LEAST_TEXTS of them, and their share among toxic texts is less than ODDS times that.
RIGID_SHARE = 0.0001
WINDOW = 8
#: Signs that open or close quotations; words that report another's speech.
QUOTES = ['"', "“", "”", "„", "«", "»"]
REPORTING = {"said", "says", "quote", "quoted", "called", "wrote", "word", "term", "sagte", "schrieb", "nannte", "dit", "écrit",
             "dijo", "escribió", "llamó"}
FEATURES = ["any", "sum", "max", "finds", "fuzzy", "quoted"]


# ---- automaton and trie -------------------------------------------------------------------------------------

class Trie:
    """Terms by character; a node is (children, term that ends here or None)."""

    def __init__(self, terms):
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t


class LevenshteinAutomaton:
    """Accepts the strings within ``edits`` edits of ``word``; a state is one bit set of word positions per edit count.

    Exchanging two neighbours is one edit: ``held`` has the positions whose second letter has come before the first.
    """

    def __init__(self, word: str, edits: int):
        self.edits, self.full, self.end = edits, (1 << (len(word) + 1)) - 1, 1 << len(word)
        self.at: dict[str, int] = {}
        for i, c in enumerate(word):
            self.at[c] = self.at.get(c, 0) | 1 << i

    def start(self):
        sets = [1]
        for _ in range(self.edits):
            sets.append((sets[-1] | sets[-1] << 1) & self.full)
        return sets, [0] * (self.edits + 1)

    def step(self, state, c: str):
        sets, held = state
        m = self.at.get(c, 0)
        new, wait = [(sets[0] & m) << 1], [0]
        for j in range(1, self.edits + 1):
            below = sets[j - 1]
            x = ((sets[j] & m) << 1) | below | below << 1 | new[j - 1] << 1 | (held[j] & m) << 2
            new.append(x & self.full)
            wait.append(below & m >> 1)
        return new, wait

    def alive(self, state) -> bool:
        return any(state[0]) or any(state[1])

    def accepts(self, state) -> bool:
        return any(s & self.end for s in state[0])

    def first_in(self, trie: Trie) -> str | None:
        """The smallest term that the automaton accepts."""
        found, todo = None, [(trie.root, self.start())]
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if c == "":
                    if self.accepts(state) and (found is None or child < found):
                        found = child
                    continue
                after = self.step(state, c)
                if self.alive(after):
                    todo.append((child, after))
        return found


# ---- words --------------------------------------------------------------------------------------------------

def _is_word() -> tuple[np.ndarray, np.ndarray]:
    plain = np.zeros(256, bool)
    plain[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
    inner = np.zeros(256, bool)
    inner[[ord(c) for c in "@$!*+'-_"]] = True
    return plain, inner


_PLAIN, _INNER = _is_word()


def words_of(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of words of folded text: letters and digits, and single signs between them."""
    ok = _PLAIN[low].copy()
    for a, b in ((0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)):
        x = np.flatnonzero(low == a)
        x = x[low[x + 1] == b]
        for k in range(3):
            ok[x + k] = False
    x = np.flatnonzero(low == 0xC2)
    ok[x] = False
    ok[x + 1] = False
    edge = np.zeros(len(low) + 1, bool)
    edge[offs] = True
    left, right = np.zeros(len(low), bool), np.zeros(len(low), bool)
    left[1:], right[:-1] = ok[:-1], ok[1:]
    ok |= _INNER[low] & left & right & ~edge[:-1] & ~edge[1:]
    left[1:], right[:-1] = ok[:-1], ok[1:]
    starts = np.flatnonzero(ok & (~left | edge[:-1]))
    ends = np.flatnonzero(ok & (~right | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def _letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of UTF-8 characters of every word."""
    n = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return n[ends] - n[starts]


def _shortened(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the word without one UTF-8 character, word) for every character of every word."""
    size = ends - starts
    word = np.repeat(np.arange(len(starts)), size)
    out = ragged(starts, size)
    first = (data[out] & 0xC0) != 0x80
    first[np.cumsum(size)[size > 0] - size[size > 0]] = True
    head = np.flatnonzero(first)
    width = np.diff(np.append(head, len(out)))
    word, out = word[head], out[head]
    # each shortened word is laid out once, then hashed: total size is the sum of squares of short words
    reps = size[word] - width
    lay = ragged(starts[word], reps)
    heads = np.cumsum(reps) - reps
    place = np.arange(len(lay)) - np.repeat(heads, reps)
    lay += np.where(place >= np.repeat(out - starts[word], reps), np.repeat(width, reps), 0)
    return span_hashes(data[lay], heads, heads + reps), word


class Lexicon:
    """Exact and misspelled finds among the words of a block; keeps what it has decided."""

    KEEP = 200_000
    def __init__(self, terms: list[str], rigid: frozenset[str] = frozenset()):
        """``rigid`` terms are found as they are only."""
        loose = [t for t in terms if len(t) >= FUZZY_LENGTH and t not in rigid]
        if EDITS != 1:
            raise ValueError("candidates are words that share a deletion of one character with a term: EDITS must be 1")
        self.trie = Trie(loose)
        self.longest = max(map(len, loose), default=0) + EDITS  # no longer word is near a term
        self.exact = self._sorted([t.encode() for t in terms])
        fuzzy = [t.encode() for t in loose]
        cat = np.frombuffer(b"".join(fuzzy), np.uint8)
        ends = np.cumsum([len(t) for t in fuzzy], dtype=np.int64) if fuzzy else np.zeros(0, np.int64)
        starts = ends - [len(t) for t in fuzzy] if fuzzy else ends
        self.near = np.unique(np.concatenate([_shortened(cat, starts, ends)[0], span_hashes(cat, starts, ends)])) if fuzzy else np.zeros(0, np.uint64)
        self.known: dict[int, str | None] = {}

    @staticmethod
    def _sorted(words: list[bytes]) -> np.ndarray:
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        starts = ends - [len(w) for w in words] if words else ends
        return np.sort(span_hashes(np.frombuffer(b"".join(words), np.uint8), starts, ends))

    def kinds(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """0, 1 (a term) or 2 (a misspelled term) for every word."""
        keys, first, inv = np.unique(span_hashes(low, starts, ends), return_index=True, return_inverse=True)
        s, e = starts[first], ends[first]
        kind = np.isin(keys, self.exact).astype(np.uint8)
        size = _letters(low, s, e)
        try_ = np.flatnonzero((kind == 0) & (size >= FUZZY_LENGTH - 1) & (size <= self.longest))
        if len(try_) and len(self.near):
            cut, word = _shortened(low, s[try_], e[try_])
            hit = np.zeros(len(try_), bool)
            hit[word[np.isin(cut, self.near)]] = True
            hit |= np.isin(keys[try_], self.near)
            raw = low.tobytes()
            for i in try_[hit].tolist():
                key = int(keys[i])
                if key not in self.known:
                    if len(self.known) > self.KEEP:
                        self.known.clear()
                    w = raw[s[i]:e[i]].decode("utf-8", "replace")
                    self.known[key] = LevenshteinAutomaton(w, EDITS).first_in(self.trie)
                if self.known[key]:
                    kind[i] = 2
        self.last = (keys, kind, inv)
        return kind[inv]

    def misspelt(self) -> Iterator[tuple[np.ndarray, str]]:
        """(word numbers, term) of every misspelling in the block just seen."""
        keys, kind, inv = self.last
        for i in np.flatnonzero(kind == 2).tolist():
            yield np.flatnonzero(inv == i), self.known[int(keys[i])]


# ---- context ------------------------------------------------------------------------------------------------

def _quoted(line: str, at: int) -> bool:
    """Whether quotation marks open before ``at`` and close after it."""
    before = sum(line.count(q, 0, at) for q in QUOTES)
    return before % 2 == 1 and any(line.find(q, at) >= 0 for q in QUOTES)


def features(low: np.ndarray, offs: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """FEATURES of every text of a block."""
    out = np.zeros((len(offs) - 1, len(FEATURES)))
    if not len(low):
        return out

    def words(low: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        starts, ends, row = words_of(low, offs)
        return starts, ends, row, lexicon.kinds(low, starts, ends) if len(starts) else np.zeros(0, np.uint8)

    starts, ends, row, kind = long_words(words, low, offs)
    if not len(starts):
        return out
    hits = np.flatnonzero(kind)
    if not len(hits):
        return out
    raw = low.tobytes()
    for h in hits.tolist():
        r = row[h]
        a, b = max(h - WINDOW, int(np.searchsorted(row, r))), min(h + WINDOW + 1, int(np.searchsorted(row, r, side="right")))
        line0 = raw.rfind(b"\n", offs[r], starts[h]) + 1 or int(offs[r])
        line1 = raw.find(b"\n", ends[h], offs[r + 1])
        line1 = int(offs[r + 1]) if line1 < 0 else line1
        line0, line1 = max(line0, int(starts[a])), min(line1, int(ends[b - 1]) + 3, int(offs[r + 1]))
        line = raw[line0:line1].decode("utf-8", "replace")
        at = len(raw[line0:starts[h]].decode("utf-8", "replace"))
        told = _quoted(line, at) or not REPORTING.isdisjoint(line[:at].split())
        others = int((kind[a:b] > 0).sum()) - 1
        score = (1.0 if kind[h] == 1 else 0.6) * (0.25 if told else 1.0) * (1 + 0.5 * math.log1p(others))
        f = out[r]
        f[0] = 1.0
        f[1] += score
        f[2] = max(f[2], score)
        f[3] += 1
        f[4] += kind[h] == 2
        f[5] += told
    n = np.maximum(out[:, 3], 1)
    out[:, 1] = np.log1p(out[:, 1])
    out[:, 4] /= n
    out[:, 5] /= n
    out[:, 3] = np.log1p(out[:, 3])
    return out


#: Prior of the weights (and the bias, last): what the fit is pulled to where the labels are silent.
PRIOR = np.array([2.0, 1.0, 1.5, 0.5, -1.0, -3.0, -3.0])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, pulled to PRIOR."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * ((w - PRIOR) ** 2).sum())

    w = PRIOR.copy()
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - PRIOR)
        d = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        size = 1.0
        while size > 1e-6 and loss(w - size * d) > now:
            size /= 2
        w = w - size * d
        before, now = now, loss(w)
        if before - now < 1e-9:
            break
    return w


# ---- Spark steps --------------------------------------------------------------------------------------------

def _word_counts(rows: DataFrame, only: list[str] | None) -> DataFrame:
    """(word, n): texts that hold the word, of all words or of ``only`` these."""
    sent = None if only is None else frozenset(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for _, _, data, offs in text_blocks(batch, "text"):
                if not len(data):
                    continue
                low = _fold_case(data)
                starts, ends, row = words_of(low, offs)
                key = span_hashes(low, starts, ends)
                # one of each word in a text
                order = np.lexsort((key, row))
                new = np.ones(len(order), bool)
                new[1:] = (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])
                keys, first, n = np.unique(key[order[new]], return_index=True, return_counts=True)
                raw = low.tobytes()
                for i, k in zip(order[new][first].tolist(), n.tolist()):
                    w = raw[starts[i]:ends[i]].decode("utf-8", "replace")
                    if sent is None or w in sent:
                        count[w] += k
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    return rows.select("text").mapInArrow(tidied(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn_lexicon(rows: DataFrame) -> list[str]:
    """Terms of labelled ``rows`` (text, toxic)."""
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return []
    least = max(LEAST_TEXTS, math.ceil(LEAST_SHARE * bad))
    # at most (words of a text) / LEAST_SHARE words reach that share
    toxic = {r.word: r.n for r in _word_counts(rows.where("toxic = 1"), None).where(F.col("n") >= least).collect()}
    clean = {r.word: r.n for r in _word_counts(rows.where("toxic = 0"), list(toxic)).collect()}
    return sorted(w for w, n in toxic.items() if len(w) >= 3 and (n + 0.5) / (bad + 1) >= ODDS * (clean.get(w, 0) + 0.5) / (good + 1)
                  and _evidence(n, clean.get(w, 0), bad, good) >= EVIDENCE)


def _evidence(a: int, b: int, bad: int, good: int) -> float:
    """Log-likelihood ratio of a word in a of ``bad`` and b of ``good`` texts against one share in both."""

    def part(k: int, n: int, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    p = (a + b) / (bad + good)
    return 2 * (part(a, bad, a / bad) + part(b, good, b / good) - part(a, bad, p) - part(b, good, p))


def rigid_terms(rows: DataFrame, terms: list[str]) -> frozenset[str]:
    """Terms whose misspellings are ordinary words by the counts of clean and toxic texts that hold one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, count = Lexicon(terms), Counter()
        for batch in batches:
            toxic = batch.column(batch.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False)
            for lo, _, data, offs in text_blocks(batch, "text"):
                low = _fold_case(data)
                starts, ends, row = words_of(low, offs) if len(low) else ([], [], [])
                if len(starts):
                    lexicon.kinds(low, starts, ends)
                    texts: dict[str, set] = {}
                    for at, term in lexicon.misspelt():
                        texts.setdefault(term, set()).update(row[at].tolist())
                    count.update({(t, kind): sum(toxic[lo + r] == kind for r in x) for t, x in texts.items() for kind in (0, 1)})
        term, kind = zip(*count) if count else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.string()), pa.array(kind, pa.int32()), pa.array(list(count.values()), pa.int64())],
                                         names=["term", "toxic", "n"])

    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    counts = rows.select("text", "toxic").mapInArrow(tidied(run), "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    return frozenset(r.term for r in counts.collect() if r.clean >= LEAST_TEXTS and r.clean > RIGID_SHARE * good
                     and (r.toxic + 0.5) / (bad + 1) < ODDS * (r.clean + 0.5) / (good + 1))


def _featured(rows: DataFrame, terms: list[str], rigid: frozenset[str], weights: np.ndarray | None) -> DataFrame:
    """Features of each row, or with ``weights`` its score."""
    sent = rows.sparkSession.sparkContext.broadcast((terms, rigid, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, rigid, weights = sent.value
        lexicon = Lexicon(terms, rigid)
        for batch in batches:
            for lo, hi, data, offs in text_blocks(batch, "text"):
                f = features(_fold_case(data), offs, lexicon)
                kept = [c.slice(lo, hi - lo) for i, c in enumerate(batch.columns) if batch.schema.names[i] != "text"]
                names = [x for x in batch.schema.names if x != "text"]
                if weights is None:
                    kept.append(pa.array(f.tolist(), pa.list_(pa.float64())))
                else:
                    p = 1 / (1 + np.exp(-np.clip(f @ weights[:-1] + weights[-1], -30, 30)))
                    kept += [pa.array(p), pa.array(np.rint(np.expm1(f[:, 3])).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(kept, names=[*names, *(["f"] if weights is None else ["score", "finds"])])

    return rows.mapInArrow(tidied(run), with_fields(rows, "f array<double>" if weights is None else "score double, finds long", "text"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
             learn_from=None) -> DataFrame:
    """(doc_id, score, finds) of every document; ``learn_from``: condition on the id for rows that may be learned from."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    known = known.where(learn_from(F.col("doc_id"))) if learn_from else known
    h = F.xxhash64(F.lit(3), "doc_id")
    # rows are thinned out by their hash first, so that the cut at SAMPLE sees about its own size only
    some = known.where(unit_hash(h) < min(1.0, 2 * SAMPLE / max(1, known.count())))
    known = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(h, "doc_id").limit(SAMPLE)
    known = written(spark, known, "toxic-labels")
    rows = docs.join(F.broadcast(known), "doc_id").select("text", "toxic")  # SAMPLE rows of 12 bytes at most
    rows = written(spark, rows, "toxic-rows")  # read by each step of the learning
    terms = learn_lexicon(rows)
    if not terms:
        return docs.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("finds"))
    rigid = rigid_terms(rows, terms)
    seen = _featured(rows, terms, rigid, None).groupBy("f", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    n = np.array([r.n for r in seen])
    x, y = np.repeat([r.f for r in seen], n, axis=0), np.repeat([float(r.toxic) for r in seen], n)
    return _featured(docs, terms, rigid, fit(x, y))


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels are learned from ids whose crc32 mod 5 is not 0."""
    out = toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"),
                   learn_from=lambda i: fold(i, 5) != 0)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "finds")
