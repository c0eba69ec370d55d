"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed number of tokens.

1. Tokenise: every text to ids plus an end id, cut into pieces of ``capacity`` ids if longer (the first piece may
   be shorter); only length and crc32 of each piece are kept. Equal words are tokenised once per block of text.
2. Plan: best-fit decreasing needs only the number of pieces of each length (``capacity`` numbers at most). A
   segment tree over remaining capacities holds the open sequences; for each length, longest first, the tightest
   open capacity that fits is found in logarithmic time and its sequences are filled, all equal ones at once. The
   plan is the one that piece-by-piece best-fit decreasing makes, as a list of runs per length.
3. Place: a piece's rank among the pieces of its length (rank in a hash bucket plus the bucket's offset, so that no
   length is ranked in one task) picks its run, and with it sequence and offset.

Null texts are empty: a piece of one id (the end id). An empty table gives an empty result. Repeated rows are
packed as often as they occur; ties between equal rows don't change the result as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ragged, span_hashes, table, text_blocks, tidied, written

CAPACITY = 2048
END_ID = 0
#: Rows that one ranking bucket is meant to hold.
BUCKET_ROWS = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---- tokenising ---------------------------------------------------------------------------------------------

#: Code points below this are split into words here; texts with others go to the tokenizer whole.
_SIMPLE = 0x250
_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3


def _char_classes() -> np.ndarray:
    import regex

    out = np.full(_SIMPLE, _OTHER, np.uint8)
    for cls, pat in ((_LETTER, r"\p{L}"), (_DIGIT, r"\p{N}"), (_SPACE, r"\s")):
        rx = regex.compile(pat)
        out[[i for i in range(_SIMPLE) if rx.match(chr(i))]] = cls
    return out


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def split_words(data: np.ndarray, offs: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words that byte-level BPE takes one by one; bytes of simple texts, words never cross texts.

    A word is: an apostrophe with s, t, m, d, re, ve or ll; letters, digits or other signs with one space before
    them if there is one; white space up to the last sign before the next word, or to the text's end.
    """
    n = len(data)
    lead = (data & 0xC0) != 0x80
    cp = data.astype(np.int32)
    two = np.flatnonzero(data >= 0xC0)
    cp[two] = ((cp[two] & 0x1F) << 6) | (cp[two + 1] & 0x3F)
    cls = classes[np.where(lead, cp, 0)]
    cont = np.flatnonzero(~lead)
    cls[cont] = cls[cont - 1]
    textstart = np.zeros(n + 1, bool)
    textstart[offs] = True
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = 9, cls[:-1]
    prev[textstart[:n]] = 9
    begin = cls != prev  # a run of one class begins (or a text)
    space = cls == _SPACE
    # white space: its last sign stands alone, or goes with what follows if it is a plain space
    lastspace = np.zeros(n, bool)
    runend = np.ones(n, bool)
    runend[:-1] = begin[1:]
    textend = textstart[1:]
    ends = np.flatnonzero(space & runend & ~textend)
    # (start byte of the last white space sign of each run that something follows)
    back = ends.copy()
    while True:
        inner = ~lead[back]
        if not inner.any():
            break
        back[inner] -= 1
    lastspace[back] = True
    begin |= lastspace
    plain = back[data[back] == 32]
    begin[plain[plain + 1 < n] + 1] = False
    # contractions: an apostrophe at the start of a word
    ap = np.flatnonzero((data == 39) & begin)
    if len(ap):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        stop = offs[np.searchsorted(offs, ap, side="right")]
        a, b = padded[ap + 1], padded[ap + 2]
        one = ((a == 115) | (a == 116) | (a == 109) | (a == 100)) & (ap + 1 < stop)
        both = (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))) & (ap + 2 < stop)
        for at, w in ((ap[one], 2), (ap[both], 3)):
            begin[at + 1] = False
            cut = at + w
            begin[cut[cut < n]] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], n)


class Tokeniser:
    """Ids of texts by a tokenizer file; words met before are looked up by their hash."""

    KEEP = 300_000  # words remembered by a worker

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        # the same merges for single words, which cost less without the tokenizer's surroundings: a byte-level BPE
        # numbers its merges in their order, so ids serve as ranks
        signs = _byte_signs()
        ranks = {bytes(signs[c] for c in t): i for t, i in self.tok.get_vocab(with_added_tokens=False).items()
                 if all(c in signs for c in t)}
        ranks = {t: i for t, i in ranks.items() if t != b"<|endoftext|>"}
        self.one = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.classes = _char_classes()
        self.forget()

    def forget(self) -> None:
        self.keys, self.lens, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self.keys) + len(keys) > self.KEEP:
            self.forget()
        raw = data.tobytes()
        one = self.one
        ids = [one(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(lens.sum()))
        at = len(self.flat) + np.cumsum(lens) - lens
        keys, lens, at = (np.concatenate(x) for x in ((self.keys, keys), (self.lens, lens), (self.at, at)))
        order = np.argsort(keys)
        self.keys, self.lens, self.at = keys[order], lens[order], at[order]
        self.flat = np.concatenate([self.flat, flat])

    def block(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids per text)."""
        rows = len(offs) - 1
        hard = np.zeros(rows, bool)
        odd = np.flatnonzero(data >= 0xCA)  # lead bytes of code points from 0x280; 0xC9 0x90 is 0x250
        edge = np.flatnonzero(data == 0xC9)
        odd = np.concatenate([odd, edge[data[edge + 1] >= 0x90]]) if len(edge) else odd
        if len(odd):
            hard[np.unique(np.searchsorted(offs, odd, side="right") - 1)] = True
        if hard.any():
            keep = np.flatnonzero(~hard)
            sizes = np.diff(offs)
            sub, subn = self._easy(data[ragged(offs[keep], sizes[keep])], np.concatenate([[0], np.cumsum(sizes[keep])]))
            raw = data.tobytes()
            parts, at = [None] * rows, np.concatenate([[0], np.cumsum(subn)])
            for i, r in enumerate(keep.tolist()):
                parts[r] = sub[at[i]:at[i + 1]]
            for r in np.flatnonzero(hard).tolist():
                e = self.tok.encode(raw[offs[r]:offs[r + 1]].decode("utf-8", "replace"), add_special_tokens=False)
                parts[r] = np.asarray(e.ids, np.uint32)
            return np.concatenate(parts), np.fromiter((len(p) for p in parts), np.int64, rows)
        return self._easy(data, offs)

    def _easy(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = len(offs) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        starts, ends = split_words(data, offs, self.classes)
        h = span_hashes(data, starts, ends)
        keys, first, inv = np.unique(h, return_index=True, return_inverse=True)
        slot = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            slot[slot == len(self.keys)] = 0
            new = self.keys[slot] != keys
        if new.any():
            if len(self.keys) + int(new.sum()) > self.KEEP:
                self.forget()
                new = np.ones(len(keys), bool)
            self._learn(data, keys[new], starts[first[new]], ends[first[new]])
            slot = np.searchsorted(self.keys, keys)
        at, lens = self.at[slot][inv], self.lens[slot][inv]
        row = np.searchsorted(offs, starts, side="right") - 1
        return self.flat[ragged(at, lens)], np.bincount(row, weights=lens, minlength=rows).astype(np.int64)


_TOKENISERS: dict[str, Tokeniser] = {}


def tokeniser(path: str) -> Tokeniser:
    """One per worker and file."""
    if path not in _TOKENISERS:
        _TOKENISERS[path] = Tokeniser(path)
    return _TOKENISERS[path]


def pieces(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's ids followed by the end id."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokeniser(path)
        for batch in batches:
            doc = batch.column(0)
            for lo, hi, data, offs in text_blocks(batch, "text"):
                ids, counts = tok.block(data, offs)
                at = np.concatenate([[0], np.cumsum(counts)])
                row, piece, start, length, crc = [], [], [], [], []
                for r in range(hi - lo):
                    own = np.append(ids[at[r]:at[r + 1]], np.uint32(END_ID)).astype("<u4")
                    cuts = [0, *range(len(own) - (len(own) - 1) // capacity * capacity, len(own) + 1, capacity)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
                        row.append(lo + r)
                        piece.append(k)
                        start.append(s)
                        length.append(e - s)
                        crc.append(zlib.crc32(own[s:e].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [doc.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(cut), PIECES)


# ---- planning -----------------------------------------------------------------------------------------------

class CapacityTree:
    """Segment tree over remaining capacities 0..n: how many open sequences have each; tightest fit in O(log n)."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, k: int) -> None:
        i = capacity + self.size
        while i:
            self.open[i] += k
            i >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of at least ``least`` with an open sequence, or -1."""
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1:  # climb to the first right sibling with an open sequence, then go down to its left end
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit_plan(counts: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int, int, int]]], int]:
    """Runs of best-fit decreasing: by length, (first rank, pieces per sequence, first sequence, pieces, offset).

    Ranks first..first+pieces-1 of a length go to sequences from ``first sequence`` on, ``per`` to each, the first at
    ``offset``. Sequences with equal contents stay together as one range of numbers, so the plan is of bounded size.
    """
    tree, ranges = CapacityTree(capacity), {}  # remaining capacity -> [(first sequence, how many)]
    runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
    made = 0

    def put(free: int, first: int, k: int) -> None:
        if free and k:
            ranges.setdefault(free, []).append((first, k))
            tree.add(free, k)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            free = tree.tightest(length)
            if free < 0:
                free, per = capacity, capacity // length
                first, k = made, -(-left // per)
                made += k
            else:
                per = free // length
                first, k = ranges[free].pop()
                tree.add(free, -k)
            full = min(k, left // per)
            if full:
                runs.setdefault(length, []).append((rank, per, first, full * per, capacity - free))
                put(free - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < k:  # the last sequence of this length is filled in part
                runs.setdefault(length, []).append((rank, per, first + full, left, capacity - free))
                put(free - left * length, first + full, 1)
                full, left = full + 1, 0
            put(free, first + full, k - full)
    return runs, made


# ---- placing ------------------------------------------------------------------------------------------------

def best_fit_pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with (sequence_id, offset): best-fit decreasing over the whole table."""
    spark = df.sparkSession
    cut = written(spark, pieces(df, path, id_col, text_col, capacity), "pack-pieces")
    lengths = cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # `capacity` rows at most
    runs, _ = best_fit_plan({r.length: r.n for r in lengths}, capacity)
    total = sum(r.n for r in lengths)
    buckets = max(16, -(-total // BUCKET_ROWS))
    cut = cut.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = cut.groupBy("length", "b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "b", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    inner = Window.partitionBy("length", "b").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("q", F.row_number().over(inner)).join(counts, ["length", "b"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("q") + F.col("before") - 1).alias("rank"))
    plan = {length: np.array(x, np.int64).T for length, x in runs.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length).tolist():
                at = np.flatnonzero(length == x)
                first, per, sequence, _, offset = plan[x]
                run = np.searchsorted(first, rank[at], side="right") - 1
                nth = rank[at] - first[run]
                seq[at] = sequence[run] + nth // per[run]
                off[at] = offset[run] + nth % per[run] * x
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(seq), pa.array(off)],
                                             names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(tidied(place), PIECES + ", sequence_id long, offset long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents' pieces packed into sequences of 2048 tokens."""
    import public_tokenizers

    return best_fit_pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
