"""Periodic runs of words: maximal repetitions found with suffix trees.

A run is a stretch of words with smallest period q, at least ``least`` words and ``times`` * q words long, which no
neighbouring word extends with the same period. Runs come from the Lyndon roots: the longest Lyndon word that
starts at a position, in the order of the words or in the opposite order, is tried as a root, and is extended to the
right by the longest common prefix of the two suffixes one root apart and to the left by the same on the reversal.
Common extensions are depths of lowest common ancestors in Ukkonen suffix trees of the words and of their
reversal: minima over a Euler tour, answered in constant time from block minima.

Trees are built only where a run can be. Every word group of least / times words within a run recurs at a distance
of the period, which is at most a third of the stretch around the run; stretches without such recurrences hold none,
and are left out by hashes of the groups (an equal hash of different groups only leaves a stretch in).

Words are runs of bytes other than U+0020 and U+0009 to U+000D, compared byte by byte. Null texts have no words.
Texts are read in parts and kept as word numbers; a tree takes about 400 bytes a word of its stretch while it stands.
Rows are independent: repeated rows and null ids are answered each for itself; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Bytes of one text that are split at once, and words that are joined at once.
PART = 1 << 20
#: Entries of the Euler tour in one block.
BLOCK = 16
_SPACE = b" \t\n\v\f\r"


class SuffixTree:
    """Ukkonen suffix tree of non-negative numbers, as leaf order and longest common extensions."""

    def __init__(self, symbols: np.ndarray):
        text = (symbols + 1).tolist() + [0]  # 0 ends the text and is less than any word
        starts, ends, edges, width = self._grown(text)
        self._walk(len(text), starts, ends, edges, width)

    @staticmethod
    def _grown(text: list[int]) -> tuple[list[int], list[int], dict[int, int], int]:
        """Edge labels text[start:end] of the nodes, and (node * width + first symbol) -> child."""
        n, width = len(text), max(text) + 1
        starts, ends, links = [0], [0], [0]
        edges: dict[int, int] = {}
        node = edge = along = pending = 0
        for i, symbol in enumerate(text):
            pending += 1
            fresh = 0  # inner node made in this step that waits for its suffix link
            while pending:
                if not along:
                    edge = i
                slot = node * width + text[edge]
                below = edges.get(slot)
                if below is None:
                    edges[slot] = len(starts)
                    starts.append(i)
                    ends.append(n)
                    links.append(0)
                    if fresh:
                        links[fresh] = node
                        fresh = 0
                else:
                    at = starts[below]
                    size = ends[below] - at
                    if along >= size:
                        edge += size
                        along -= size
                        node = below
                        continue
                    if text[at + along] == symbol:
                        along += 1
                        if fresh:
                            links[fresh] = node
                        break
                    inner = len(starts)
                    starts += (at, i)
                    ends += (at + along, n)
                    links += (0, 0)
                    starts[below] = at + along
                    edges[slot] = inner
                    edges[inner * width + symbol] = inner + 1
                    edges[inner * width + text[at + along]] = below
                    if fresh:
                        links[fresh] = inner
                    fresh = inner
                pending -= 1
                if node:
                    node = links[node]
                elif along:
                    along -= 1
                    edge = i - pending + 1
        return starts, ends, edges, width

    def _walk(self, n: int, starts: list[int], ends: list[int], edges: dict[int, int], width: int) -> None:
        """Euler tour of the text depths, children in symbol order."""
        slots = np.fromiter(edges.keys(), np.int64, len(edges))
        kids = np.fromiter(edges.values(), np.int64, len(edges))
        edges.clear()
        order = np.argsort(slots)
        first = np.searchsorted(slots[order], np.arange(len(starts) + 1) * width).tolist()
        kids = kids[order].tolist()
        sizes = (np.array(ends) - np.array(starts)).tolist()
        depth = [0] * len(starts)
        tour: list[int] = []
        leaves: list[int] = []  # starts of the suffixes in their order
        seen = np.zeros(n, np.int64)  # place of a suffix's leaf in the tour
        places: list[int] = []
        stack = [0]
        while stack:
            x = stack.pop()
            if x < 0:
                tour.append(depth[~x])
                continue
            d = depth[x]
            a, b = first[x], first[x + 1]
            if a == b:
                leaves.append(n - d)
                places.append(len(tour))
                tour.append(d)
                continue
            tour.append(d)
            for k in range(b - 1, a, -1):
                stack += (kids[k], ~x)
                depth[kids[k]] = d + sizes[kids[k]]
            stack.append(kids[a])
            depth[kids[a]] = d + sizes[kids[a]]
        suffixes = np.array(leaves)
        seen[suffixes] = places
        self.place = seen
        self.rank = np.empty(n, np.int64)
        self.rank[suffixes] = np.arange(n)
        flat = np.full(-(-len(tour) // BLOCK) * BLOCK, n, np.int32)
        flat[:len(tour)] = tour
        blocks = flat.reshape(-1, BLOCK)
        self._tour = flat
        self._ahead = np.minimum.accumulate(blocks, 1).ravel()
        self._behind = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1]).ravel()
        self._least = [blocks.min(1)]
        while 2 << (len(self._least) - 1) <= len(blocks):
            low, step = self._least[-1], 1 << (len(self._least) - 1)
            self._least.append(np.minimum(low[:-step], low[step:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at i and at j (i and j differ)."""
        a, b = self.place[i], self.place[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        out = np.minimum(self._behind[low], self._ahead[high])
        from_block, to_block = low // BLOCK + 1, high // BLOCK
        gap = to_block - from_block
        inside = np.flatnonzero(gap < 0)
        if len(inside):
            l, h = low[inside], high[inside]
            best = self._tour[l]
            for k in range(1, BLOCK):
                best = np.minimum(best, self._tour[np.minimum(l + k, h)])
            out[inside] = best
        wide = np.flatnonzero(gap > 0)
        level = np.frexp(gap[wide].astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = wide[level == k]
            row = self._least[k]
            out[at] = np.minimum(out[at], np.minimum(row[from_block[at]], row[to_block[at] - (1 << k)]))
        return out.astype(np.int64)


def _next_less(rank: list[int]) -> np.ndarray:
    """The next position with a smaller rank, for every position (the end: none)."""
    n = len(rank)
    out = np.full(n, n, np.int64)
    found, stack = out.tolist(), []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            found[stack.pop()] = i
        stack.append(i)
    return np.array(found, np.int64)


def _stretch_runs(ids: np.ndarray, least: int, times: int) -> set[tuple[int, int, int]]:
    """Runs (start, length, period) of one stretch."""
    n = len(ids)
    ids = np.unique(ids, return_inverse=True)[1]
    tree = SuffixTree(ids)
    pairs = []
    for rank in (tree.rank[:n], n - tree.rank[:n]):
        root = _next_less(rank.tolist())
        i = np.flatnonzero(root < n)
        j = root[i]
        same = ids[i] == ids[j]
        pairs.append((i[same], j[same]))
    i, j = (np.concatenate(x) for x in zip(*pairs))
    right = tree.common(i, j) if len(i) else i
    whole = right >= j - i  # a run's first root is followed by another one
    i, j, right = i[whole], j[whole], right[whole]
    del tree
    if not len(i):
        return set()
    left = SuffixTree(ids[::-1]).common(n - i, n - j)
    length = j + right - i + left
    keep = length >= np.maximum(least, times * (j - i))
    return set(zip((i - left)[keep].tolist(), length[keep].tolist(), (j - i)[keep].tolist()))


def _stretches(ids: np.ndarray, group: int, least: int) -> Iterator[tuple[int, int]]:
    """(from, to) of the stretches that can hold runs."""
    n = len(ids) - group + 1
    if len(ids) < least:
        return
    h = ids[:n].astype(np.uint64)
    for k in range(1, group):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n].astype(np.uint64)
    work = [(0, n)]
    while work:
        a, b = work.pop()
        part = h[a:b]
        order = np.argsort(part, kind="stable")
        s = part[order]
        far = np.diff(order)
        near = (s[1:] == s[:-1]) & (far <= (b - a + group - 1) // 3)
        back = np.zeros(b - a + 2, np.int8)
        back[order[1:][near] + 1] = 1
        back[order[:-1][near] + 1] = 1
        turn = np.diff(back)
        for x, y in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
            if y - x + group - 1 >= least:
                if y - x == b - a:
                    yield a, b + group - 1
                else:
                    work.append((a + x, a + y))


def word_runs(ids: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of word numbers, by start and period."""
    if times < 3 or least < times:
        raise ValueError("runs of fewer than three periods are not supported")
    found: set[tuple[int, int, int]] = set()
    for a, b in _stretches(ids, least // times, least):
        found |= {(a + s, size, p) for s, size, p in _stretch_runs(ids[a:b], least, times)}
    return sorted(found, key=lambda r: (r[0], r[2]))


def word_numbers(text: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the word of each number."""
    known: dict[bytes, int] = {}
    parts, at, n = [], 0, len(text)
    while at < n:
        end = min(at + PART, n)
        while end < n and text[end] not in _SPACE:
            end += 1
        words = text[at:end].split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        at = end
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), list(known)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int | None, int | None, int | None]:
    """The run of the greatest exact length / period; the first of equal ones (by start, then period)."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best or (None, None, None)


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3,
                  edit: Callable[[int | None, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(id, runs array<struct<start,length,period>>, start, length, period, collapsed) for every row. No shuffle.

    start, length, period: the strongest run. collapsed: the words joined by one space, without those that a run holds after
    its first period. ``edit`` may change the word numbers of a row (given its id) before runs are looked for.
    """
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def answer(doc_id: int | None, text: bytes | None) -> tuple:
        ids, words = word_numbers(text or b"")
        if edit is not None:
            ids = edit(doc_id, ids)
        runs = word_runs(ids, least, times)
        drop = np.zeros(len(ids) + 1, np.int64)
        for start, length, period in runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        kept = ids[np.cumsum(drop[:-1]) == 0]
        joined = b" ".join(b" ".join(words[k] for k in kept[at:at + PART].tolist()) for at in range(0, len(kept), PART))
        return [dict(zip(("start", "length", "period"), r)) for r in runs], *strongest(runs), joined

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = part.column(0)
                texts = part.column(1).cast(pa.large_binary())
                out = [answer(i.as_py(), t.as_py()) for i, t in zip(ids, texts)]
                runs, start, length, period, joined = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(runs, run_type), *(pa.array(x, pa.int64()) for x in (start, length, period)),
                     pa.array(joined, pa.binary()).cast(pa.string())],
                    names=["doc_id", "runs", "start", "length", "period", "collapsed"])

    return rows.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, "
                                "start long, length long, period long, collapsed string")


def echoed(doc_id: int | None, ids: np.ndarray) -> np.ndarray:
    """The query's planted repetitions: in one document of ten the words from a place on repeat with a period.

    Rows without an id stay as they are.
    """
    if doc_id is None or not len(ids):
        return ids
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return ids
    g, n = h // 10, len(ids)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return ids[np.where(at < a, at, a + (at - a) % p)]


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of at least 24 words and three periods of every document, as digests."""
    out = periodic_runs(table(spark, sf_dir, "documents", "doc_id", "text"), edit=echoed)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period",
        F.expr("(1000 * length) DIV period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
