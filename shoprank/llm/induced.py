"""Suffix order with common-prefix lengths of one shard, by induced sorting with disk-backed queues.

The order of the LMS suffixes (smaller than their neighbour to the left, which is larger) induces that of all others:
scanning the order upwards, each suffix i hands i - 1 to the queue of its first byte if that one is larger (L-type);
scanning downwards, if it is smaller (S-type). Within a first byte, suffixes are handed over in their final order, so the
priority queue is a row of first-in-first-out queues, one per byte value: a monotone bucket heap. Entries are tuples
(position, length of the common prefix with the entry before); a handed-on length is one more than the least length
between the two sources. Queues keep what fits into ``memory`` bytes and write the rest to unnamed temporary files, which
vanish with the task; entries leave in batches, each handled by array operations.

LMS suffixes are sorted the same way one level down: a first induction from unsorted LMS suffixes sorts the strings between
LMS positions, whose names form a string of half the length or less; its suffixes are ranked by doubling, as its alphabet is
too large for one queue per letter. Lengths beyond ``depth`` are not told apart.
"""

from __future__ import annotations

import tempfile

import numpy as np

from .common import span_hashes

BATCH = 1 << 20


class Store:
    """Memory shared by the queues of one sort."""

    def __init__(self, memory: int):
        self.left = memory


class TupleQueue:
    """First in, first out; (positions, lengths) chunks in memory or, beyond the store's limit, on disk."""

    def __init__(self, store: Store):
        self.store, self.chunks, self.file, self.n = store, [], None, 0

    def push(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(pos):
            return
        self.n += len(pos)
        if self.store.left < pos.nbytes + lcp.nbytes:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            pos.tofile(self.file)
            lcp.tofile(self.file)
            self.file.flush()
            self.chunks.append((at, len(pos), pos.dtype))
        else:
            self.store.left -= pos.nbytes + lcp.nbytes
            self.chunks.append((pos, lcp))

    def _load(self, chunk) -> tuple[np.ndarray, np.ndarray]:
        if len(chunk) == 2:
            self.store.left += chunk[0].nbytes + chunk[1].nbytes
            return chunk
        at, n, kind = chunk
        self.file.seek(at)
        return np.fromfile(self.file, kind, n), np.fromfile(self.file, np.uint8, n)

    def pop(self) -> tuple[np.ndarray, np.ndarray]:
        """The oldest entries: at least one chunk, up to about BATCH entries."""
        got, n, i = [], 0, 0
        while i < len(self.chunks) and n < BATCH:
            got.append(self._load(self.chunks[i]))
            n += len(got[-1][0])
            i += 1
        del self.chunks[:i]
        self.n -= n
        return tuple(np.concatenate(x) for x in zip(*got)) if len(got) > 1 else got[0]

    def pop_last(self) -> tuple[np.ndarray, np.ndarray]:
        """The newest chunk."""
        got = self._load(self.chunks.pop())
        self.n -= len(got[0])
        return got


def _range_min(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first..last]) for each pair, first <= last."""
    width = last - first + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(first), values.dtype)
    table, span = values, 1
    for k in range(int(level.max()) + 1 if len(level) else 0):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[first[at]], table[last[at] - span + 1])
        if 2 * span <= len(values):
            table = np.minimum(table[:-span], table[span:])
            span *= 2
    return out


class _Scan:
    """Hands entries on from batches of one scan direction."""

    def __init__(self, text: np.ndarray, queues: list[TupleQueue], lengths: bool):
        self.text, self.queues, self.lengths = text, queues, lengths
        self.since = np.zeros(256, np.uint8)  # least common prefix since the last source of each byte
        self.filled = np.array([q.n > 0 for q in queues])

    def new_byte(self) -> None:
        self.since[:] = 0

    def hand_on(self, pos: np.ndarray, lcp: np.ndarray, give: np.ndarray) -> None:
        """give: whether pos - 1 is of the type that this scan sorts."""
        src = np.flatnonzero(give)
        if not len(src):
            if self.lengths:
                np.minimum(self.since, lcp.min(), out=self.since)
            return
        to = self.text[pos[src] - 1]
        order = np.argsort(to, kind="stable")
        src, to = src[order], to[order]
        head = np.ones(len(src), bool)
        head[1:] = to[1:] != to[:-1]
        if self.lengths:
            first = np.zeros(len(src), np.int64)
            first[1:] = src[:-1] + 1
            first[head] = 0
            least = _range_min(lcp, first, src)
            least[head] = np.minimum(least[head], self.since[to[head]])
            new = np.minimum(least, 254) + np.uint8(1)
            new[head & ~self.filled[to]] = 0
            tail = np.append(src[np.flatnonzero(head)[1:] - 1], src[-1])
            rest = np.minimum(self.since, lcp.min())
            after = tail + 1 < len(lcp)
            rest[to[head]] = 255
            rest[to[head][after]] = _range_min(lcp, tail[after] + 1, np.full(int(after.sum()), len(lcp) - 1))
            self.since = rest
        else:
            new = np.zeros(len(src), np.uint8)
        cuts = np.append(np.flatnonzero(head), len(src))
        out = pos[src] - 1
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            c = int(to[a])
            self.queues[c].push(out[a:b], new[a:b])
            self.filled[c] = True


class InducedSorter:
    """Suffix order of one byte string."""

    def __init__(self, text: np.ndarray, depth: int, memory: int = 256 << 20):
        if not 0 < depth <= 250:
            raise ValueError("common prefixes are kept in a byte: 1 to 250")
        self.text, self.depth, self.memory = text, depth, memory
        n = len(text)
        self.kind = np.int32 if n < 1 << 31 else np.int64
        turn = np.ones(n, bool)
        turn[:-1] = text[1:] != text[:-1]
        at = np.flatnonzero(turn)
        run = np.diff(np.concatenate([[-1], at]))
        rises = np.zeros(len(at), bool)
        rises[:-1] = text[at[:-1] + 1] > text[at[:-1]]
        self.small = np.repeat(rises, run)  # S-type
        self.run = np.minimum(np.repeat(at, run) - np.arange(n) + 1, 255).astype(np.uint8)
        lms = self.small.copy()
        lms[0] = False
        lms[1:] &= ~self.small[:-1]
        self.lms = np.flatnonzero(lms).astype(self.kind)

    def _induce(self, seeds: np.ndarray, seed_lcp: np.ndarray, lengths: bool):
        """Yields ("L", upwards) and ("S", downwards) batches per byte from LMS suffixes sorted by first byte."""
        text, n = self.text, len(self.text)
        store = Store(self.memory)
        larger = [TupleQueue(store) for _ in range(256)]
        done = [TupleQueue(store) for _ in range(256)]
        scan = _Scan(text, larger, lengths)
        end = np.array([n - 1], self.kind)
        larger[text[n - 1]].push(end, np.zeros(1, np.uint8))
        scan.filled[text[n - 1]] = True
        cuts = np.searchsorted(text[seeds], np.arange(257))
        for c in range(256):
            scan.new_byte()
            last = None
            while larger[c].n:
                pos, lcp = larger[c].pop()
                done[c].push(pos, lcp)
                scan.hand_on(pos, lcp, (pos > 0) & (text[pos - 1] >= c))
                last = pos[-1]
            pos = seeds[cuts[c]:cuts[c + 1]]
            if len(pos):
                lcp = seed_lcp[cuts[c]:cuts[c + 1]].copy()
                lcp[0] = 0 if last is None else min(self.run[last], self.run[pos[0]])
                scan.hand_on(pos, lcp, np.ones(len(pos), bool))
        smaller = [TupleQueue(store) for _ in range(256)]
        scan = _Scan(text, smaller, lengths)
        for c in range(255, -1, -1):
            scan.new_byte()
            last = None
            while smaller[c].n:
                pos, lcp = smaller[c].pop()
                scan.hand_on(pos, lcp, (pos > 0) & (text[pos - 1] <= c))
                yield "S", c, pos, lcp
                last = pos[-1]
            above = None if last is None else last
            edge = 0  # common prefix of a chunk's last entry with what was scanned before it
            while done[c].n:
                pos, lcp = done[c].pop_last()
                if above is not None:
                    edge = min(self.run[above], self.run[pos[-1]])
                    above = None
                back = np.empty(len(lcp), np.uint8)  # with the entry scanned before
                back[0], back[1:] = edge, lcp[:0:-1]
                edge = lcp[0]
                pos = pos[::-1]
                scan.hand_on(pos, back, (pos > 0) & (text[pos - 1] < c))
                yield "L", c, pos, back

    def _sorted_lms(self) -> np.ndarray:
        text, lms = self.text, self.lms
        n1 = len(lms)
        if n1 < 2:
            return lms
        seeds = lms[np.argsort(text[lms], kind="stable")]
        is_lms = np.zeros(len(text), bool)
        is_lms[lms] = True
        found = [pos[is_lms[pos]] for kind, _, pos, _ in self._induce(seeds, np.zeros(n1, np.uint8), False) if kind == "S"]
        order = np.concatenate(found)[::-1]
        number = np.empty(len(text), self.kind)
        number[lms] = np.arange(n1)
        ends = np.append(lms[1:].astype(np.int64) + 1, len(text))
        name = span_hashes(np.ascontiguousarray(text), lms.astype(np.int64), ends)
        name[-1] = 0  # the last one ends with the text: like no other
        i = number[order]
        new = np.ones(n1, bool)
        new[1:] = name[i[1:]] != name[i[:-1]]
        rank = np.empty(n1, np.int64)
        start = np.flatnonzero(new)
        rank[i] = np.repeat(start, np.diff(np.append(start, n1)))
        h = 1
        tied = i[~(new & np.append(new[1:], True))]
        while len(tied):
            if h < n1:
                far = np.minimum(tied.astype(np.int64) + h, n1 - 1)
                known = lms[far] - lms[tied].astype(np.int64)
                if (known >= self.depth).all():
                    break
            nxt = tied.astype(np.int64) + h
            second = np.where(nxt < n1, rank[np.minimum(nxt, n1 - 1)] + 1, 0)
            by = np.lexsort((second, rank[tied]))
            t, r, s = tied[by], rank[tied][by], second[by]
            group = np.ones(len(t), bool)
            group[1:] = r[1:] != r[:-1]
            part = group.copy()
            part[1:] |= s[1:] != s[:-1]
            at = np.arange(len(t))
            base = np.maximum.accumulate(np.where(group, at, 0))
            rank[t] = r + np.maximum.accumulate(np.where(part, at, 0)) - base
            alone = part & np.append(part[1:], True)
            tied = t[~alone]
            h *= 2
        out = np.argsort(rank, kind="stable")
        return lms[out]

    def _lms_lengths(self, order: np.ndarray) -> np.ndarray:
        """Common prefix of each LMS suffix with the one before it, up to ``depth``."""
        text, n = self.text, len(self.text)
        out = np.zeros(len(order), np.uint8)
        if len(order) < 2:
            return out
        pad = np.concatenate([text, np.zeros(8, np.uint8)])
        word = np.zeros(n, np.uint64)
        for k in range(8):
            word |= pad[k:k + n].astype(np.uint64) << np.uint64(8 * k)
        live = np.arange(1, len(order))
        a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
        for step in range(0, self.depth, 8):
            x, y = a[live - 1] + step, b[live - 1] + step
            inside = (x < n) & (y < n)
            diff = np.where(inside, word[np.minimum(x, n - 1)] ^ word[np.minimum(y, n - 1)], np.uint64(1))
            same = diff == 0
            bytes_ = diff[~same].view(np.uint8).reshape(-1, 8) != 0
            room = n - np.maximum(x, y)[~same]
            out[live[~same]] = np.minimum(step + np.minimum(bytes_.argmax(1), np.maximum(room, 0)), 255)
            live = live[same]
            if not len(live):
                break
        out[live] = self.depth
        return out

    def repeats(self) -> np.ndarray:
        """Whether the ``depth`` bytes from each position start anywhere else too."""
        n = len(self.text)
        out = np.zeros(n, bool)
        if not n:
            return out
        order = self._sorted_lms()
        before = None
        for _, c, pos, lcp in self._induce(order, self._lms_lengths(order), True):
            hit = lcp >= self.depth
            out[pos[hit]] = True
            out[pos[:-1][hit[1:]]] = True
            if hit[0] and before is not None:
                out[before] = True
            before = pos[-1]
        return out
