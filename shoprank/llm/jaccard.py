"""N-gram Jaccard join: prefix candidates, then count-vector R-trees with verified pairs.

A document's set is its distinct word shingles (64-bit hashes). Documents with equal sets are one class. Classes link
if 100 * |A n B| >= 80 * |A u B|, i.e. 9 |A n B| >= 4 (|A| + |B|).

1. Candidates. Tokens are ordered: sampled ones (a fixed share of the hash range) by the number of classes that hold
   them, then the rest by hash, last of all hot ones (those that HOT_SHARE of the classes hold) by hash. Two linked sets share a token among the first floor(|A| / 5) + 1 of either, whatever
   the order; rare tokens first, a class whose first tokens are its own alone needs no further look. The others are
   tied to the least class of each first token's holders; ties make blocks that no link crosses. Lines that many documents
   share (notices, licenses) tie short ones that have little else among their sampled tokens, and such blocks grow faster
   than the table; in blocks of more than FINER classes all tokens are counted, and ties by the first ones make finer blocks.
2. Join. In a block, tokens are hashed into GROUPS groups; a class is the point of its group counts. An R-tree over the
   points gives, for a class, an upper bound of the overlap with everything below a node: the sum over groups of the
   smaller of its count and the node's largest. Nodes whose bound is under the overlap needed for their smallest set are
   not entered. Surviving pairs of different components are verified by intersecting the sets, best bound first.
3. Blocks of more than CHUNK classes are cut: each chunk is joined for itself, then one class of each chunk's component
   with those of the other chunks, and where components remain apart, every pair of chunks.

Distribution: hashes travel as packed arrays keyed by hash range; equal documents are reduced to one class inside each
task and again in the range. Hot tokens don't travel: the least class of each (as many as HOT_SHARE allows, times a
document's tokens) is found by a grouped minimum and sent to the tasks, which tie classes to it where they stand.

Null and empty texts and texts without words have empty sets, linked with nothing: a component of their own id.
Repeated rows are one class. With fewer than ``k`` words the whole sequence is the one shingle. Rows with a null id link
like others; a component's id is its smallest non-null one. Other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import long_words, lowered, mix64, span_hashes, table, text_blocks, tidied, word_spans, written
from .components import components

WORDS = 5
#: Share of the hash range whose tokens are counted.
SAMPLED = 0.4
_CUT = np.uint64(int(SAMPLED * 2 ** 64))
GROUPS = 128
LEAF = 24
#: A token is hot if so large a share of the classes hold it; what fewer classes of a counted lot hold isn't reported.
HOT_SHARE, HOT_LEAST = 1 / 256, 64
#: Tokens that are counted at a time to find hot ones.
HOT_BATCH = 1_000_000
#: Text bytes that are hashed at a time.
BLOCK = 1 << 20
#: Most classes that are joined in one task.
CHUNK = 4000
#: Blocks of more classes are made anew from counts of all their tokens.
FINER = 1000
#: Bytes of packed hashes that one range or bucket of blocks is meant to hold.
RANGE_BYTES = 12 << 20
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
                             0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7)]


def _hashed_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of every lower-cased word."""
    low = lowered(data)
    starts, ends, row = word_spans(low, offs)
    return starts, ends, row, span_hashes(low, starts, ends)


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts one after another, number per text)."""
    rows = len(offs) - 1
    _, _, row, w = long_words(_hashed_words, data, offs)
    if not len(w):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    padded = np.concatenate([w, np.zeros(k, np.uint64)])
    h = np.zeros(len(w), np.uint64)
    for i in range(k):
        h += padded[i:i + len(w)] * _C[i % len(_C)] + np.uint64(i // len(_C))
    h = mix64(h)
    sets, n = [], np.zeros(rows, np.int64)
    for r in np.flatnonzero(count).tolist():
        a, c = first[r], count[r]
        if c >= k:
            s = np.unique(h[a:a + c - k + 1])
        else:
            s = mix64(np.array([sum(int(x) * int(y) for x, y in zip(w[a:a + c], _C)) + int(c) & 0xFFFFFFFFFFFFFFFF], np.uint64))
        sets.append(s)
        n[r] = len(s)
    return np.concatenate(sets), n


def fingerprints(flat: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 63-bit number per set; 0 for the empty one."""
    out = np.zeros(len(n), np.uint64)
    has = n > 0
    if has.any():
        sums = np.add.reduceat(mix64(flat ^ _C[5]), (np.cumsum(n) - n)[has])
        out[has] = (mix64(sums + n[has].astype(np.uint64) * _C[6]) >> np.uint64(1)) | np.uint64(1)
    return out.astype(np.int64)


def _first_of(n: np.ndarray) -> np.ndarray:
    """How many first tokens of a set of n must be looked at."""
    return n // 5 + 1


def signatures(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(doc_id, n, fp) of every row, and rows (null, classes, token) with ``hot`` of what is hot among about HOT_BATCH tokens."""
    share, least = HOT_SHARE, HOT_LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        classes: set[int] = set()
        for batch in batches:
            for lo, hi, data, offs in text_blocks(batch, "text", BLOCK):
                flat, n = shingle_sets(data, offs, k)
                fp = fingerprints(flat, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(fp), pa.array(np.zeros(hi - lo, bool))],
                                                 names=["doc_id", "n", "fp", "hot"])
                new = np.array([x not in classes for x in fp.tolist()]) & (n > 0)
                new &= np.isin(np.arange(len(fp)), np.unique(fp, return_index=True)[1])
                classes.update(fp[new].tolist())
                held.append(flat[np.repeat(new, n)])
                if sum(map(len, held)) > HOT_BATCH:
                    yield report(held, len(classes))
                    held, classes = [], set()
        if held:
            yield report(held, len(classes))

    def report(held: list[np.ndarray], classes: int) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        at = np.flatnonzero(count >= max(least, share * classes))
        return pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(count[at]), pa.array(token[at].view(np.int64)), pa.array(np.ones(len(at), bool))],
                                          names=["doc_id", "n", "fp", "hot"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, n long, fp long, hot boolean")


def _by_range(ranges: int, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(range number, positions) of hashes dealt by their high bits."""
    part = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(ranges + 1))
    for p in range(ranges):
        if cuts[p] < cuts[p + 1]:
            yield p, order[cuts[p]:cuts[p + 1]]


_PACKED = "part int, fp binary, n binary, token binary, df binary"
_TYPES = {"fp": "<i8", "n": "<i4", "token": "<u8", "df": "<i4"}


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.int32()), *(pa.array([x.astype(t).tobytes() for x in c], pa.binary()) for c, t in zip(cols[1:], _TYPES.values()))],
        names=["part", *_TYPES])


def _unpack(t: pa.Table) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate([np.zeros(0, d), *(np.frombuffer(x, d) for x in t[c].to_pylist())]) for c, d in _TYPES.items())


def _order(flat: np.ndarray, n: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, whether hot, rank among the row's tokens that are alike in that, number of the row's other tokens)."""
    row = np.repeat(np.arange(len(n)), n)
    is_hot = np.isin(flat, hot) if len(hot) else np.zeros(len(flat), bool)
    hots = np.bincount(row[is_hot], minlength=len(n))
    seen = np.cumsum(is_hot)
    before = np.cumsum(hots) - hots
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    rank_hot = seen - 1 - before[row]
    rank = np.where(is_hot, rank_hot, place - (seen - before[row]))
    return row, is_hot, rank, n - hots


def _hot_ties(docs: DataFrame, k: int, hot: np.ndarray) -> DataFrame | None:
    """(fp, hub): classes whose first tokens include hot ones, tied to the least such class of each; None if there are none."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def firsts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for _, _, data, offs in text_blocks(batch, "text", BLOCK):
            flat, n = shingle_sets(data, offs, k)
            fp = fingerprints(flat, n)
            row, is_hot, rank, others = _order(flat, n, sent.value)
            need = is_hot & (rank < (_first_of(n) - others)[row])
            yield fp[row[need]], flat[need].view(np.int64)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, token = (np.concatenate(x) for x in zip(*firsts(batch), (np.zeros(0, np.int64),) * 2))
            order = np.lexsort((fp, token))
            fp, token = fp[order], token[order]
            head = np.ones(len(fp), bool)
            head[1:] = token[1:] != token[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(token[head]), pa.array(fp[head])], names=["token", "hub"])

    hubs = docs.mapInArrow(tidied(least), "token long, hub long").groupBy("token").agg(F.min("hub").alias("hub")).collect()  # hot tokens at most
    if not hubs:
        return None
    to = docs.sparkSession.sparkContext.broadcast(tuple(np.array(x) for x in zip(*sorted((r.token, r.hub) for r in hubs))))

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, hub = to.value
        for batch in batches:
            for fp, token in firsts(batch):
                pairs = np.unique(np.stack([fp, hub[np.searchsorted(tokens, token)]], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["fp", "hub"])

    return docs.mapInArrow(tidied(tie), "fp long, hub long")


def _emitted(docs: DataFrame, k: int, ranges: int, hot: np.ndarray) -> DataFrame:
    """Each class's sampled tokens, and the least others it needs, packed by hash range; no hot ones."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = 0
            for lo, hi, data, offs in text_blocks(batch, "text", BLOCK):
                flat, n = shingle_sets(data, offs, k)
                fp = fingerprints(flat, n)
                own = np.zeros(hi - lo, bool)
                own[np.unique(fp, return_index=True)[1]] = True
                own &= n > 0
                row, is_hot, rank, _ = _order(flat, n, sent.value)  # sets are sorted: sampled tokens come first
                keep = own[row] & ~is_hot & ((flat < _CUT) | (rank < _first_of(n)[row]))
                held.append((fp[row[keep]], n[row[keep]], flat[keep]))
                size += len(held[-1][0])
                if size > 1 << 19:
                    yield _dealt(held, ranges)
                    held, size = [], 0
            if held:
                yield _dealt(held, ranges)

    return docs.mapInArrow(tidied(run), _PACKED)


def _dealt(held: list[tuple], ranges: int) -> pa.RecordBatch:
    """Arrays (fp, n, token) as a row for each hash range."""
    fp, n, token = (np.concatenate(x) for x in zip(*held))
    return _pack([(p, fp[at], n[at], token[at], np.zeros(0, np.int32)) for p, at in _by_range(ranges, token)])


def _counted(emitted: DataFrame, ranges: int) -> DataFrame:
    """By range of class numbers: (class, size, token, classes that hold it), token 0 and df the count for those held by one."""

    def run(t: pa.Table) -> pa.Table:
        fp, n, token, _ = _unpack(t)
        order = np.lexsort((fp, token))
        fp, n, token = fp[order], n[order], token[order]
        new = np.ones(len(fp), bool)
        new[1:] = (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])
        fp, n, token = fp[new], n[new], token[new]
        head = np.ones(len(fp), bool)
        head[1:] = token[1:] != token[:-1]
        at = np.flatnonzero(head)
        df = np.repeat(np.diff(np.append(at, len(fp))), np.diff(np.append(at, len(fp)))).astype(np.int32)
        alone = df == 1
        cls, first, c = np.unique(fp[alone], return_index=True, return_counts=True)
        fp, n, token, df = (np.concatenate([x, y]) for x, y in ((fp[~alone], cls), (n[~alone], n[alone][first]),
                                                               (token[~alone], np.zeros(len(cls), np.uint64)), (df[~alone], c.astype(np.int32))))
        return pa.Table.from_batches([_pack([(p, fp[i], n[i], token[i], df[i]) for p, i in _by_range(ranges, mix64(fp.astype(np.uint64)))])])

    return emitted.groupBy("part").applyInArrow(run, _PACKED)


def _first_tokens(counted: DataFrame, ranges: int, all_counted: bool = False) -> DataFrame:
    """By hash range: (class, token) of the first tokens that another class holds too. all_counted: none is known by its hash only."""

    def run(t: pa.Table) -> pa.Table:
        fp, n, token, df = _unpack(t)
        alone = token == 0
        late = ~alone & (token >= _CUT) & (not all_counted)
        order = np.lexsort((token, np.where(late, 0, df), late, ~alone, fp))
        fp, n, token, df, alone = fp[order], n[order], token[order], df[order], alone[order]
        head = np.ones(len(fp), bool)
        head[1:] = fp[1:] != fp[:-1]
        cls = np.cumsum(head) - 1
        before = np.cumsum(np.where(alone, df, 1))  # tokens up to and with this entry
        base = before[head] - np.where(alone, df, 1)[head]
        place = before - base[cls]
        keep = ~alone & (place <= _first_of(n))
        fp, n, token = fp[keep], n[keep], token[keep]
        return pa.Table.from_batches([_pack([(p, fp[i], n[i], token[i], np.zeros(0, np.int32)) for p, i in _by_range(ranges, token)])])

    return counted.groupBy("part").applyInArrow(run, _PACKED)


def _ties(first: DataFrame) -> DataFrame:
    """(fp, hub): classes of a common first token, tied to the least of them."""

    def run(t: pa.Table) -> pa.Table:
        fp, _, token, _ = _unpack(t)
        order = np.lexsort((fp, token))
        fp, token = fp[order], token[order]
        head = np.ones(len(fp), bool)
        head[1:] = token[1:] != token[:-1]
        hub = fp[head][np.cumsum(head) - 1]
        pairs = np.unique(np.stack([fp, hub], 1)[fp != hub], axis=0)
        return pa.table({"fp": pa.array(pairs[:, 0]), "hub": pa.array(pairs[:, 1])})

    return first.groupBy("part").applyInArrow(run, "fp long, hub long")


def _block_tokens(sets: DataFrame, ranges: int) -> DataFrame:
    """All tokens of classes (block, fp, set), packed by hash range; equal tokens of different blocks differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, fp, held, size = *(np.asarray(batch.column(i)) for i in range(2)), [], 0
            for i in range(len(batch)):
                s = np.frombuffer(batch.column(2)[i].as_py(), "<u8")
                held.append((np.full(len(s), fp[i]), np.full(len(s), len(s)), np.maximum(mix64(s ^ mix64(block[i:i + 1].astype(np.uint64))), np.uint64(1))))
                size += len(s)
                if size > 1 << 19:
                    yield _dealt(held, ranges)
                    held, size = [], 0
            if held:
                yield _dealt(held, ranges)

    return sets.select("block", "fp", "set").mapInArrow(tidied(run), _PACKED)


def _finer_blocks(sets: DataFrame, tokens: int) -> DataFrame:
    """``sets`` (block, fp, set) of classes that may link, by all their tokens, with the block they are left in and its size."""
    ranges = max(8, int(tokens * 20 / RANGE_BYTES) + 1)
    ties = _ties(_first_tokens(_counted(_block_tokens(sets, ranges), ranges), ranges, all_counted=True))
    finer = components(ties, "fp", "hub").select(F.col("node").alias("fp"), F.col("root").alias("block"))
    finer = written(sets.sparkSession, finer, "jaccard-finer")
    sizes = finer.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    return sets.select("fp", "set").join(finer.join(sizes, "block"), "fp")


# ---- joining ------------------------------------------------------------------------------------------------

class CountTree:
    """R-tree over count vectors: per node the largest counts and the smallest set size below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.high, self.least, self.kids, self.leaf = [], [], [], []
        self._build(np.arange(len(points)))
        self.high, self.least = np.array(self.high), np.array(self.least)

    def _build(self, at: np.ndarray) -> int:
        me = len(self.high)
        p = self.points[at]
        self.high.append(p.max(0))
        self.least.append(self.sizes[at].min())
        self.kids.append(None)
        self.leaf.append(None)
        if len(at) <= LEAF:
            self.leaf[me] = at
            return me
        spread = p.max(0).astype(np.int64) - p.min(0)
        by = self.sizes[at] if np.ptp(self.sizes[at]) > spread.max() else p[:, int(spread.argmax())]
        order = at[np.argsort(by, kind="stable")]
        cuts = np.array_split(order, 4 if len(at) > 4 * LEAF else 2)
        self.kids[me] = [self._build(c) for c in cuts if len(c)]
        return me

    def reach(self, point: np.ndarray, size: int, eligible: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(members, bounds) whose bound allows a link with a set of this point and size."""
        todo, members = [0], []
        while todo:
            bound = np.minimum(self.high[todo], point).sum(1)
            go = [x for x, ok in zip(todo, 9 * bound >= 4 * (self.least[todo] + size)) if ok]
            members += [self.leaf[x] for x in go if self.leaf[x] is not None]
            todo = [y for x in go if self.leaf[x] is None for y in self.kids[x]]
        if not members:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        m = np.concatenate(members)
        m = m[eligible[m]]
        bound = np.minimum(self.points[m], point).sum(1)
        ok = 9 * bound >= 4 * (self.sizes[m] + size)
        return m[ok], bound[ok]


def count_vector(s: np.ndarray) -> np.ndarray:
    return np.bincount((s % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets link."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return 9 * int((b[at] == a).sum()) >= 4 * (len(a) + len(b))


def join_block(sets: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Component of each set (the least position), given components known already."""
    sizes = np.array([len(s) for s in sets], np.int64)
    points = np.array([count_vector(s) for s in sets])
    tree = CountTree(points, sizes)
    label = label.copy()
    done = np.zeros(len(sets), bool)
    for i in range(len(sets)):
        near, bound = tree.reach(points[i], int(sizes[i]), done & (label != label[i]))
        for j in near[np.argsort(-bound, kind="stable")].tolist():
            if label[j] != label[i] and linked(sets[i], sets[j]):
                x, y = sorted((label[i], label[j]))
                label[label == y] = x
        done[i] = True
    return label


def _joined(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(fp, tie): classes tied to the least class of their component in each group; rows: keys, block, fp, seen, set."""

    def run(t: pa.Table) -> pa.Table:
        block = np.asarray(t["block"])
        fp, seen = np.asarray(t["fp"]), np.asarray(t["seen"])
        raw = t["set"]
        order = np.lexsort((fp, block))
        cuts = np.flatnonzero(np.concatenate([[True], block[order][1:] != block[order][:-1], [True]]))
        out_fp, out_tie = [], []
        for a, b in zip(cuts, cuts[1:]):
            at = order[a:b]
            at = at[np.unique(fp[at], return_index=True)[1]]
            label = np.unique(seen[at], return_inverse=True)[1]
            label = np.array([np.flatnonzero(label == x)[0] for x in range(label.max() + 1)])[label] if len(at) else label
            if len(at) > 1:
                label = join_block([np.frombuffer(raw[i].as_py(), "<u8") for i in at.tolist()], label)
            out_fp.append(fp[at])
            out_tie.append(fp[at][label])
        return pa.table({"fp": pa.array(np.concatenate(out_fp), pa.int64()), "tie": pa.array(np.concatenate(out_tie), pa.int64())})

    return rows.select(*dict.fromkeys([*keys, "block", "fp", "seen", "set"])).groupBy(*keys).applyInArrow(run, "fp long, tie long")


def _sets_of(docs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(columns of ``blocks``, set) for one document of each class in ``blocks`` (which has doc_id).

    Classes whose documents all lack an id are found by the fingerprints of the documents without an id.
    """
    keep = [c for c in blocks.columns if c != "doc_id"]

    def sets_with(carry: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, data, offs in text_blocks(batch, "text", BLOCK):
                    flat, n = shingle_sets(data, offs, k)
                    fp = fingerprints(flat, n)
                    at = np.cumsum(n)
                    s = pa.array([flat[e - c:e].astype("<u8").tobytes() for e, c in zip(at.tolist(), n.tolist())], pa.binary())
                    out = pa.RecordBatch.from_arrays([pa.array(fp, pa.int64()), s, *(batch.column(batch.schema.get_field_index(c)).slice(lo, hi - lo) for c in carry)],
                                                     names=["of", "set", *carry])
                    own = fp == np.asarray(out.column("fp")) if "fp" in carry else n > 0
                    yield out.filter(pa.array(own))

        return run

    types = ", ".join(["of long, set binary", *(f"{c} {t}" for c, t in blocks.dtypes if c != "doc_id")])
    known = docs.join(blocks.where("doc_id IS NOT NULL"), "doc_id").select(*keep, "text").mapInArrow(tidied(sets_with(keep)), types)
    nameless = docs.where("doc_id IS NULL").select("text").mapInArrow(tidied(sets_with([])), "of long, set binary").dropDuplicates(["of"])
    nameless = nameless.join(blocks.where("doc_id IS NULL"), F.col("of") == F.col("fp"))
    return known.dropDuplicates(["fp"]).select(*keep, "set").unionByName(nameless.select(*keep, "set"))


def classes_with_links(docs: DataFrame, sig: DataFrame, reported: DataFrame, k: int) -> DataFrame | None:
    """(node, root) over classes that link with another; None if no class can."""
    spark = docs.sparkSession
    stats = sig.where("n > 0").agg(F.sum("n").alias("n"), F.approx_count_distinct("fp").alias("classes")).first()
    if not stats.n:
        return None
    counts = reported.groupBy("fp").agg(F.sum("n").alias("n")).where(F.col("n") >= max(HOT_LEAST, HOT_SHARE * stats.classes))
    hot = np.sort(np.array([r.fp for r in counts.select("fp").collect()], np.int64).view(np.uint64))
    ranges = max(8, int(stats.n * SAMPLED * 20 / RANGE_BYTES) + 1)
    ties = _ties(_first_tokens(_counted(_emitted(docs, k, ranges, hot), ranges), ranges))
    hot_ties = _hot_ties(docs.select("text"), k, hot) if len(hot) else None
    ties = ties if hot_ties is None else ties.unionByName(hot_ties)
    blocks = components(ties, "fp", "hub").select(F.col("node").alias("fp"), F.col("root").alias("block"))
    blocks = written(spark, blocks, "jaccard-blocks")
    sizes = blocks.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    one = sig.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    placed = blocks.join(sizes, "block").join(one, "fp")
    total = placed.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("size") > FINER, F.col("n"))).alias("large")).first()
    if not total.n:
        return None
    buckets = max(8, int(total.n * 8 / RANGE_BYTES) + 1)
    sets = written(spark, _sets_of(docs, placed.select("doc_id", "fp", "block", "size"), k), "jaccard-sets")
    if total.large:
        finer = _finer_blocks(sets.where(F.col("size") > FINER), total.large)
        sets = sets.where(F.col("size") <= FINER).unionByName(written(spark, finer, "jaccard-finer-sets"))
    most = sets.agg(F.max("size")).first()[0]
    big = F.col("size") > CHUNK
    chunks = F.ceil(F.col("size") / F.lit(CHUNK))
    sets = sets.select(
        "fp", "set", "block", big.alias("big"), chunks.cast("int").alias("chunks"), F.col("fp").alias("seen"),
        F.when(big, F.pmod(F.xxhash64("fp"), chunks)).otherwise(-1).cast("int").alias("chunk"),
        F.when(big, F.col("block")).otherwise(F.pmod(F.xxhash64("block"), F.lit(buckets))).alias("bucket"))
    ties = written(spark, _joined(sets, ["bucket", "chunk"]), "jaccard-ties")
    if most is None or most <= CHUNK:
        return ties.select(F.col("fp").alias("node"), F.col("tie").alias("root"))
    # cut blocks: first one class of each chunk's component against those of the other chunks
    large = sets.where("big")
    heads = large.join(ties.where("fp = tie").select("fp"), "fp")
    again = heads.groupBy("block").agg(F.count(F.lit(1)).alias("heads"))
    few = heads.join(again.where(F.col("heads") <= CHUNK).select("block"), "block")
    ties = written(spark, ties.unionByName(_joined(few, ["block"])), "jaccard-ties")
    roots = written(spark, components(ties, "fp", "tie"), "jaccard-roots")
    now = large.drop("seen").join(roots.select(F.col("node").alias("fp"), F.col("root").alias("seen")), "fp", "left")
    now = now.withColumn("seen", F.coalesce("seen", "fp"))
    # then, where components remain apart, the classes outside a block's largest component against all of the block: a link
    # between two components has one of them at an end
    parts = now.groupBy("block", "seen").agg(F.count(F.lit(1)).alias("n")).groupBy("block").agg(
        F.max_by("seen", F.struct("n", "seen")).alias("largest"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    open_ = now.join(parts, "block").withColumn("lots", F.ceil(F.col("rest") / F.lit(CHUNK)).cast("int"))
    every = open_.withColumns({"x": F.col("chunk"), "y": F.explode(F.expr("sequence(0, lots - 1)"))})
    outside = open_.where("seen <> largest").withColumn("y", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("lots")).cast("int"))
    pairs = every.unionByName(outside.withColumn("x", F.explode(F.expr("sequence(0, chunks - 1)"))))
    ties = written(spark, ties.unionByName(_joined(pairs, ["block", "x", "y"])), "jaccard-ties")
    return components(ties, "fp", "tie")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    both = written(spark, signatures(df, id_col, text_col, k), "jaccard-signatures")
    sig, reported = both.where("NOT hot").drop("hot"), both.where("hot")
    roots = classes_with_links(docs, sig, reported, k)
    cls = sig.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    if roots is not None:
        cls = cls.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        comp = cls.groupBy("root").agg(F.min("least").alias("component_id"))
        cls = cls.join(comp, "root").select("fp", "component_id")
    else:
        cls = cls.select("fp", F.col("least").alias("component_id"))
    out = sig.join(cls, "fp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document's number of shingles and its component of Jaccard links of 0.8 or more."""
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))
