"""Suffix-array deduplication: removes every byte covered by a ``length``-byte string that also starts anywhere else.

The suffix order with common-prefix lengths is made shard by shard by external induced sorting (``induced.py``); shards
are cut so that strings that could be equal are in one shard:

1. Every ``length``-byte window has an anchor: its ``GRAM``-byte piece with the least hash (the leftmost of equal ones).
   Equal windows have equal anchors. Neighbouring windows with the same anchor are one piece of text, about 285 bytes for
   every 85; only (anchor hash, hash of the piece) pairs are shuffled. Equal texts, then equal pieces, of a
   batch are reduced to one before.
2. An anchor that occurs once has no repeated window. A piece that occurs twice, byte for byte, is a repeat as a whole.
   Anchors with different pieces are open: their distinct pieces are fetched, dealt by anchor to shards, and sorted.
   A window is repeated if the common prefix with either neighbour in the suffix order is ``length`` or more.
3. Repeated windows become spans per text; their union is removed.

The sorter's queues go to disk beyond ``SORT_MEMORY``; a shard's text and ranks take about 20 bytes a byte of memory, so
shards are kept small. An anchor with very many different pieces is one shard, whatever its size.

Null texts are empty; texts shorter than ``length`` bytes lose nothing. Repeated rows and equal texts are repeats of each
other, each judged as a row of its own; matches within one text count, overlapping or not. Strings are judged on the input.
Null ids and other columns don't matter. An empty table gives an empty result. Texts and pieces are told apart by
64-bit hashes (pieces by that and their anchor's).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, ragged, span_hashes, table, text_blocks, tidied, with_fields, written
from .induced import InducedSorter

LENGTH = 200
GRAM = 32
BLOCK = 1 << 20
#: Packed bytes per range of anchors, and piece bytes per shard, that are aimed at.
RANGE_BYTES = 12 << 20
SHARD_BYTES = 2 << 20
SORT_MEMORY = 96 << 20
#: Entries of a batch that are compared with each other before they are sent.
HELD = 100_000
#: Ends a piece in a shard's text; no UTF-8 byte.
SEPARATOR = 0xFF


def pieces(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, first window, windows, anchor) of the pieces of a block of texts; places are within the block."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none
    at = np.arange(n - gram + 1)
    key = span_hashes(data, at, at + gram)
    key >>= np.uint64(36)
    key <<= np.uint64(36)
    key |= at.astype(np.uint64)
    del at
    w = length - gram + 1
    grid = np.full(-(-len(key) // w) * w, 2 ** 64 - 1, np.uint64)
    grid[:len(key)] = key
    del key
    grid = grid.reshape(-1, w)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    ahead = np.minimum.accumulate(grid, axis=1, out=grid).ravel()
    count = n - length + 1
    anchor = np.minimum(behind[:count], ahead[w - 1:w - 1 + count])
    del behind, ahead, grid
    anchor &= np.uint64((1 << 36) - 1)
    anchor = anchor.view(np.int64)
    inside = np.zeros(n + 1, np.int32)  # windows that stay in one text
    sizes = np.diff(offs)
    own = np.flatnonzero(sizes >= length)
    inside[offs[own]] += 1
    inside[offs[own] + sizes[own] - length + 1] -= 1
    inside = np.cumsum(inside)[:count] > 0
    head = inside.copy()
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    head[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1] | edge[1:count]
    first = np.flatnonzero(head)
    stop = inside.copy()
    stop[:-1] &= head[1:] | ~inside[1:]
    last = np.flatnonzero(stop)
    return np.searchsorted(offs, first, side="right") - 1, first, last - first + 1, anchor[first]


def _parts(data: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place, bytes, offsets) of a block as it is, or of a long text in parts that share length - 1 bytes: each window is in one part."""
    if len(offs) != 2 or len(data) <= 2 * BLOCK:
        yield 0, data, offs
        return
    for a in range(0, max(1, len(data) - length + 1), BLOCK):
        part = data[a:a + BLOCK + length - 1]
        yield a, part, np.array([0, len(part)])


def _gone(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs that intervals cover."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    head = np.ones(len(starts), bool)
    head[1:] = starts[1:] > reach[:-1]
    at = np.flatnonzero(head)
    return starts[at], reach[np.append(at[1:] - 1, len(starts) - 1)]


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    """Rows with the hash that stands for their text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(t.alias("text"), F.xxhash64(t, F.xxhash64(F.lit(17), t)).alias("th"))


_ENTRIES = "part int, key binary, piece binary, th binary, first binary, windows binary"
_KINDS = {"key": "<u8", "piece": "<u8", "th": "<i8", "first": "<i8", "windows": "<i4"}


def _differs(*cols: np.ndarray) -> np.ndarray:
    """Whether each entry of sorted columns differs from the one before."""
    out = np.ones(len(cols[0]), bool)
    out[1:] = False
    for c in cols:
        out[1:] |= c[1:] != c[:-1]
    return out


def _entries(texts: DataFrame, ranges: int, length: int) -> DataFrame:
    """Pieces of the distinct texts of an Arrow batch, packed by range of their anchor's hash.

    A piece that several texts (or places) of a batch have is told to be repeated at once (ranges from ``ranges`` on pass
    these through) and goes on as one entry with a negative window count, so that a passage of very many texts is
    an entry per batch, not per text.
    """

    def packed(key, piece, th, first, windows, offset: int) -> pa.RecordBatch:
        part = ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64) + offset
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) > 0, [True]]))
        cols = {c: x[order].astype(_KINDS[c]) for c, x in zip(_KINDS, (key, piece, th, first, windows))}
        pairs = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        return pa.RecordBatch.from_arrays(
            [pa.array(part[order][cuts[:-1]].astype(np.int32)),
             *(pa.array([x[a:b].tobytes() for a, b in pairs], pa.binary()) for x in cols.values())], names=["part", *_KINDS])

    def sent(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        key, piece, th, first, windows = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((first, th, piece, key))
        key, piece, th, first, windows = (x[order] for x in (key, piece, th, first, windows))
        new = _differs(key, piece, th, first)
        key, piece, th, first, windows = (x[new] for x in (key, piece, th, first, windows))
        head = _differs(key, piece)
        twins = (np.bincount(np.cumsum(head) - 1) > 1)[np.cumsum(head) - 1]
        signed = np.where(twins, -windows, windows)
        yield packed(key[head], piece[head], th[head], first[head], signed[head], 0)
        rest = ~head
        if rest.any():
            # told by their text's hash: nothing more is to be compared
            yield packed(mix64(th[rest].astype(np.uint64)), piece[rest], th[rest], first[rest], signed[rest], ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            names = batch.schema.names
            th = np.asarray(batch.column(names.index("th")))
            for lo, hi, data, offs in text_blocks(batch, "text", BLOCK):
                for base, data, offs in _parts(data, offs, length):
                    row, first, windows, anchor = pieces(data, offs, length)
                    own = np.zeros(hi - lo, bool)
                    own[np.unique(th[lo:hi], return_index=True)[1]] = True
                    keep = own[row] if len(row) else np.zeros(0, bool)
                    row, first, windows, anchor = (x[keep] for x in (row, first, windows, anchor))
                    if not len(row):
                        continue
                    key = mix64(span_hashes(data, anchor, anchor + GRAM))  # anchors have small hashes: mixed again, ranges are even
                    piece = mix64(span_hashes(data, first, first + windows + length - 1) + mix64((anchor - first).astype(np.uint64)))
                    held.append((key, piece, th[lo:hi][row], first - offs[row] + base, windows))
                    if sum(len(x[0]) for x in held) > HELD:
                        yield from sent(held)
                        held = []
        if held:
            yield from sent(held)

    return texts.mapInArrow(tidied(run), _ENTRIES)


def _found(entries: DataFrame, ranges: int, shards: int, length: int) -> DataFrame:
    """(th, first, end, shard, repeated): pieces that have twins, and one of each kind of open piece with its shard (else -1)."""

    def run(t: pa.Table) -> pa.Table:
        key, piece, th, first, windows = (np.concatenate([np.zeros(0, d), *(np.frombuffer(x, d) for x in t[c].to_pylist())]) for c, d in _KINDS.items())
        if t["part"][0].as_py() >= ranges:
            n = len(th)
            return pa.table({"th": th, "first": first, "end": first - windows + length - 1, "shard": np.full(n, -1, np.int32), "repeated": np.ones(n, bool)})
        order = np.lexsort((first, th, piece, key))
        key, piece, th, first, windows = (x[order] for x in (key, piece, th, first, windows))
        twins = windows < 0
        windows = np.abs(windows)
        new = _differs(key, piece, th, first)  # one text met by several tasks
        twins = np.logical_or.reduceat(twins, np.flatnonzero(new)) if len(new) else twins
        key, piece, th, first, windows = (x[new] for x in (key, piece, th, first, windows))
        by_key, by_piece = _differs(key), _differs(key, piece)
        kind = np.cumsum(by_piece) - 1
        copies = np.bincount(kind, weights=1 + twins)
        anchor = np.cumsum(by_key) - 1
        kinds_of = np.bincount(anchor[by_piece])
        repeated = copies[kind] > 1
        open_ = kinds_of[anchor] > 1
        keep = repeated | open_
        shard = np.full(len(key), -1, np.int64)
        send = open_ & by_piece  # one of each kind is sorted
        shard[send] = (key[send] & np.uint64((1 << 32) - 1)).astype(np.int64) % shards
        out = [th[keep], first[keep], (first + windows + length - 1)[keep], shard[keep].astype(np.int32), repeated[keep]]
        return pa.table(dict(zip(["th", "first", "end", "shard", "repeated"], map(pa.array, out))))

    return entries.groupBy("part").applyInArrow(run, "th long, first long, end long, shard int, repeated boolean")


def _piece_texts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(shard, th, first, bytes) of the pieces to be sorted, cut out of one row of each text."""
    asked = found.where("shard >= 0").groupBy("th").agg(F.collect_list(F.struct("shard", "first", "end")).alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            th, asked = (batch.column(names.index(c)) for c in ("th", "asked"))
            seen: set[int] = set()
            for lo, hi, data, offs in text_blocks(batch, "text", BLOCK):
                out: list[list] = [[], [], [], []]
                for r in range(lo, hi):
                    t = th[r].as_py()
                    if t in seen:
                        continue
                    seen.add(t)
                    base = int(offs[r - lo])
                    for a in asked[r].as_py():
                        out[0].append(a["shard"])
                        out[1].append(t)
                        out[2].append(a["first"])
                        out[3].append(data[base + a["first"]:base + a["end"]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()),
                                                  pa.array(out[3], pa.binary())], names=["shard", "th", "first", "bytes"])

    return texts.join(asked, "th").mapInArrow(tidied(run), "shard int, th long, first long, bytes binary")


def _sorted_spans(asked: DataFrame, shards: int, length: int) -> DataFrame:
    """(th, first, end) of the repeated windows of every shard's pieces."""

    def spans(th: list, first: list, raw: list) -> pa.RecordBatch:
        th, first = np.concatenate(th), np.concatenate(first)
        size = np.concatenate([np.diff(o) for o, _ in raw])
        # a text met in several tasks gives its pieces several times: one of each is laid out
        _, own = np.unique(np.stack([th, first], 1), axis=0, return_index=True)
        start = np.cumsum(size) - size
        data = np.concatenate([b for _, b in raw])
        lay = size[own] + 1
        text = np.full(int(lay.sum()), SEPARATOR, np.uint8)
        place = np.cumsum(lay) - lay
        text[ragged(place, size[own])] = data[ragged(start[own], size[own])]
        hit = InducedSorter(text, length, SORT_MEMORY).repeats()
        # only windows within a piece count
        limit = np.repeat(place + size[own] - length, lay)
        hit &= np.arange(len(text)) <= limit
        head, stop = hit.copy(), hit.copy()
        head[1:] &= ~hit[:-1]
        stop[:-1] &= ~hit[1:]
        a, b = np.flatnonzero(head), np.flatnonzero(stop)
        i = np.searchsorted(place, a, side="right") - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(th[own][i]), pa.array(first[own][i] + a - place[i]), pa.array(first[own][i] + b - place[i] + length)],
            names=["th", "first", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, th, first, raw = None, [], [], []
        for batch in batches:
            shard = np.asarray(batch.column(0))
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(shard) != 0, [True]])) if len(shard) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if shard[a] != now and th:
                    yield spans(th, first, raw)
                    th, first, raw = [], [], []
                now = shard[a]
                th.append(np.asarray(batch.column(1))[a:b])
                first.append(np.asarray(batch.column(2))[a:b])
                col = batch.column(3).slice(a, b - a)
                offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
                raw.append((offs - offs[0], np.frombuffer(col.buffers()[2], np.uint8)[offs[0]:offs[-1]].copy()))
        if th:
            yield spans(th, first, raw)

    dealt = asked.repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(tidied(run), "th long, first long, end long")


def repeated_spans(df: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(th, spans, whole): by text hash its repeated spans (first, end), and whether the text occurs twice."""
    spark = df.sparkSession
    texts = _texts(df, text_col)
    sizes = texts.select("th", F.octet_length("text").alias("size")).groupBy("th").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    sizes = written(spark, sizes, "dedup-texts")
    total = sizes.agg(F.sum("size").alias("n")).first().n or 0
    ranges = max(8, int(total / 85 * 36 / RANGE_BYTES) + 1)
    shards = max(8, int(total / 4 / SHARD_BYTES) + 1)
    found = written(spark, _found(_entries(texts, ranges, length), ranges, shards, length), "dedup-found")
    asked = _piece_texts(texts, found)
    sorted_ = written(spark, _sorted_spans(asked, shards, length), "dedup-sorted")
    spans = found.where("repeated").select("th", "first", "end").unionByName(sorted_)
    spans = spans.groupBy("th").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    whole = sizes.where((F.col("copies") > 1) & (F.col("size") >= length)).select("th", F.lit(True).alias("whole"))
    return spans.join(whole, "th", "full").select("th", "spans", F.coalesce("whole", F.lit(False)).alias("whole"))


def without_repeats(df: DataFrame, text_col: str = "text", length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """All columns of ``df`` with (kept binary, n_bytes, n_removed, n_spans): its bytes without the repeated ones.

    as_text: kept as a string instead, without the characters that a cut has gone through. The columns must not be named
    ``th``, ``whole`` or like the new ones.
    """
    found = repeated_spans(df, text_col, length)
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.withColumn("th", F.xxhash64(t, F.xxhash64(F.lit(17), t))).join(found, "th", "left").drop("th")
    cols = [c for c in rows.columns if c not in ("spans", "whole")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            spans, whole = (batch.column(names.index(c)) for c in ("spans", "whole"))
            for lo, hi, data, offs in text_blocks(batch, text_col):
                kept, n_bytes, n_removed, n_spans = [], [], [], []
                for r in range(lo, hi):
                    own = data[offs[r - lo]:offs[r - lo + 1]]
                    n = len(own)
                    if whole[r].as_py() and n >= length:
                        keep, runs = own[:0], 1
                    elif spans[r].is_valid:
                        first, end = _gone(np.asarray(spans[r].values.field(0)), np.asarray(spans[r].values.field(1)))
                        keep = np.concatenate([own[a:b] for a, b in zip([0, *end.tolist()], [*first.tolist(), n])])
                        runs = len(first)
                    else:
                        keep, runs = own, 0
                    kept.append(keep.tobytes().decode("utf-8", "ignore") if as_text else keep.tobytes())
                    n_bytes.append(n)
                    n_removed.append(n - len(keep))
                    n_spans.append(runs)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(names.index(c)).slice(lo, hi - lo) for c in cols), pa.array(kept, pa.string() if as_text else pa.binary()),
                     pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64())],
                    names=[*cols, "kept", "n_bytes", "n_removed", "n_spans"])

    kind = "string" if as_text else "binary"
    return rows.mapInArrow(tidied(run), with_fields(rows, f"kept {kind}, n_bytes long, n_removed long, n_spans long", "spans", "whole"))


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that start anywhere else too, as a digest."""
    out = without_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
