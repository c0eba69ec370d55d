"""Exact hybrid nearest-neighbour join over two vector spaces, tiled for Spark.

Shape of the plan
-----------------
1. The corpus is packed into tiles where it is scanned (``pack_corpus``, no exchange), or read as tiles
   packed before; the questions are cut into tiles by a hash of their id (``xxhash64``). A tile has a
   bounded number of rows whatever the key distribution and is one row (ids + float32 matrices as binary).
2. Tile pairs are formed by an equi-join on the tile keys. When one packed side is below
   ``broadcast_bytes`` (checked from count x fixed row width, not assumed), that side is
   broadcast and the other is streamed without moving again. Otherwise both sides are
   replicated on the (question tile, corpus tile) key and shuffle-joined, so every pair
   meets in exactly one task and no key holds more than one pair.
3. ``mapInArrow`` scores each pair with one float32 matrix product per chunk and keeps, in
   one pass, what reaches the question's n-th best so far (less a slack for what float32
   rounds, so that no true member is dropped). Only the rows kept are recomputed in the exact
   left-to-right DOUBLE order of :func:`shoprank.functions.vector.cosine`, cut to the
   local top-n by text and by image, and emitted.

Correctness of the merge: every global top-n row is inside its own tile's top-n, so the
global ``row_number`` in :mod:`shoprank.operators.rank` over the emitted rows is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, update_wrapper

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

# Rows emitted by the tile stage.
CANDIDATE_SCHEMA = (
    "group_key string, query_id bigint, product_id bigint, text_sim double, image_sim double, "
    "n_text int, n_image int, k int, alpha double"
)
_TILE_SCHEMA = (
    "group_key string, tile int, ids array<bigint>, ns array<int>, ns_i array<int>, "
    "ks array<int>, alphas array<double>, dim_t int, dim_i int, mat_t binary, mat_i binary"
)

# |BLAS cosine - sequential cosine| is ~1e-15; a 1e-9 slack keeps every true top-n row.
_SLACK = 1e-9
# Questions and corpus rows of one matrix product: its float32 cells stay in a core's cache.
_BLOCK, _STEP = 256, 2048
# Cells that are held at once for the exact step of a block of questions.
_HELD_CELLS = 1_000_000
# Pairs whose exact similarity is computed at once.
_EXACT_PAIRS = 1 << 16
# Decoded question tiles that a worker may hold (bytes).
_DECODED_BYTES = 128 << 20
# Merged candidate rows a worker may hold before it emits them. Emitting early is exact:
# every (question, product) pair is scored in exactly one tile pair, so rows of
# different flushes never collide and the global ranking after the exchange sees all.
_EMIT_ROWS = 8_000_000


@dataclass(frozen=True)
class TileConfig:
    """Tile sizes. ``corpus_tile_bytes`` bounds one packed corpus tile; query tiles hold at
    most ``query_tile_rows`` questions; the question side is broadcast only when its packed
    size is at most ``broadcast_bytes``."""

    corpus_tile_bytes: int = 32 << 20
    query_tile_rows: int = 4096
    broadcast_bytes: int = 64 << 20
    min_corpus_tiles: int = 1
    # Sizing hints for the replicate pairing: expected candidate rows a scoring partition
    # emits per question (2n, their mean; 400 for the common k=10, multiplier=20) and their width, and
    # the largest packed question tile a task may hold.
    pool_hint: int = 400
    candidate_row_bytes: int = 48
    max_query_tile_bytes: int = 256 << 20
    # Corpus tiles from which candidates are merged in two levels.
    merge_above: int = 64


def _pack_tile(table: pa.Table) -> pa.Table:
    """One group of rows -> one packed row (ids, per-row pool sizes, float32 matrices).

    A row without an image vector (text-only question) gets a zero row and pool size 0.
    """
    key = table.column("group_key")[0].as_py()
    tile = table.column("tile")[0].as_py()
    ids = table.column("id").to_numpy()
    ns = table.column("n").to_numpy(zero_copy_only=False).astype(np.int32)
    ns_i = table.column("n_i").to_numpy(zero_copy_only=False).astype(np.int32)
    ks = table.column("k").to_numpy(zero_copy_only=False).astype(np.int32)
    alphas = table.column("alpha").to_numpy(zero_copy_only=False).astype(np.float64)

    def mat(name: str) -> tuple[int, bytes, np.ndarray]:
        col = table.column(name).combine_chunks()
        valid = ~np.asarray(col.is_null().to_numpy(zero_copy_only=False), dtype=bool)
        if not valid.any():
            return 0, b"", valid
        sizes = col.value_lengths().to_numpy(zero_copy_only=False)[valid]
        dim = int(sizes[0])
        if not (sizes == dim).all():
            raise ValueError(f"column {name}: vectors of different length in one space")
        flat = col.flatten().to_numpy(zero_copy_only=False).astype("<f4", copy=False)
        out = np.zeros((len(col), dim), dtype="<f4")
        out[valid] = flat.reshape(-1, dim)
        return dim, out.tobytes(), valid

    dt, mt, vt_ok = mat("vt")
    di, mi, vi_ok = mat("vi")
    ns = np.where(vt_ok, ns, 0).astype(np.int32)
    ns_i = np.where(vi_ok, ns_i, 0).astype(np.int32)
    return pa.Table.from_pydict(
        {
            "group_key": [key], "tile": [tile], "ids": [ids.tolist()], "ns": [ns.tolist()],
            "ns_i": [ns_i.tolist()], "ks": [ks.tolist()], "alphas": [alphas.tolist()],
            "dim_t": [dt], "dim_i": [di], "mat_t": [mt], "mat_i": [mi],
        },
        schema=pa.schema([
            ("group_key", pa.string()), ("tile", pa.int32()), ("ids", pa.list_(pa.int64())),
            ("ns", pa.list_(pa.int32())), ("ns_i", pa.list_(pa.int32())),
            ("ks", pa.list_(pa.int32())), ("alphas", pa.list_(pa.float64())), ("dim_t", pa.int32()),
            ("dim_i", pa.int32()), ("mat_t", pa.binary()), ("mat_i", pa.binary()),
        ]),
    )


def _seq_sum(p: np.ndarray) -> np.ndarray:
    """Left-to-right row sums starting at 0.0 (same rounding as a SQL ``aggregate``)."""
    s = np.zeros(p.shape[0], dtype=np.float64)
    for j in range(p.shape[1]):
        s += p[:, j]
    return s


def _exact_cos(q: np.ndarray, c: np.ndarray, qn: np.ndarray, cn: np.ndarray) -> np.ndarray:
    """Row-wise cosine of paired rows in sequential DOUBLE order; zero norm -> 0."""
    d = _seq_sum(q * c)
    den = qn * cn
    out = np.zeros_like(d)
    ok = den != 0
    out[ok] = d[ok] / den[ok]
    return out


def _top_candidates(sims: np.ndarray, n_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, col) pairs whose approximate score is within the slack of the row's n-th best.

    Rows with n = 0 yield nothing.
    """
    nq, nc = sims.shape
    n_cap = int(min(max(int(n_rows.max()), 1), nc))
    if n_cap >= nc:
        thr = sims.min(axis=1)
    else:
        part = np.partition(sims, nc - n_cap, axis=1)[:, nc - n_cap:]
        # n-th best for each row's own n (n <= n_cap): sort the kept block descending.
        part = -np.sort(-part, axis=1)
        idx = np.minimum(np.maximum(n_rows, 1), n_cap) - 1
        thr = part[np.arange(nq), idx]
    thr = np.where(n_rows > 0, thr - _SLACK, np.inf)
    rows, cols = np.nonzero(sims >= thr[:, None])
    return rows, cols


def _by_row(rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts ``rows`` (stable), and each entry's row and place within its row in that order."""
    order = np.argsort(rows.astype(np.uint16) if n_rows <= 1 << 16 else rows, kind="stable")
    r = rows[order]
    count = np.bincount(r, minlength=n_rows)
    return order, r, np.arange(r.size) - np.repeat(np.cumsum(count) - count, count)


def _nth_best(rows: np.ndarray, score: np.ndarray, n_rows: np.ndarray) -> np.ndarray:
    """The n-th greatest score of every row, n being its entry of ``n_rows``; -inf where a row has fewer or n is 0.

    Rows are laid side by side in a matrix, a bounded number of cells at a time.
    """
    out = np.full(len(n_rows), -np.inf, score.dtype)
    count = np.bincount(rows, minlength=len(n_rows))
    enough = (count >= n_rows) & (n_rows > 0)
    full = np.flatnonzero(enough)
    if not full.size:
        return out
    if full.size < len(n_rows):
        mine = enough[rows]
        rows, score = (np.cumsum(enough) - 1)[rows[mine]], score[mine]
    count, least = count[full], n_rows[full]
    order, r, place = _by_row(rows, full.size)
    score, ends, at = score[order], np.cumsum(count), 0
    while at < full.size:
        width = np.maximum.accumulate(count[at:])
        to = at + max(1, int(np.searchsorted(width * np.arange(1, width.size + 1), _HELD_CELLS, side="right")))
        wide = int(count[at:to].max())
        a, b = ends[at] - count[at], ends[min(to, full.size) - 1]
        side = np.full((min(to, full.size) - at, wide), -np.inf, score.dtype)
        side.ravel()[(r[a:b] - at) * wide + place[a:b]] = score[a:b]
        side.sort(axis=1)
        out[full[at:to]] = side[np.arange(len(side)), wide - least[at:to]]
        at = to
    return out


def _rank_keep(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, n_rows: np.ndarray) -> np.ndarray:
    """Mask of pairs ranked < n within their row by (score desc, id asc)."""
    return _keep_and_last(rows, ids, score, n_rows)[0]


def _keep_and_last(rows: np.ndarray, ids: np.ndarray, score: np.ndarray, n_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_rank_keep` and :func:`_nth_best`."""
    n_rows = np.asarray(n_rows, np.int64)
    if rows.size == 0:
        return np.zeros(0, dtype=bool), np.full(len(n_rows), -np.inf)
    nth = _nth_best(rows, score, n_rows)
    last, wanted = nth[rows], n_rows[rows] > 0
    keep = wanted & ((score > last) | np.isneginf(last))
    # ties at the n-th score, or rows that score -inf: the least ids fill what is left
    tied = np.flatnonzero(wanted & (score == last))
    if tied.size:
        keep[tied] = False
        left = n_rows - np.bincount(rows[keep], minlength=len(n_rows))
        tied = tied[np.lexsort((ids[tied], rows[tied]))]
        _, r, place = _by_row(rows[tied], len(n_rows))
        keep[tied] = place < left[r]
    return keep, nth


def _seq_norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(_seq_sum(m * m)) if m.size else np.zeros(m.shape[0])


def _slack(dim: int) -> float:
    """What two float32 products of unit vectors may be off together, doubled."""
    return (dim + 16) * 2.0 ** -23


class _Matrix:
    """One space of a tile: float32 vectors by dimension, norms in sequential DOUBLE order, unit vectors."""

    def __init__(self, buf, rows: int, dim: int):
        raw = np.frombuffer(buf, dtype="<f4").reshape(rows, dim)
        self.dim, self.by_dim = dim, np.ascontiguousarray(raw.T)
        square = np.zeros(rows)
        for x in self.by_dim:
            x = x.astype(np.float64)
            square += x * x
        self.norm = np.sqrt(square)
        self.unit = np.empty((rows, dim), np.float32)
        for at in range(0, rows, _EXACT_PAIRS):
            n = self.norm[at:at + _EXACT_PAIRS, None]
            np.divide(raw[at:at + _EXACT_PAIRS], np.where(n != 0, n, 1.0), out=self.unit[at:at + _EXACT_PAIRS], casting="same_kind")

    def __len__(self) -> int:
        return len(self.norm)


def _matrix_of(tile: dict, space: str, rows: int) -> _Matrix | None:
    dim, buf = tile["dim_" + space].as_py(), tile["mat_" + space]
    return _Matrix(buf.as_buffer(), rows, dim) if dim and buf.is_valid else None


def _fused(alpha: np.ndarray, ts: np.ndarray, im: np.ndarray, n_image: np.ndarray) -> np.ndarray:
    """The score of :func:`shoprank.operators.rank.fuse`, in its order of operations."""
    return np.where(n_image == 0, ts, alpha * ts + (1.0 - alpha) * im)


def _cosines(q: _Matrix, c: _Matrix, r: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Exact cosine of pairs of rows, summed from left to right in DOUBLE; zero norm -> 0."""
    out = np.zeros(r.size)
    for at in range(0, r.size, _EXACT_PAIRS):
        i, j = r[at:at + _EXACT_PAIRS], col[at:at + _EXACT_PAIRS]
        d, p = np.zeros(i.size), np.empty(i.size)
        for x, y in zip(q.by_dim, c.by_dim):
            np.multiply(x.take(i), y.take(j), out=p, dtype=np.float64)
            d += p
        den = q.norm[i] * c.norm[j]
        np.divide(d, den, out=out[at:at + _EXACT_PAIRS], where=den != 0)
    return out


class _Joined:
    """Both spaces of a tile side by side, unit vectors times a weight per row and space: their product is the fused score. A space
    that the other side lacks is left out."""

    def __init__(self, t: _Matrix, i: _Matrix | None, weight_t: np.ndarray | None = None, weight_i: np.ndarray | None = None):
        parts = [(t, weight_t)] + ([(i, weight_i)] if i is not None else [])
        self.unit = np.concatenate([m.unit if w is None else m.unit * w[:, None].astype(np.float32) for m, w in parts], axis=1)
        # a row of two unit vectors has a norm of sqrt(2): what rounds counts as if there were twice the dimensions
        self.dim = 2 * self.unit.shape[1]

    def __len__(self) -> int:
        return len(self.unit)


def _hits(mask: np.ndarray) -> np.ndarray:
    """Places of a mask that are set, in order. Few are: eight cells are looked at as one first."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    eights = np.flatnonzero(flat.view(np.uint64) != 0)
    if eights.size > flat.size // 64:
        return np.flatnonzero(flat)
    cells = (8 * eights[:, None] + np.arange(8)).ravel()
    return cells[flat[cells]]


def _near(q: _Matrix | _Joined, c: _Matrix | _Joined | _Classes, a: int, b: int, n_rows: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """(row, column, product) of the pairs of the questions ``a`` to ``b`` with all of ``c`` that can be among a question's n best.

    One pass of matrix products. ``floor``: a lower bound of each question's n-th best, -inf if none is known. It rises when
    the rows seen have doubled, so that about n * log2(rows) pairs of a question are held. None: near ties of several questions are
    too many to hold.
    """
    unit, slack = q.unit[a:b], _slack(q.dim)
    bound = np.where(n_rows > 0, floor - slack, np.inf).astype(np.float32)
    held, size, cut_at, at = [], 0, 0, 0
    sims = np.empty((b - a) * min(_STEP, len(c)), np.float32)

    def cut() -> int:
        nonlocal held, bound
        r, j, s = (np.concatenate(x) for x in zip(*held))
        bound = np.maximum(bound, _nth_best(r, s, n_rows) - np.float32(slack))
        keep = s >= bound[r]
        held = [(r[keep], j[keep], s[keep])]
        return held[0][0].size

    while at < len(c):
        part = c.unit[at:at + _STEP]
        s = np.matmul(unit, part.T, out=sims[:(b - a) * len(part)].reshape(b - a, len(part)))
        if at == 0 and np.isneginf(bound).any() and 0 < n_rows.max() < len(part):
            # the n-th best of the first rows; where the own n is less, the n-th of the largest n is a lower bound too
            first = np.partition(s, len(part) - int(n_rows.max()), axis=1)[:, len(part) - int(n_rows.max())]
            bound = np.maximum(bound, first - np.float32(slack))
        hit = _hits(s >= bound[:, None])
        r = hit // len(part)
        held.append((r, hit - r * len(part) + at, s.ravel()[hit]))
        size += hit.size
        at += len(part)
        if at >= cut_at or size > _HELD_CELLS:
            size, cut_at = cut(), 2 * at
            if size > _HELD_CELLS and b - a > 1:
                return None
    cut()
    return held[0]


class _Classes:
    """Rows of a corpus tile whose vectors are equal score alike, so a question meets one of each class; the least ids stand first.

    ``rep``: a row of each class; ``unit``: its unit vector(s); ``rows``: all rows by class, then id; ``start``, ``count``: where in it.
    """

    def __init__(self, whole: _Matrix | _Joined, dim: int, rep: np.ndarray, number: np.ndarray, ids: np.ndarray):
        self.dim, self.rep, self.unit = dim, rep, whole.unit[rep]
        self.rows = np.lexsort((ids, number))
        self.count = np.bincount(number, minlength=len(rep))
        self.start = np.cumsum(self.count) - self.count

    def __len__(self) -> int:
        return len(self.rep)

    @staticmethod
    def of(whole: _Matrix | _Joined, parts: list[_Matrix], ids: np.ndarray) -> _Classes | None:
        """None if less than half of the rows are alike. ``parts``: what must be equal."""
        rng = np.random.default_rng(3)
        key = np.zeros(len(ids), np.uint64)
        for x in (x for m in parts for x in m.by_dim):
            key = (key + x.view(np.uint32)) * np.uint64(int(rng.integers(1 << 62)) * 2 + 1)
            key ^= key >> np.uint64(29)
        _, rep, number = np.unique(key, return_index=True, return_inverse=True)
        if 2 * len(rep) > len(ids) or any((x[rep][number] != x).any() for m in parts for x in m.by_dim):
            return None
        return _Classes(whole, whole.dim, rep, number, ids)

    def spread(self, r: np.ndarray, cls: np.ndarray, score: np.ndarray, n_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(question row, corpus row) of classes by score until a question has its n, those that tie with the last one too; of each
        class the least ids. None: too many to hold for several questions."""
        order = np.lexsort((-score, r))
        r, cls, score = r[order], cls[order], score[order]
        count = np.minimum(self.count[cls], n_rows[r])
        # rows of the same question in classes of greater score
        new_r = np.diff(r, prepend=-1) != 0
        new = new_r | (np.diff(score, prepend=np.inf) != 0)
        total = np.cumsum(count) - count
        before = (total[new] - total[new_r][np.cumsum(new_r)[new] - 1])[np.cumsum(new) - 1]
        keep = before < n_rows[r]
        r, cls, count = r[keep], cls[keep], np.minimum(count, n_rows[r] - before)[keep]
        if count.sum() > _HELD_CELLS and len(n_rows) > 1:
            return None
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(r, count), self.rows[np.repeat(self.start[cls], count) + place]


class _Search:
    """One question tile and what has been found for it in this partition: per question, rows that are in its top-n by text or
    by image (``fused``: by fused score) among all corpus tiles met (exact, since a global top-n row is a top-n row of any subset
    containing it)."""

    def __init__(self, key: str, tile: dict, fused: bool = False):
        self.key, self.ids, self.fused = key, _ints(tile["ids"]), fused
        self.ns, self.ns_i, self.ks = (_ints(tile[f]) for f in ("ns", "ns_i", "ks"))
        self.alphas = np.asarray(tile["alphas"].values.to_numpy(zero_copy_only=False), dtype=np.float64)
        self.t, self.i = (_matrix_of(tile, space, len(self.ids)) for space in "ti")
        # a lower bound of each question's n-th best by every score that counts; it holds on when rows are handed out
        self.floors = [np.full(len(self.ids), -np.inf) for _ in ([0] if fused else [0, 1])]
        # per block of questions: question row, product, text and image similarity of what has been found, and what corpus tiles
        # have added since, not yet cut to the best of both
        self.found: dict[int, tuple[np.ndarray, ...]] = {}
        self.fresh: dict[int, list[tuple[np.ndarray, ...]]] = {}
        self.rows = 0
        self.step = max(1, min(_BLOCK, _HELD_CELLS // (4 * int(max(self.ns.max(initial=0), self.ns_i.max(initial=0), 1)))))

    @property
    def size(self) -> int:
        return 8 * len(self.ids) * sum(m.dim for m in (self.t, self.i) if m is not None)

    def meet(self, tile: dict) -> None:
        c_ids = _ints(tile["ids"])
        ct, ci = (_matrix_of(tile, space, len(c_ids)) for space in "ti")
        if self.t is None or ct is None or not len(c_ids):
            return
        if self.t.dim != ct.dim or (self.i is not None and ci is not None and self.i.dim != ci.dim):
            raise ValueError("question and corpus vectors differ in dimension")
        two = self.i is not None and ci is not None
        if self.fused:
            weights = np.where(self.ns_i > 0, self.alphas, 1.0), np.where(self.ns_i > 0, 1.0 - self.alphas, 0.0)
            both = _Joined(ct, ci if two else None)
            spaces = [(_Joined(self.t, self.i if two else None, *weights), _Classes.of(both, [ct, ci] if two else [ct], c_ids) or both)]
        else:
            spaces = [(q, _Classes.of(c, [c], c_ids) or c) for q, c in [(self.t, ct), (self.i, ci)][:1 + two]]
        for a in range(0, len(self.ids), self.step):
            self._block(a, min(len(self.ids), a + self.step), c_ids, ct, ci, spaces)

    def _similarities(self, r: np.ndarray, j: np.ndarray, ct: _Matrix, ci: _Matrix | None) -> tuple[np.ndarray, np.ndarray]:
        """Exact text and image similarity of pairs, NaN where the image space is not searched."""
        ts = _cosines(self.t, ct, r, j)
        if self.i is None or ci is None:
            return ts, np.full(r.size, np.nan)
        return ts, np.where(self.ns_i[r] > 0, _cosines(self.i, ci, r, j), np.nan)

    def _scores(self, r: np.ndarray, ts: np.ndarray, im: np.ndarray) -> list[np.ndarray]:
        """What rows (of the questions ``r``) are ranked by, one score for each of ``floors``."""
        if self.fused:
            both = _fused(self.alphas[r], ts, im, self.ns_i[r])
            return [np.where(np.isnan(both), -np.inf, both)]
        return [ts, np.where(np.isnan(im), -np.inf, im)]

    def _block(self, a: int, b: int, c_ids: np.ndarray, ct: _Matrix, ci: _Matrix | None, spaces: list) -> None:
        """What a corpus tile adds to a block of questions. It is merged when it has come to half of what is held, so that what is
        held is sorted a few times, not once a tile."""
        new = self._best(a, b, c_ids, ct, ci, spaces)
        if not new:
            return
        fresh = self.fresh.setdefault(a, [])
        fresh += new
        self.rows += sum(x[0].size for x in new)
        if a not in self.found or 2 * sum(x[0].size for x in fresh) >= self.found[a][0].size:
            self._merge(a)

    def _merge(self, a: int) -> None:
        """The best of what is held for a block of questions and what has been added."""
        b, old = min(len(self.ids), a + self.step), self.found.get(a)
        both = tuple(np.concatenate(x) for x in zip(*([] if old is None else [old]), *self.fresh.pop(a)))
        self.rows -= both[0].size
        if old is not None:
            r, ids, ts, im = both
            keep = self._cut(a, b, r - a, ids, self._scores(r, ts, im))
            both = r[keep], ids[keep], ts[keep], im[keep]
        self.rows += both[0].size
        self.found[a] = both

    def _cut(self, a: int, b: int, r: np.ndarray, ids: np.ndarray, scores: list[np.ndarray]) -> np.ndarray:
        """Mask of the rows that are in a top n of the questions ``a`` to ``b``, whose floors rise to the n-th of these rows."""
        keep = np.zeros(r.size, bool)
        for floor, score, n in zip(self.floors, scores, (self.ns[a:b], self.ns_i[a:b])):
            mine, last = _keep_and_last(r, ids, score, n)
            keep |= mine
            floor[a:b] = np.maximum(floor[a:b], last)
        return keep

    def _best(self, a: int, b: int, c_ids: np.ndarray, ct: _Matrix, ci: _Matrix | None, spaces: list) -> list[tuple[np.ndarray, ...]]:
        """Top rows of the questions ``a`` to ``b`` in one corpus tile, in pieces."""
        sizes = self.ns[a:b], self.ns_i[a:b]
        near = [_near(q, c, a, b, n, f[a:b]) for (q, c), n, f in zip(spaces, sizes, self.floors) if n.any()]
        if any(x is None for x in near):
            mid = (a + b) // 2
            return self._best(a, mid, c_ids, ct, ci, spaces) + self._best(mid, b, c_ids, ct, ci, spaces)
        pairs = []
        for (r, j, _), at in zip(near, [at for at in range(len(spaces)) if sizes[at].any()]):
            c = spaces[at][1]
            if isinstance(c, _Classes):
                score = self._scores(a + r, *self._similarities(a + r, c.rep[j], ct, ci))[at]
                met = c.spread(r, j, score, sizes[at])
                if met is None:
                    mid = (a + b) // 2
                    return self._best(a, mid, c_ids, ct, ci, spaces) + self._best(mid, b, c_ids, ct, ci, spaces)
                r, j = met
            pairs.append(r * len(c_ids) + j)
        if self.fused and ci is None:
            # questions that rank by both spaces have no score here: the least ids fill what is left
            least = np.argsort(c_ids, kind="stable")[:int(sizes[0].max(initial=0))]
            pairs.append((np.flatnonzero(sizes[1] > 0)[:, None] * len(c_ids) + least).ravel())
        if not pairs:
            return []
        key = np.sort(np.concatenate(pairs))
        r, j = np.divmod(key[np.diff(key, prepend=-1) != 0], len(c_ids))
        ids = c_ids[j]
        ts, im = self._similarities(a + r, j, ct, ci)
        keep = self._cut(a, b, r, ids, self._scores(a + r, ts, im)[:len(spaces)])
        return [((a + r[keep]).astype(np.int32), ids[keep], ts[keep], im[keep])]

    def drain(self) -> Iterator[pa.RecordBatch]:
        """What has been found, in batches of bounded size; it is held no longer."""
        for a in list(self.fresh):
            self._merge(a)
        found, self.found, self.rows = self.found, {}, 0
        for r, ids, ts, im in found.values():
            for at in range(0, r.size, _EXACT_PAIRS):
                q, t, i = (x[at:at + _EXACT_PAIRS] for x in (r, ts, im))
                yield _batch(pa.repeat(pa.scalar(self.key, pa.string()), q.size), self.ids[q], ids[at:at + _EXACT_PAIRS], t, i,
                             self.ns[q], self.ns_i[q], self.ks[q], self.alphas[q])


def _batch(key: pa.Array, qid, pid, ts, im, nt, ni, k, alpha) -> pa.RecordBatch:
    """Rows of CANDIDATE_SCHEMA."""
    small = [pa.array(x.astype(np.int32), type=pa.int32()) for x in (nt, ni, k)]
    return pa.RecordBatch.from_arrays(
        [key, pa.array(qid, type=pa.int64()), pa.array(pid, type=pa.int64()), pa.array(ts, type=pa.float64()),
         pa.array(im, type=pa.float64(), mask=np.isnan(im)), *small, pa.array(alpha, type=pa.float64(), mask=np.isnan(alpha))],
        names=["group_key", "query_id", "product_id", "text_sim", "image_sim", "n_text", "n_image", "k", "alpha"])


def _ints(cell) -> np.ndarray:
    return np.asarray(cell.values.to_numpy(zero_copy_only=False), dtype=np.int64)


_TILE_FIELDS = ("ids", "ns", "ns_i", "ks", "alphas", "dim_t", "dim_i", "mat_t", "mat_i")


def _score_batches(batches, fused: bool = False):
    """Rows = joined pairs (``q_*`` and ``c_*`` tile columns), as in the broadcast modes: question tiles are held while they fit."""
    held: dict[tuple, _Search] = {}
    for rb in batches:
        cols = {name: rb.column(i) for i, name in enumerate(rb.schema.names)}
        for r in range(rb.num_rows):
            key = (cols["group_key"][r].as_py(), cols["q_tile"][r].as_py())
            if key not in held:
                if sum(x.size for x in held.values()) > _DECODED_BYTES:
                    for x in held.values():
                        yield from x.drain()
                    held.clear()
                held[key] = _Search(key[0], {f: cols["q_" + f][r] for f in _TILE_FIELDS}, fused)
            held[key].meet({f: cols["c_" + f][r] for f in _TILE_FIELDS})
            for other in [k for k in held if k != key] + [key]:
                if sum(x.rows for x in held.values()) < _EMIT_ROWS:
                    break
                yield from held[other].drain()
    for x in held.values():
        yield from x.drain()


def _score_cogrouped(batches, fused: bool = False):
    """Rows = replicated tiles sorted by (group_key, q_tile, side): a question tile (side 0)
    followed by the corpus tiles (side 1) it meets in this partition. Holds one question
    tile at a time."""
    held_key, held = None, None
    for rb in batches:
        cols = {name: rb.column(i) for i, name in enumerate(rb.schema.names)}
        for r in range(rb.num_rows):
            key = (cols["group_key"][r].as_py(), cols["q_tile"][r].as_py())
            tile = {f: cols[f][r] for f in _TILE_FIELDS}
            if cols["side"][r].as_py() == 0:
                if held is not None:
                    yield from held.drain()
                held_key, held = key, _Search(key[0], tile, fused)
                continue
            if held_key != key:
                continue          # corpus tile of a question tile that does not exist
            held.meet(tile)
            if held.rows >= _EMIT_ROWS:
                yield from held.drain()
    if held is not None:
        yield from held.drain()


def _tiles(df: DataFrame, id_col: str, n_tiles: int, n_parts: int) -> DataFrame:
    """Packed tiles; tile ``t`` is packed in partition ``t % n_parts``.

    ``repartitionById`` places rows by tile number directly: the exchange is user-sized, so
    AQE does not merge the (small in bytes, heavy in compute) tiles into a few tasks, and the
    grouped pack needs no second exchange.
    """
    def opt(c, t):
        return (F.col(c) if c in df.columns else F.lit(0)).cast(t).alias(c)

    tile = F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_tiles)).cast("int")
    packed_in = df.select(
        F.col("group_key"),
        tile.alias("tile"),
        F.col(id_col).alias("id"),
        opt("n", "int"), opt("n_i", "int"), opt("k", "int"),
        (F.col("alpha") if "alpha" in df.columns else F.lit(None)).cast("double").alias("alpha"),
        F.col("vt"),
        F.col("vi"),
    )
    # ``part`` is a grouping column, so the grouped pack is satisfied by this exchange.
    part = F.col("tile") if n_parts >= n_tiles else F.pmod(F.col("tile"), F.lit(n_parts))
    return (
        packed_in.withColumn("part", part.cast("int"))
        .repartitionById(n_parts, "part")
        .groupBy("group_key", "part", "tile")
        .applyInArrow(_pack_tile, _TILE_SCHEMA)
    )


def pack_corpus(corpus: DataFrame, cfg: TileConfig | None = None, dims: int = 64, most_rows: int | None = None) -> DataFrame:
    """Packed corpus tiles made where the rows are scanned: no exchange. The result can be written once as a table
    and given to :func:`hybrid_candidates` instead of the corpus, for later queries and micro-batches.

    corpus: ``group_key, product_id, tv, iv``; ``dims``: elements of both vectors together, to size a tile;
    ``most_rows``: rows of a tile at most, if less than the bytes allow.
    """
    cfg = cfg or TileConfig()
    most = max(1, cfg.corpus_tile_bytes // (24 + 4 * max(dims, 1)))
    most = min(most, most_rows) if most_rows else most
    rows = corpus.select("group_key", F.lit(0).alias("tile"), F.col("product_id").alias("id"), F.lit(0).alias("n"),
                         F.lit(0).alias("n_i"), F.lit(0).alias("k"), F.lit(None).cast("double").alias("alpha"),
                         F.col("tv").alias("vt"), F.col("iv").alias("vi"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() * 65_537, 0
        held: dict[str, list] = {}
        count: dict[str, int] = {}

        def tile(key: str) -> list[pa.RecordBatch]:
            nonlocal made
            t = pa.Table.from_batches(held.pop(key))
            count.pop(key)
            number = pa.array([(base + made) % (1 << 31)] * len(t), pa.int32())
            made += 1
            return _pack_tile(t.set_column(t.schema.get_field_index("tile"), "tile", number)).to_batches()

        for batch in batches:
            keys = batch.column(0)
            for key in pc.unique(keys).to_pylist():
                part = batch.filter(pc.equal(keys, key))
                for at in range(0, len(part), most):
                    piece = part.slice(at, most)
                    if count.get(key, 0) + len(piece) > most and key in held:
                        yield from tile(key)
                    held.setdefault(key, []).append(piece)
                    count[key] = count.get(key, 0) + len(piece)
        for key in list(held):
            yield from tile(key)

    return rows.mapInArrow(pack, _TILE_SCHEMA)


def _copied(tiles: DataFrame, copies: int, name: str) -> DataFrame:
    """Every tile ``copies`` times, numbered from 0 in ``name``. They are handed on one by one; ``explode`` holds all copies of a
    row in the JVM at once, which is gigabytes a task where tiles of megabytes go to many partitions."""
    if copies == 1:
        return tiles.withColumn(name, F.lit(0))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                for i in range(copies):
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array([i], pa.int32())], names=[*batch.schema.names, name])

    return tiles.mapInArrow(copy, StructType([*tiles.schema.fields, StructField(name, IntegerType())]))


def _merged(cands: DataFrame, partitions: int, fused: bool = False) -> DataFrame:
    """Second merge level: candidates of a question from many scoring partitions meet in about sqrt(partitions)
    buckets, each of which keeps its top rows, before the final windows see them."""
    buckets = max(2, math.isqrt(partitions))
    dealt = cands.withColumn("_bucket", F.pmod(F.spark_partition_id(), F.lit(buckets)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = cut_at = 0

        def cut() -> pa.Table:
            t = pa.Table.from_batches(held)
            key = t["group_key"].combine_chunks().dictionary_encode()
            q, number = np.unique(t["query_id"].to_numpy(), return_inverse=True)
            number = number * len(key.dictionary) + key.indices.to_numpy()
            ids = t["product_id"].to_numpy()
            keep = np.zeros(len(t), bool)
            scores = [(t["text_sim"], "n_text"), (t["image_sim"], "n_image")]
            if fused:
                both = _fused(*(t[c].to_numpy() for c in ("alpha", "text_sim", "image_sim", "n_image")))
                scores = [(pa.array(both, from_pandas=True), "n_text")]
            for score, size in scores:
                n = np.zeros(len(q) * len(key.dictionary), np.int64)
                n[number] = t[size].to_numpy()  # every row of a question has the same
                keep |= _rank_keep(number, ids, score.fill_null(-np.inf).to_numpy(), n)
            return t.filter(pa.array(keep))

        for rb in batches:
            held.append(rb)
            rows += rb.num_rows
            if rows >= _EMIT_ROWS // 4 + cut_at:
                t = cut()
                if len(t) >= _EMIT_ROWS:
                    yield from t.to_batches()
                    held, rows, cut_at = [], 0, 0
                else:
                    held, rows, cut_at = t.to_batches(), len(t), len(t)
        if rows:
            yield from cut().to_batches()

    return dealt.repartition(partitions, "query_id", "_bucket").drop("_bucket").mapInArrow(merge, CANDIDATE_SCHEMA)


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(
        "group_key",
        *[F.col(c).alias(prefix + c)
          for c in ("tile", "ids", "ns", "ns_i", "ks", "alphas", "dim_t", "dim_i", "mat_t", "mat_i")],
    )


@dataclass(frozen=True)
class SideStats:
    rows: int
    dim_t: int
    dim_i: int

    @property
    def row_bytes(self) -> int:
        return 24 + 4 * (self.dim_t + self.dim_i)


def side_stats(df: DataFrame, vt: str, vi: str) -> SideStats:
    """Row count and vector dimensions of one side (one small aggregate)."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(vt)).alias("dt"),
                 F.max(F.size(vi)).alias("di")).first()
    return SideStats(int(row["rows"] or 0), max(int(row["dt"] or 0), 0), max(int(row["di"] or 0), 0))


def packed_stats(tiles: DataFrame) -> SideStats:
    """Row count and dimensions of packed tiles."""
    row = tiles.agg(F.sum(F.size("ids")).alias("rows"), F.max("dim_t").alias("dt"), F.max("dim_i").alias("di")).first()
    return SideStats(int(row["rows"] or 0), int(row["dt"] or 0), int(row["di"] or 0))


def _questions_cost(q_rows: int, n_c: int, par: int, cfg: TileConfig) -> float:
    """Shuffle bytes of the broadcast-questions pairing: every corpus partition (one wave)
    emits up to 2n candidate rows for every question."""
    return q_rows * min(n_c, par) * cfg.pool_hint * cfg.candidate_row_bytes


def _parts_of_corpus(q_parts: int, n_c: int, par: int) -> int:
    """Every further part of the corpus has its own candidates: it is divided only so far as there are cores to take the parts."""
    return max(1, min(n_c, math.ceil(2 * par / q_parts)))


def _replicate_plan(q_rows: int, q_bytes: int, c_bytes: int, n_c: int, least: int, cap: int, cfg: TileConfig, par: int) -> tuple[int, float]:
    """Question tile count for the replicate pairing and its shuffle bytes.

    With n_q question tiles, each question tile is scored in r = 2 * par / n_q partitions (as few as keep the
    cores busy, see _parts_of_corpus): the corpus is copied n_q times, every question tile r times (once per partition, not once
    per pair) and every partition emits 2n candidate rows per question it holds. Total
    ``n_q * C + r * (Q_bytes + Q * 2n * w)`` falls with n_q only where r does, so that the least n_q of every r
    is tried. ``least``: the fewest tiles whose rows and finds a worker can hold.
    """
    per_q = cfg.pool_hint * cfg.candidate_row_bytes
    least = max(least, math.ceil(q_bytes / cfg.max_query_tile_bytes), 1)

    def cost(n_q: int) -> float:
        return n_q * c_bytes + _parts_of_corpus(min(n_q, cap), n_c, par) * (q_bytes + q_rows * per_q)

    counts = {max(least, math.ceil(2 * par / r)) for r in range(1, min(n_c, 2 * par) + 1)}
    n_q = min(sorted(counts), key=cost)
    return min(n_q, max(q_rows, 1)), cost(n_q)


def _whole_rounds(tiles: int, par: int) -> int:
    """Tiles that take about the same time, in rounds of one a core: the last round is filled."""
    return -(-tiles // par) * par if tiles > par else tiles


def tile_pairs(questions: DataFrame, corpus: DataFrame, cfg: TileConfig | None = None,
               qstats: SideStats | None = None, cstats: SideStats | None = None) -> tuple[DataFrame, str]:
    """Packed (question tile, corpus tile) pairs and the pairing mode; see
    :func:`hybrid_candidates`. Broadcast modes give one row per pair (``q_*``/``c_*``
    columns); the replicate mode gives co-grouped tile rows (``q_tile``, ``side``, ``c_tile``)."""
    cfg = cfg or TileConfig()
    q = questions.select("group_key", "query_id", F.col("n_text").alias("n"), F.col("n_image").alias("n_i"),
                         "k", "alpha", F.col("qt").alias("vt"), F.col("qi").alias("vi"))
    packed = "mat_t" in corpus.columns

    # Tile counts come from row counts (no data reaches the driver).
    cstats = cstats or (packed_stats(corpus) if packed else side_stats(corpus, "tv", "iv"))
    qstats = qstats or side_stats(q, "vt", "vi")
    c_bytes, q_bytes = cstats.rows * cstats.row_bytes, qstats.rows * qstats.row_bytes
    par = max(1, questions.sparkSession.sparkContext.defaultParallelism)
    n_c = max(cfg.min_corpus_tiles, math.ceil(c_bytes / cfg.corpus_tile_bytes), 1)
    # what is found for one question tile is about half of what a worker may hold, as some tiles have more
    least_n_q = math.ceil(2 * qstats.rows * min(cfg.pool_hint, 2 * max(cstats.rows, 1)) / _EMIT_ROWS)
    n_q = _whole_rounds(max(1, math.ceil(qstats.rows / cfg.query_tile_rows), least_n_q), par)

    # Broadcast the smaller packed side when its size (count x fixed row width) is under
    # the bound; the streamed side is cut into about one tile per core at least, and a small corpus
    # is spread by tiles, so the scoring runs in parallel. Splitting questions never adds candidate rows (each question
    # still sees the whole corpus tile); splitting the corpus does, so it is only done
    # when the corpus is the streamed side.
    # Partitions per side: one tile per partition up to a cap that keeps the task count sane
    # on a large cluster (tiles beyond it share partitions and are packed one group at a time).
    cap = max(4 * par, int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rep_n_q, rep_cost = _replicate_plan(qstats.rows, q_bytes, c_bytes, n_c, least_n_q, cap, cfg, par)
    if c_bytes <= cfg.broadcast_bytes and c_bytes <= q_bytes:
        n_q = max(n_q, min(par, math.ceil(qstats.rows / 64)))
        mode = "corpus"
    elif (q_bytes <= cfg.broadcast_bytes
          and _questions_cost(qstats.rows, max(n_c, min(par, math.ceil(cstats.rows / 1024))), par, cfg)
          <= rep_cost):
        n_c = max(n_c, min(par, math.ceil(cstats.rows / 1024)))
        mode = "questions"
    else:
        # the groups that the questions name are few; beyond 64 they share lanes
        names = [x.group_key for x in q.select("group_key").distinct().limit(65).collect() if x.group_key is not None]
        lanes = {g: i for i, g in enumerate(sorted(names))} if 0 < len(names) <= 64 else {}
        n_q = max(math.ceil(_whole_rounds(max(rep_n_q, least_n_q), par) / max(1, len(lanes))), math.ceil(q_bytes / cfg.max_query_tile_bytes))
        mode = "replicate"
    # Every partition that scores a question emits up to 2n rows for it. When the questions
    # are broadcast, each corpus partition sees all of them; beyond MERGE_ABOVE partitions a second
    # merge level (see _merged) bounds what the final windows read.
    ctiles = corpus if packed else pack_corpus(corpus, cfg, cstats.dim_t + cstats.dim_i, -(-cstats.rows // n_c) or None)
    if mode == "questions" and n_c <= par:
        # a corpus of about a tile per core at most may lie in fewer files than there are cores: its tiles are spread
        ctiles = ctiles.withColumn("_part", F.pmod(F.col("tile"), F.lit(n_c)).cast("int")).repartitionById(n_c, "_part").drop("_part")
    qtiles = _tiles(q, "query_id", n_q, min(n_q, cap))

    if mode == "corpus":
        return _prefixed(qtiles, "q_").join(F.broadcast(_prefixed(ctiles, "c_")), on="group_key", how="inner"), mode
    if mode == "questions":
        return _prefixed(ctiles, "c_").join(F.broadcast(_prefixed(qtiles, "q_")), on="group_key", how="inner"), mode
    # Replicate, question-tile-major. Question tiles are numbered anew in every group of vector sets, and a partition holds tiles
    # of one group, so that a corpus row is copied to the question tiles of its own group only. Question tile t of group g is
    # scored in r partitions (lane of t and g) * r + j; corpus tile c goes to partition j = c mod r of every question tile of
    # its group. Sorted by (group_key, question tile, side), each partition streams one packed question tile followed by its
    # corpus tiles, so a question tile travels r times (not once per pair), each pair is scored exactly once, and the
    # per-partition merge sees n_c / r corpus tiles per question.
    q_parts = min(n_q * max(1, len(lanes)), cap)
    r = _parts_of_corpus(q_parts, n_c, par)
    lane = F.col("q_tile")
    if lanes:
        ctiles = ctiles.where(F.col("group_key").isin(*lanes))
        lane = lane * F.lit(len(lanes)) + F.element_at(F.create_map(*[F.lit(x) for g, i in lanes.items() for x in (g, i)]), F.col("group_key"))
    base = F.pmod(lane, F.lit(q_parts)) * F.lit(r)
    cx = _copied(ctiles, n_q, "q_tile").withColumn("side", F.lit(1)).withColumnRenamed("tile", "c_tile")
    cx = cx.withColumn("part", (base + F.pmod(F.col("c_tile"), F.lit(r))).cast("int"))
    qx = _copied(qtiles, r, "_j").withColumn("side", F.lit(0)).withColumnRenamed("tile", "q_tile")
    qx = qx.withColumn("c_tile", F.lit(-1)).withColumn("part", (base + F.col("_j")).cast("int"))
    cols = ["group_key", "part", "q_tile", "side", "c_tile", *_TILE_FIELDS]
    both = (qx.select(*cols).unionByName(cx.select(*cols))
            .repartitionById(q_parts * r, "part")
            .sortWithinPartitions("group_key", "q_tile", "side", "c_tile")
            .drop("part"))
    return both, mode


def hybrid_candidates(questions: DataFrame, corpus: DataFrame, cfg: TileConfig | None = None,
                      qstats: SideStats | None = None, cstats: SideStats | None = None, fused: bool = False) -> DataFrame:
    """Per question, its top-``n_text`` rows by text and top-``n_image`` rows by image within
    each partition of tile pairs (the global pools are a final ``row_number`` away).

    questions: ``group_key, query_id, n_text, n_image, k, alpha, qt ARRAY<FLOAT>, qi ARRAY<FLOAT>``
               (``qi`` NULL or ``n_image`` 0 = the image space is not searched)
    corpus:    ``group_key, product_id, tv ARRAY<FLOAT>, iv ARRAY<FLOAT>``, or its :func:`pack_corpus` tiles
    Output (:data:`CANDIDATE_SCHEMA`) carries both exact similarities of every row, so a
    row found in one space still has its true score in the other; ``k``/``alpha`` pass
    through so later steps need no join back to the question table.
    ``fused``: instead, its top-``n_text`` rows by the fused score (of rows without an image similarity, the least ids last).
    """
    cfg = cfg or TileConfig()
    cstats = cstats or (packed_stats(corpus) if "mat_t" in corpus.columns else side_stats(corpus, "tv", "iv"))
    pairs, mode = tile_pairs(questions, corpus, cfg, qstats, cstats)
    score = _score_cogrouped if mode == "replicate" else _score_batches
    if fused:
        score = update_wrapper(partial(score, fused=True), score)
    cands = pairs.mapInArrow(score, CANDIDATE_SCHEMA)
    tiles = math.ceil(cstats.rows * cstats.row_bytes / cfg.corpus_tile_bytes)
    return _merged(cands, tiles, fused) if mode != "corpus" and tiles > cfg.merge_above else cands
