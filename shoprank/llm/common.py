"""Helpers shared by the operators of this subpackage: written stages, Arrow text blocks, byte hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path

#: Text bytes that one numpy step works on; bounds a Python worker's memory whatever the Arrow batch holds.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """One input table, pruned to ``cols``."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder and read back.

    Cuts lineage: a lost executor makes Spark reread files, not repeat the stage.
    """
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(id_col: Column, k: int) -> Column:
    """crc32 of the id's decimal text, mod ``k`` (null ids: of the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % F.lit(k)


def unit_hash(h: Column) -> Column:
    """A signed 64-bit hash as a double in [0, 1)."""
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """An Arrow function after whose last batch the worker gives unused memory back: workers are used again by later stages,
    and would otherwise keep the most that any stage has needed."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim is not None:
                trim(0)

    return wrapped


def with_fields(df: DataFrame, more: str, *without: str) -> StructType:
    """The schema of ``df`` but for some columns, followed by the fields of a DDL text."""
    return StructType([f for f in df.schema.fields if f.name not in without] + StructType.fromDDL(more).fields)


def text_blocks(batch: pa.RecordBatch, col: str, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``max_bytes`` of text at most.

    Rows are never cut: one longer text is a block of its own. Nulls are empty texts.
    """
    arr = batch.column(batch.schema.get_field_index(col))
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    n = len(arr)
    if n == 0:
        return
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)[arr.offset:arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if arr.buffers()[2] is not None and offs[-1] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_TAB = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = 1 << 16


def _power_tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0 .. base**(_STEP-1) and base**0, base**_STEP .. base**(_STEP*(_STEP-1)), mod 2**64."""
    out = []
    for b in (base, pow(base, _STEP, 1 << 64)):
        t = np.full(_STEP, b, np.uint64)
        t[0] = 1
        out.append(np.multiply.accumulate(t))
    return out[0], out[1]


_LOW, _HIGH = _power_tables(_P)
_LOW_INV, _HIGH_INV = _power_tables(_PINV)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers that weigh the bytes of a hash."""
    i = np.arange(n)
    return _LOW[i & (_STEP - 1)] * _HIGH[i >> 16]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hasher(data: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The function of :func:`span_hashes` for one ``data``, to be asked for several sets of spans."""
    n = len(data)
    pre = np.zeros(n + 1, np.uint64)
    for at in range(0, n, _STEP):
        part = _TAB[data[at:at + _STEP]]
        part *= _LOW[:len(part)]
        part *= _HIGH[at // _STEP]
        pre[at + 1:at + 1 + len(part)] = part
    np.cumsum(pre, out=pre)

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = pre[ends]
        raw -= pre[starts]
        raw *= _LOW_INV[starts & (_STEP - 1)]
        raw *= _HIGH_INV[starts >> 16]
        return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    return hashes


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[s:e] for every (s, e): equal bytes, equal hash, wherever they stand.

    Takes 16 bytes a byte of ``data`` while it runs; the powers of longer data are made from two tables of 64 K entries.
    """
    return span_hasher(data)(starts, ends)


#: White space of word splitting: U+0020 and U+0009 to U+000D.
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of non-white-space bytes; words never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~_WS[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:-1]
    nxt = np.ones(len(data), bool)
    nxt[:-1] = ~solid[1:] | first[1:-1]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(solid & nxt) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i]+lens[i]-1, concatenated."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    ends = np.cumsum(lens)
    keep = lens > 0
    st, ln, en = starts[keep], lens[keep], ends[keep]
    out[0] = st[0]
    out[en[:-1]] = st[1:] - (st[:-1] + ln[:-1] - 1)
    return np.cumsum(out)


def spaced_parts(data: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """(from, to) of parts of one text of about ``size`` bytes (BLOCK_BYTES), cut before white space: no word is in two parts."""
    size = size or BLOCK_BYTES
    a, n = 0, len(data)
    while n - a > size:
        b = a + size
        while b < n:
            gap = np.flatnonzero(_WS[data[b:b + 4096]])
            if len(gap):
                b += int(gap[0])
                break
            b += 4096
        b = min(b, n)
        yield a, b
        a = b
    if a < n:
        yield a, n


def long_words(words: Callable, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """``words(data, offs)``, which gives arrays (start, end, row, ...) a word, with a long text taken part by part.

    The working memory of ``words`` then grows with BLOCK_BYTES, not with the longest text.
    """
    if len(offs) != 2 or len(data) <= 2 * BLOCK_BYTES:
        return words(data, offs)
    out = []
    for a, b in spaced_parts(data):
        starts, ends, *rest = words(data[a:b], np.array([0, b - a]))
        out.append((starts + a, ends + a, *rest))
    return tuple(np.concatenate(x) for x in zip(*out))
