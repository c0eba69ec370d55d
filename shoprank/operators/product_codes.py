"""Exact top-n by cosine over product-quantised codes, floats being read for survivors only.

A unit vector is cut into ``m`` pieces, each written as the numbers of the nearest of 256 centroids and of the nearest of 256
centroids of what that one misses: ``2 * m`` bytes a vector instead of four a dimension, and the length of what both miss (``err``,
rounded up). By Cauchy-Schwarz a question's true cosine lies within ``err`` of its product with the decoded vector, so that

1. a pass over the codes finds, for every question, the n-th greatest lower bound;
2. a second pass meets the codes beside their float vectors: where the upper bound reaches that, the cosine is computed from the
   floats as the exact search does, and the n best are kept. Survivors are used where they are found and never written.

The result is the exact one whatever the codebooks; these only decide how many rows survive. Codebooks are fitted by
k-means on a bounded sample (least hash first); all rows are coded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_table
from .cells import _matrix, _unit
from .knn import _BLOCK, _EXACT_PAIRS, _STEP, _Matrix, _cosines, _near, _nth_best, _rank_keep, _slack
from .tile_join import pack, tile_join, tiles_for

CENTROIDS = 256
#: Lower bounds or rows that a worker may hold before it hands them out.
HELD_ROWS = 4_000_000


@dataclass(frozen=True)
class CodedVectors:
    """``tiles``: packed rows ``code BINARY(2 * m), err FLOAT``; ``floats``: packed rows ``product_id, code, err, vec``; ``books`` and
    ``fine`` (of what the first miss): [m, 256, width]."""

    tiles: DataFrame
    floats: DataFrame
    books: np.ndarray
    fine: np.ndarray
    dim: int
    rows: int

    @property
    def code_bytes(self) -> int:
        """Bytes of all codes and lengths of what they miss."""
        return self.rows * (2 * len(self.books) + 4)


def _pieces(x: np.ndarray, m: int) -> np.ndarray:
    """[rows, m, width] of unit vectors, the last piece filled up with zeros."""
    width = -(-x.shape[1] // m)
    out = np.zeros((len(x), m * width))
    out[:, :x.shape[1]] = x
    return out.reshape(len(x), m, width)


def fit_books(sample: np.ndarray, m: int, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """Codebooks [m, 256, width] by k-means on every piece of the sample's unit vectors."""
    return _fit(_pieces(_unit(np.asarray(sample, np.float64)), m), rounds, seed)


def _fit(x: np.ndarray, rounds: int = 10, seed: int = 11) -> np.ndarray:
    m = x.shape[1]
    books = np.zeros((m, CENTROIDS, x.shape[2]))
    rng = np.random.default_rng(seed)
    for j in range(m if len(x) else 0):
        p = x[:, j]
        centre = p[rng.choice(len(p), CENTROIDS, replace=len(p) < CENTROIDS)]
        for _ in range(rounds):
            own = _nearest(p, centre)
            count = np.bincount(own, minlength=CENTROIDS)
            sums = np.zeros_like(centre)
            np.add.at(sums, own, p)
            centre = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centre)
        books[j] = centre
    return books


def _nearest(p: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((centre * centre).sum(1) - 2.0 * (p @ centre.T)).argmin(1)


def _coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes [rows, m] of pieces and what these miss."""
    codes = np.stack([_nearest(x[:, j], books[j]) for j in range(len(books))], 1)
    return codes, x - books[np.arange(len(books)), codes]


def _decoded(codes: np.ndarray, books: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """float32 vectors [rows, m * width] of codes [rows, 2 * m]."""
    m = len(books)
    out = books.astype(np.float32)[np.arange(m), codes[:, :m]]
    out += fine.astype(np.float32)[np.arange(m), codes[:, m:]]
    return out.reshape(len(codes), -1)


def build_codes(corpus: DataFrame, m: int = 8, sample_rows: int = 20_000, tile_bytes: int = 16 << 20) -> CodedVectors:
    """Codes of all rows of ``corpus`` (``product_id, vec`` of one dimension without NULLs), written once next to the vectors."""
    spark = corpus.sparkSession
    vectors = scratch_table(spark, corpus.select(F.col("product_id").cast("long").alias("product_id"), F.col("vec").cast("array<float>").alias("vec")), "code-vectors")
    size = vectors.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("vec")).alias("dim")).first()
    h = F.xxhash64("product_id")
    thin = vectors.where(F.pmod(h, F.lit(1 << 20)) < max(1, min(1 << 20, math.ceil((1 << 20) * 2.0 * sample_rows / max(1, size.rows)))))
    sample = thin.orderBy(h, "product_id").limit(sample_rows).select("vec").toPandas()["vec"]
    first = np.stack(sample.to_list()) if len(sample) else np.zeros((0, size.dim or 1))
    books = fit_books(first, m)
    fine = _fit(_coded(_pieces(_unit(first.astype(np.float64)), m), books)[1])
    shared = spark.sparkContext.broadcast((books, fine))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _pieces(_unit(_matrix(part.column(1))), m)
                books, fine = shared.value
                codes, missed = _coded(x, books)
                codes = np.concatenate([codes, _coded(missed, fine)[0]], 1)
                missed = x.reshape(len(x), -1) - _decoded(codes, books, fine)
                err = np.nextafter(np.sqrt((missed * missed).sum(1)).astype(np.float32), np.float32(np.inf))
                raw = codes.astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(err), part.column(1)],
                                                 names=["product_id", "code", "err", "vec"])

    coded = scratch_table(spark, vectors.mapInArrow(code, "product_id long, code binary, err float, vec array<float>"), "code-rows")

    def packed(rows: DataFrame, width: int, label: str) -> DataFrame:
        return scratch_table(spark, pack(rows, tiles_for(size.rows, width, tile_bytes, spark.sparkContext.defaultParallelism)), label)

    return CodedVectors(packed(coded.select("code", "err"), 2 * m + 4, "code-tiles"), packed(coded, 2 * m + 12 + 4 * int(size.dim or 0), "code-floats"),
                        books, fine, int(size.dim or 0), int(size.rows))


class _Rows:
    """Vectors of a tile as :func:`shoprank.operators.knn._near` takes them."""

    def __init__(self, unit: np.ndarray):
        self.unit, self.dim = unit, unit.shape[1]

    def __len__(self) -> int:
        return len(self.unit)


def _asked(questions: pa.Table, m: int) -> _Rows:
    """Unit questions with a last 1, whose product with (decoded vector, bound) is the bounded cosine."""
    q = _unit(_matrix(questions.column("vec").combine_chunks()))
    q = _pieces(q, m).reshape(len(q), -1).astype(np.float32)
    return _Rows(np.concatenate([q, np.ones((len(q), 1), np.float32)], 1))


def _bounds(rows: pa.Table, books: np.ndarray, fine: np.ndarray, sign: float) -> _Rows:
    """Decoded vectors with a last column of what they miss at most, for upper (1) or lower (-1) bounds."""
    codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(rows), -1)
    about = _decoded(codes, books, fine)
    err = rows.column("err").to_numpy() + np.float32(_slack(about.shape[1] + 1))
    return _Rows(np.concatenate([about, sign * err[:, None].astype(np.float32)], 1))


def _lows(books: np.ndarray, fine: np.ndarray):
    """First pass: a question's n greatest lower bounds in a partition, in one or more rows."""

    def greatest(q: _Rows, c: _Rows, a: int, b: int, n: np.ndarray, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        near = _near(q, c, a, b, n[a:b], floor[a:b])
        if near is None:
            return greatest(q, c, a, (a + b) // 2, n, floor) + greatest(q, c, (a + b) // 2, b, n, floor)
        return [(near[0] + a, near[2].astype(np.float64))]

    def score(pairs) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}

        def out(x: dict) -> Iterator[pa.RecordBatch]:
            r, low = x["r"], x["low"]
            order = np.argsort(r, kind="stable")
            own, count = np.unique(r, return_counts=True)
            x["r"], x["low"] = r[:0], low[:0]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(low[order]))
            yield pa.RecordBatch.from_arrays([pa.array(x["ids"][own]), pa.array(x["ns"][own].astype(np.int32)), lists], names=["query_id", "n", "lows"])

        for lt, questions, _, rows in pairs:
            if lt not in held:
                ids, ns = (questions.column(c).to_numpy().astype(np.int64) for c in ("query_id", "n"))
                held[lt] = {"q": _asked(questions, len(books)), "ids": ids, "ns": ns, "floor": np.full(len(ids), -np.inf),
                            "r": np.zeros(0, np.int64), "low": np.zeros(0)}
            x, c = held[lt], _bounds(rows, books, fine, -1.0)
            found = [y for a in range(0, len(x["ids"]), _BLOCK) for y in greatest(x["q"], c, a, min(a + _BLOCK, len(x["ids"])), x["ns"], x["floor"])]
            r, low = (np.concatenate(y) for y in zip((x["r"], x["low"]), *found))
            keep = _rank_keep(r, np.zeros(len(r)), low, x["ns"])
            x["r"], x["low"] = r[keep], low[keep]
            x["floor"] = np.maximum(x["floor"], _nth_best(x["r"], x["low"], x["ns"]))
            if sum(len(y["r"]) for y in held.values()) > HELD_ROWS:
                for y in held.values():
                    yield from out(y)
        for y in held.values():
            yield from out(y)

    return score


def _reaching(x: dict, c: _Rows, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(question, row) of the pairs whose upper bound reaches the question's least, a bounded number at a time."""
    q, least = x["q"], (x["least"] - slack).astype(np.float32)
    for a in range(0, len(q), _BLOCK):
        for at in range(0, len(c), _STEP):
            high = q.unit[a:a + _BLOCK] @ c.unit[at:at + _STEP].T
            i, j = np.divmod(np.flatnonzero(high >= least[a:a + _BLOCK, None]), high.shape[1])
            if len(i):
                yield i + a, j + at


def _second(books: np.ndarray, fine: np.ndarray, what: str):
    """Second pass: ``count`` of survivors, the survivors (``pairs``), or the ``best`` by their floats."""

    def score(pairs) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}

        def rows_of(x: dict) -> Iterator[pa.RecordBatch]:
            r, pid, sim = (x.pop(c) for c in ("r", "pid", "sim"))
            x |= {"r": r[:0], "pid": pid[:0], "sim": sim[:0]}
            for at in range(0, len(r), _EXACT_PAIRS):
                i, p, v = (y[at:at + _EXACT_PAIRS] for y in (r, pid, sim))
                yield pa.RecordBatch.from_arrays([pa.array(x["ids"][i]), pa.array(x["ns"][i].astype(np.int32)), pa.array(p), pa.array(v)],
                                                 names=["query_id", "n", "product_id", "sim"])

        def matrix(vec: pa.ChunkedArray) -> _Matrix:
            v = _matrix(vec.combine_chunks()).astype("<f4")
            return _Matrix(v.tobytes(), *v.shape)

        for lt, questions, _, rows in pairs:
            if lt not in held:
                held[lt] = {"q": _asked(questions, len(books)), "least": questions.column("least").to_numpy(), "r": np.zeros(0, np.int64),
                            "pid": np.zeros(0, np.int64), "sim": np.zeros(0)}
                held[lt] |= {"ids": questions.column("query_id").to_numpy(), "ns": questions.column("n").to_numpy().astype(np.int64)}
                if what == "best":
                    held[lt]["vec"] = matrix(questions.column("vec"))
            x, c, pids = held[lt], _bounds(rows, books, fine, 1.0), rows.column("product_id").to_numpy()
            vec = matrix(rows.column("vec")) if what == "best" else None
            count = np.zeros(len(x["ids"]), np.int64)
            new, size = [], 0

            def merge() -> None:
                r, pid, sim = (np.concatenate(y) for y in zip((x["r"], x["pid"], x["sim"]), *new))
                keep = _rank_keep(r, pid, sim, x["ns"])
                x["r"], x["pid"], x["sim"] = r[keep], pid[keep], sim[keep]

            for i, j in _reaching(x, c, _slack(c.dim)):
                if what == "count":
                    count += np.bincount(i, minlength=len(count))
                elif what == "pairs":
                    yield pa.RecordBatch.from_arrays([pa.array(x["ids"][i]), pa.array(x["ns"][i].astype(np.int32)), pa.array(pids[j])],
                                                     names=["query_id", "n", "product_id"])
                else:
                    new.append((i, pids[j], _cosines(x["vec"], vec, i, j)))
                    size += len(i)
                    if size > HELD_ROWS:
                        merge()
                        new, size = [], 0
            if what == "count":
                yield pa.RecordBatch.from_arrays([pa.array(x["ids"]), pa.array(count)], names=["query_id", "n_rescored"])
            elif what == "best" and new:
                merge()
                if sum(len(y["r"]) for y in held.values()) > HELD_ROWS:
                    for y in held.values():
                        yield from rows_of(y)
        if what == "best":
            for y in held.values():
                yield from rows_of(y)

    return score


def _second_pass(questions: DataFrame, coded: CodedVectors, what: str, schema: str, question_rows: int) -> DataFrame:
    """Both passes over ``questions`` (``query_id, vec, n``)."""
    spark = questions.sparkSession
    rows = scratch_table(spark, questions.select("query_id", F.col("n").cast("int").alias("n"), F.col("vec").cast("array<float>").alias("vec")), "code-asked")
    packed = scratch_table(spark, pack(rows, question_rows), "code-questions")
    lows = tile_join(packed, coded.tiles, _lows(coded.books, coded.fine), "query_id long, n int, lows array<double>")
    # a question's n greatest of every partition, its rows being as many as the partitions that meet it
    all_lows = F.sort_array(F.flatten(F.collect_list("lows")), asc=False)
    least = lows.groupBy("query_id").agg(F.max("n").alias("most"), all_lows.alias("lows")).select(
        "query_id", F.coalesce(F.try_element_at("lows", F.col("most")), F.lit(float("-inf"))).alias("least"))
    bounded = rows.join(least.hint("shuffle_merge"), "query_id")
    again = scratch_table(spark, pack(bounded, question_rows), "code-bounded")
    return tile_join(again, coded.floats, _second(coded.books, coded.fine, what), schema)


def survivors(questions: DataFrame, coded: CodedVectors, question_rows: int = 512) -> DataFrame:
    """``query_id, n, product_id``: the rows that can be among a question's n best (``questions``: ``query_id, vec, n``)."""
    return _second_pass(questions, coded, "pairs", "query_id long, n int, product_id long", question_rows)


def survivor_counts(questions: DataFrame, coded: CodedVectors, question_rows: int = 512) -> DataFrame:
    """``query_id, n_rescored``: how many :func:`survivors` a question has; they are counted where they are found."""
    found = _second_pass(questions, coded, "count", "query_id long, n_rescored long", question_rows)
    return found.groupBy("query_id").agg(F.sum("n_rescored").alias("n_rescored"))


def search_codes(questions: DataFrame, coded: CodedVectors, question_rows: int = 512) -> DataFrame:
    """``query_id, product_id, rank, sim``: each question's n best by cosine, the same as the exact search finds."""
    scored = _second_pass(questions, coded, "best", "query_id long, n int, product_id long, sim double", question_rows)
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "product_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.col("n")).select("query_id", "product_id", "rank", "sim")
