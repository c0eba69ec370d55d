"""Every tile of one table against every tile of another, in bounded memory and without a driver loop.

Rows are packed where they are scanned: a tile is one row with a binary Arrow stream of up to ``rows`` rows. Two packed
tables meet in one of two ways, chosen by their checked sizes. The smaller one is broadcast if it is at most BROADCAST_BYTES;
else both are copied to the (left tile, right tile) partitions they are needed in, as in :mod:`shoprank.operators.knn`: a left
tile travels once per partition, followed by the right tiles that it meets there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bytes of a packed table that are broadcast.
BROADCAST_BYTES = 64 << 20

Pairs = Iterator[tuple[int, pa.Table, int, pa.Table]]


def to_blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def pack(df: DataFrame, rows: int) -> DataFrame:
    """``tile INT, n INT, blob BINARY``: the rows of ``df`` in tiles of ``rows`` at most. No exchange; a task's last tile may be small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, n = TaskContext.get().partitionId() * 65_537, [], 0

        def out() -> pa.RecordBatch:
            nonlocal number, held, n
            table = pa.Table.from_batches(held)
            number, held, n = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([number % (1 << 31)], pa.int32()), pa.array([len(table)], pa.int32()),
                                               pa.array([to_blob(table)], pa.binary())], names=["tile", "n", "blob"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, rows - n)
                held.append(part)
                n += part.num_rows
                at += part.num_rows
                if n == rows:
                    yield out()
        if n:
            yield out()

    return df.mapInArrow(run, "tile int, n int, blob binary")


def tile_join(left: DataFrame, right: DataFrame, score: Callable[[Pairs], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``score`` over the tile pairs of each partition; ``left`` and ``right`` are packed tables (written ones: they are read twice).

    ``score`` gets (left tile, its rows, right tile, its rows) and may keep what it likes for a left tile; no order of right
    tiles is promised, and a left tile's pairs may lie in several partitions.
    """
    spark = left.sparkSession
    sizes = [df.agg(F.count(F.lit(1)).alias("tiles"), F.coalesce(F.sum(F.length("blob")), F.lit(0)).alias("bytes")).first() for df in (left, right)]
    (n_left, b_left), (n_right, b_right) = ((s.tiles, s.bytes) for s in sizes)
    par = max(1, spark.sparkContext.defaultParallelism)
    q = left.select(F.col("tile").alias("lt"), F.col("blob").alias("lb"))
    c = right.select(F.col("tile").alias("rt"), F.col("blob").alias("rb"))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Pairs:
            last, held = None, None
            for batch in batches:
                for lt, lb, rt, rb in zip(*(batch.column(i) for i in range(4))):
                    if lt.as_py() != last:
                        last, held = lt.as_py(), from_blob(lb.as_py())
                    yield last, held, rt.as_py(), from_blob(rb.as_py())

        yield from score(pairs())

    if min(b_left, b_right) <= BROADCAST_BYTES:
        key = F.lit(0).alias("key")
        if b_left <= b_right:
            moved = c.select(key, "*")
            if n_right <= 4 * par:  # few tiles: spread over the cores
                moved = moved.withColumn("_p", F.pmod("rt", F.lit(max(1, n_right))).cast("int")).repartitionById(max(1, n_right), "_p").drop("_p")
            both = moved.join(F.broadcast(q.select(key, "*")), "key")
        else:
            moved = q.select(key, "*")
            if n_left <= 4 * par:
                moved = moved.withColumn("_p", F.pmod("lt", F.lit(max(1, n_left))).cast("int")).repartitionById(max(1, n_left), "_p").drop("_p")
            both = moved.join(F.broadcast(c.select(key, "*")), "key")
        return both.select("lt", "lb", "rt", "rb").mapInArrow(flat, schema)

    # left tiles are numbered 0 .. n_left - 1 (one row each, so the numbering moves no more than tile numbers)
    from pyspark.sql import Window

    number = left.select(F.col("tile").alias("lt"), (F.row_number().over(Window.orderBy("tile")) - 1).alias("no"))
    cap = max(4 * par, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lanes = min(n_left, cap)
    width = max(1, min(n_right, cap // lanes))
    base = F.pmod("no", F.lit(lanes)) * F.lit(width)
    ql = q.join(F.broadcast(number), "lt").select("no", F.lit(0).alias("side"), F.col("lb").alias("blob"), F.col("lt").alias("tile"),
                                                  F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("lane"))
    cr = c.select(F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))).alias("no"), F.lit(1).alias("side"), F.col("rb").alias("blob"), F.col("rt").alias("tile"),
                  F.pmod("rt", F.lit(width)).alias("lane"))
    both = ql.unionByName(cr).withColumn("part", (base + F.col("lane")).cast("int"))
    both = both.repartitionById(lanes * width, "part").sortWithinPartitions("no", "side", "tile").select("no", "side", "tile", "blob")

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Pairs:
            tile, held = None, None
            for batch in batches:
                for side, t, blob in zip(*(batch.column(i) for i in (1, 2, 3))):
                    if side.as_py() == 0:
                        tile, held = t.as_py(), from_blob(blob.as_py())
                    else:
                        yield tile, held, t.as_py(), from_blob(blob.as_py())

        yield from score(pairs())

    return both.mapInArrow(grouped, schema)


def tiles_for(rows: int, row_bytes: int, tile_bytes: int, cores: int) -> int:
    """Rows of a tile: at most ``tile_bytes``, and at least one tile a core if there are enough rows."""
    return max(1, min(tile_bytes // max(1, row_bytes), math.ceil(rows / max(1, cores))))
