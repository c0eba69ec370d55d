"""Sharding by proportional stratified interleaving.

Rows of each source are shuffled by a seeded hash and ranked; rank r of a source of n rows gets the fraction
(r - 1/2) / n. All rows sorted by fraction are then cut into equal runs, so each shard holds every source in the
corpus's own proportions and shard sizes differ by one row at most.

No rank is taken over a whole source or the whole table in one task: a rank is the row's place within its
(source, hash range) bucket plus the bucket's offset, and likewise for the place in the global order. A source
that holds a third of the rows is spread over all buckets.

Nulls: a null source is a source of its own; null ids and null texts are ranked like others (size 1, crc32 of
the empty text). Rows that are equal in every used column may swap places, which leaves the result the same.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, unit_hash, written

#: Rows that one ranking bucket is meant to hold.
BUCKET_ROWS = 20_000


def _offsets(counts: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Running count before each bucket, by ``keys``."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("n").over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    out = counts.withColumn("before", F.coalesce(before, F.lit(0)))
    return out.withColumn("total", F.sum("n").over(w)) if keys else out


def interleaved_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                       shards: int = 16, seed: int = 7) -> DataFrame:
    """(id, size, text_crc32, stratum, fraction, shard, slot) for every row of ``df``.

    size: UTF-8 bytes of the text plus 1. shard: 0 to shards-1. slot: place in the shard, gapless from 0.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null")).alias("stratum"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("size0"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
    )
    total = df.count()
    buckets = max(64, -(-total // BUCKET_ROWS))
    rows = rows.withColumn("b", F.floor(unit_hash(F.col("h")) * buckets).cast("int"))
    counts = rows.groupBy("stratum", "b").agg(F.count(F.lit(1)).alias("n"))
    at = _offsets(counts, ["stratum"], "b").select("stratum", "b", "before", "total")
    inner = Window.partitionBy("stratum", "b").orderBy("h", "doc_id", "size0", "text_crc32")
    ranked = (
        rows.withColumn("r", F.row_number().over(inner))
        .join(at, ["stratum", "b"])
        .withColumn("fraction", (F.col("r") + F.col("before") - 0.5) / F.col("total"))
        .select("doc_id", "stratum", "size0", "text_crc32", "h", "fraction",
                F.floor(F.col("fraction") * buckets).cast("int").alias("g"))
    )
    ranked = written(spark, ranked, "shard-ranks")
    gat = _offsets(ranked.groupBy("g").agg(F.count(F.lit(1)).alias("n")), [], "g").select("g", "before")
    order = Window.partitionBy("g").orderBy("fraction", F.xxhash64(F.lit(seed), "stratum"), "stratum", "h", "doc_id",
                                            "size0", "text_crc32")
    placed = (
        ranked.withColumn("q", F.row_number().over(order))
        .join(gat, "g")
        .withColumn("pos", F.col("q") + F.col("before") - 1)
        .withColumn("shard", F.expr(f"CAST((pos * {shards}) DIV {max(total, 1)} AS INT)"))
    )
    first = F.expr(f"(shard * {total} + {shards - 1}) DIV {shards}")
    return placed.select(
        "doc_id", (F.col("size0") + 1).alias("size"), "text_crc32", "stratum", "fraction", "shard",
        (F.col("pos") - first).cast("long").alias("slot"),
    )


def op8_interleaved_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards whose row counts differ by one at most (law ``rows``)."""
    out = interleaved_shards(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
