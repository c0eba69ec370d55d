"""Product catalog: typed CSV ingest with rejects, and the adapter over the supplied tables.

Catalog schema: ``product_id BIGINT, title, store, description STRING, price FLOAT,
average_rating FLOAT, image STRING`` (+ optional ``features``, ``details``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, LongType, StringType, StructField, StructType

from ..config import IMAGE_URL_PREFIX, IMAGE_URL_SUFFIX, MISSING_WORDS
from ..session import scratch_table
from .csv_split import read_csv, with_place_ordinal
from .tables import read_table

CATALOG_SCHEMA = StructType([
    StructField("product_id", LongType()),
    StructField("title", StringType()),
    StructField("store", StringType()),
    StructField("description", StringType()),
    StructField("price", FloatType()),
    StructField("average_rating", FloatType()),
    StructField("image", StringType()),
])

# Columns read from a catalog CSV; everything else in the file is ignored.
CSV_COLUMNS = ["image", "title", "store", "price", "average_rating"]
#: A plain decimal number; no type suffixes or words.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
CSV_OPTIONAL = ["description", "features", "details"]


def read_catalog_csv(spark: SparkSession, path: str, id_col: str | None = None, split: bool = False) -> tuple[DataFrame, DataFrame]:
    """Typed catalog from a CSV with a header. Returns ``(catalog, rejects)``.

    split: read a file by many tasks (:mod:`shoprank.sources.csv_split`); records of another length than the header or with open
    quotes then are rejects too, with their text as ``price``. Else Spark's own reader takes a file as one task.

    The header is read in full and columns are selected **by name** (a partial schema
    would bind by position). ``product_id`` is the value of ``id_col`` when given, else the
    0-based row ordinal of a single catalog file (the id the vector files refer to).
    Numbers written as a missing-value word (``MISSING_WORDS``) are NULL and the row stays; unparsable numbers send
    the row to ``rejects`` with a reason instead of failing the job.
    """
    broken = None
    if split:
        raw, broken = read_csv(spark, path)
        raw = scratch_table(spark, raw, "catalog-csv-rows")
    else:
        raw = (
            spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .option("mode", "PERMISSIVE").csv(path)
        )
    missing = [c for c in CSV_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"catalog CSV lacks columns {missing}")
    keep = CSV_COLUMNS + [c for c in CSV_OPTIONAL if c in raw.columns]
    if id_col is not None:
        df = raw.select(*keep, F.col(id_col).try_cast("bigint").alias("product_id"))
    elif split:
        df = with_place_ordinal(raw, "product_id").select(*keep, "product_id")
    else:
        df = with_row_ordinal(raw.select(*keep), "product_id")

    def num(c: str):
        return F.when(F.trim(F.col(c)).rlike(NUMBER), F.trim(F.col(c)).try_cast("float"))

    def is_bad(c: str):
        s = F.trim(F.col(c))
        return F.coalesce(~s.isin(*MISSING_WORDS) & ~s.rlike(NUMBER), F.lit(False))

    typed = df.select(
        "product_id",
        F.col("title"), F.col("store"),
        (F.col("description") if "description" in df.columns else F.lit(None).cast("string")).alias("description"),
        num("price").alias("price"), num("average_rating").alias("average_rating"),
        F.col("image"),
        *[F.col(c) for c in ("features", "details") if c in df.columns],
        F.col("price").alias("_raw_price"), F.col("average_rating").alias("_raw_rating"),
    )
    bad_price, bad_rating = is_bad("_raw_price"), is_bad("_raw_rating")
    reason = F.concat_ws(",", F.when(bad_price, F.lit("price")), F.when(bad_rating, F.lit("average_rating")))
    catalog = typed.filter(~(bad_price | bad_rating)).drop("_raw_price", "_raw_rating")
    rejects = typed.filter(bad_price | bad_rating).select(
        "product_id", F.col("_raw_price").alias("price"), F.col("_raw_rating").alias("average_rating"),
        reason.alias("reason"))
    if broken is not None:
        rejects = rejects.unionByName(broken.select(F.lit(None).cast("bigint").alias("product_id"), F.col("text").alias("price"),
                                                    F.lit(None).cast("string").alias("average_rating"), "reason"))
    return catalog, rejects


def with_row_ordinal(df: DataFrame, name: str) -> DataFrame:
    """Add the 0-based row position in scan order, computed on the executors.

    ``monotonically_increasing_id`` = (partition << 33) + position in partition; a table of
    per-partition row counts (one row per input partition, so its size is bounded by the
    partition count) gives each partition its offset.
    """
    mid = df.withColumn("_mid", F.monotonically_increasing_id())
    pid = F.shiftright(F.col("_mid"), 33)
    counts = mid.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = mid.join(F.broadcast(offsets), pid == F.col("_pid"))
    pos = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn(name, (F.col("_off") + pos).cast("bigint")).drop("_mid", "_pid", "_off")


def product_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``average_rating = avg(l_quantity) / 10`` per part (partial aggregation before the shuffle)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_partkey", "l_quantity"])
    return li.groupBy(F.col("l_partkey").alias("product_id")).agg(
        (F.avg("l_quantity") / 10).cast("float").alias("average_rating"))


def catalog_from_tables(spark: SparkSession, sf_dir: str, with_rating: bool = True) -> DataFrame:
    """Fixture adapter: ``part`` (+ ``lineitem`` for ratings) as a typed catalog."""
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"])
    cat = part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("store"),
        F.col("p_type").alias("description"),
        F.col("p_retailprice").cast("float").alias("price"),
        F.concat(F.lit(IMAGE_URL_PREFIX), F.col("p_partkey").cast("string"), F.lit(IMAGE_URL_SUFFIX)).alias("image"),
    )
    if with_rating:
        cat = cat.join(product_ratings(spark, sf_dir), "product_id", "left")
    else:
        cat = cat.withColumn("average_rating", F.lit(None).cast("float"))
    return cat.select(*[f.name for f in CATALOG_SCHEMA.fields])
