"""Hashed bag-of-words text encoder, written as Spark SQL (no model weights needed).

token = maximal run of Unicode letters/digits of the lower-cased text;
bucket = first 24 bits of md5(token) mod ``dim``; vector = token counts per bucket.
Counts are exact small integers, so dot products and norms are exact in DOUBLE and do not
depend on summation order. A real sentence encoder plugs in with ``encode_with`` instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import HASH_DIM

TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def token_buckets(df: DataFrame, key: str, text: str, dim: int = HASH_DIM) -> DataFrame:
    """``key, bucket INT, tf BIGINT``: token counts per bucket of every (whole) text.

    The explode is followed by a partial (map-side) aggregation, so one huge text does not
    make one huge shuffle group.
    """
    toks = df.select(key, F.explode(F.split(F.lower(F.col(text)), TOKEN_SPLIT)).alias("tok"))
    toks = toks.filter(F.length("tok") > 0)
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col("tok")), 1, 6), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    return toks.groupBy(key, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("tf"))


def sparse_weights(buckets: DataFrame, key: str) -> DataFrame:
    """Add the L2-normalised weight ``tf / sqrt(sum tf^2)`` per text (window over <= dim rows)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    return buckets.withColumn("weight", F.col("tf") / F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(w)))


def dense_counts(buckets: DataFrame, key: str, dim: int = HASH_DIM, all_keys: DataFrame | None = None) -> DataFrame:
    """``key, vec ARRAY<FLOAT>(dim)`` of bucket counts; texts without tokens get a zero
    vector when ``all_keys`` lists them. One group = one text's <= dim buckets."""
    per = buckets.groupBy(key).agg(F.collect_list("bucket").alias("b"), F.collect_list("tf").alias("c"))
    if all_keys is not None:
        # the planner takes the buckets of all texts for no larger than the texts' well packed file: never broadcast
        per = all_keys.select(key).hint("merge").join(per, key, "left")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, c = batch.column(1), batch.column(2)
            out = np.zeros((len(batch), dim), np.float32)
            row = np.repeat(np.arange(len(batch)), b.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            out[row, b.flatten().to_numpy(zero_copy_only=False)] = c.flatten().to_numpy(zero_copy_only=False)
            offs = pa.array(np.arange(0, (len(batch) + 1) * dim, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offs, pa.array(out.ravel()))], names=[key, "vec"])

    return per.select(key, "b", "c").mapInArrow(fill, f"{key} {dict(per.dtypes)[key]}, vec array<float>")


_ENCODERS: dict[str, Callable] = {}


def encode_with(df: DataFrame, key: str, text: str, factory: Callable[[], Callable[[list[str]], list[list[float]]]],
                dim: int, name: str | None = None) -> DataFrame:
    """Plug-in slot for a real encoder: batches of texts through ``mapInPandas``; output is ``key, vec ARRAY<FLOAT>``.

    ``factory`` makes the encoder (loads the model) on the worker, so no model travels with a task; under a ``name``
    it is made once per Python worker, else once per partition.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _ENCODERS.get(name) if name else None
        if encoder is None:
            encoder = factory()
            if name:
                _ENCODERS[name] = encoder
        for pdf in batches:
            vecs = encoder(pdf[text].fillna("").tolist())
            if any(len(v) != dim for v in vecs):
                raise ValueError("encoder returned a vector of the wrong length")
            yield pd.DataFrame({key: pdf[key], "vec": [list(map(float, v)) for v in vecs]})

    key_type = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInPandas(run, f"{key} {key_type}, vec array<float>")
