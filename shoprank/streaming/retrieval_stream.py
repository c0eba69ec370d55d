"""Structured Streaming: questions arrive as files and are answered against static tables.

Each micro-batch runs the same :func:`shoprank.plans.retrieval.retrieve` plan as the batch
path. The sink is keyed by ``(query_id, rank)`` and written per ``batch_id`` with
overwrite, so a batch replayed after a failure replaces its own output instead of
duplicating it; progress lives in the checkpoint folder (shared storage).

With ``once_within`` a question that comes again, in the same or a later micro-batch or after a restart, is answered once:
its ``query_id`` is kept as state since it first arrived, for that long. The time of arrival is the watermark's column, so no
question is ever too late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.retrieval import question_rejects, retrieve


def answer_batch(batch: DataFrame, batch_id: int, corpus: DataFrame, sink_dir: str,
                 catalog: DataFrame | None = None, retrieve_kwargs: dict | None = None) -> DataFrame:
    """Answer one micro-batch of questions and (over)write its own sink folder; questions that can't be run go to
    ``<sink_dir>_rejects`` with a reason. Sizes and the largest k are measured on the batch itself.

    Writing to ``batch_id=<id>`` with overwrite makes a replay of the same batch (after a
    failure between the write and the checkpoint commit) replace, not duplicate, its rows.
    """
    question_rejects(batch).write.mode("overwrite").parquet(f"{sink_dir}_rejects/batch_id={batch_id}")
    ranked = retrieve(batch, corpus, catalog, **(retrieve_kwargs or {}))
    (ranked.withColumn("batch_id", F.lit(batch_id).cast("long"))
     .write.mode("overwrite").parquet(f"{sink_dir}/batch_id={batch_id}"))
    return ranked


def answer_stream(spark: SparkSession, source_dir: str, schema, sink_dir: str, checkpoint_dir: str,
                  corpus: DataFrame, catalog: DataFrame | None = None, files_per_trigger: int = 1,
                  retrieve_kwargs: dict | None = None,
                  on_batch: Callable[[DataFrame, int], None] | None = None, once_within: str | None = None) -> None:
    """Run the question stream to completion (``availableNow``) into ``sink_dir``.

    once_within: an interval (``"1 day"``) in which a ``query_id`` is answered once; rows without an id all go to the rejects.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        ranked = answer_batch(batch, batch_id, corpus, sink_dir, catalog, retrieve_kwargs)
        if on_batch is not None:
            on_batch(ranked, batch_id)

    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(source_dir))
    if once_within is not None:
        stream = first_of_each(stream, once_within)
    query = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_dir)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(f"question stream failed: {query.exception()}")


def first_of_each(stream: DataFrame, once_within: str) -> DataFrame:
    """The rows of a question stream without those whose ``query_id`` has come within ``once_within`` before.

    Keyed state, dealt by the id: one entry a question, dropped when the interval is over. Rows without an id differ by all
    their columns, so that equal ones are one reject.
    """
    cols = stream.columns
    who = F.when(F.col("query_id").isNull(), F.xxhash64(*cols)).otherwise(F.lit(0))
    marked = stream.withColumns({"_arrived": F.current_timestamp(), "_who": who}).withWatermark("_arrived", once_within)
    return marked.dropDuplicatesWithinWatermark(["query_id", "_who"]).select(*cols)


def read_answers(spark: SparkSession, sink_dir: str) -> DataFrame:
    """All answers written so far (one folder per micro-batch)."""
    return spark.read.parquet(sink_dir)
