"""Corpus preparation pipeline over ``documents``; each stage is written as Parquet and reread by the next.

1. language_id: rows whose text has no language, or none that holds LEAST_SHARE of its letters, go.
2. near_duplicates: one document of each component of Jaccard links stays, the one with the smallest id.
3. repeated_passages: bytes of 200-byte strings that start anywhere else too are cut out; texts left empty go.
4. decontamination: documents into which a benchmark passage leaked go.
5. packing: pieces of the documents in sequences of 2048 tokens.

Null texts have no language and go. Rows with a null id can't be told apart by id: stages 2 and 4 keep them. Of rows
equal in id and text one stays. Other columns of ``documents`` pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoprank.llm.common import table, written
from shoprank.llm.decontaminate import leaks
from shoprank.llm.jaccard import jaccard_components
from shoprank.llm.langid import identify
from shoprank.llm.packing import best_fit_pack
from shoprank.llm.suffix_dedup import without_repeats
from shoprank.session import prepare

#: Least share of a text's letters that its language must hold.
LEAST_SHARE = 0.35


def _others(docs: DataFrame) -> Column:
    """Columns that stages only carry, as one, so that their names can't clash with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "lang")]
    return (F.struct(*rest) if rest else F.lit(None).cast("string")).alias("others")


def _unpacked(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from rows made with _others."""
    return out.select(*[F.col(c) if c in ("doc_id", "text", "lang") else F.col(f"others.`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = docs.select("doc_id", "text", "lang", _others(docs))
    out = identify(rows, carry=("doc_id", "text", "lang", "others"))
    return _unpacked(out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    groups = jaccard_components(docs)
    stay = written(spark, groups.where("doc_id = component_id").select("doc_id").distinct(), "pipeline-stay")
    known = docs.where("doc_id IS NOT NULL").join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return known.unionByName(docs.where("doc_id IS NULL")).select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = without_repeats(docs.select("doc_id", "text", "lang", _others(docs)), as_text=True)
    out = out.where("kept <> '' OR n_removed = 0")
    out = out.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    out = _unpacked(out, docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    found = written(spark, found.select("doc_id").where("doc_id IS NOT NULL").distinct(), "pipeline-leaks")
    return docs.join(found, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    prepare(spark)
    return best_fit_pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The stages learn models and cut bytes, which SQL can't express; run() is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied in order to ``documents``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
