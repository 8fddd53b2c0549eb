"""Five stages from raw documents to token ids.

Every stage takes all that its predecessor kept; all but the last return the columns of
``documents``.  Rows with a null text are empty documents: the base rules reject them.
Rows with a null doc_id go through, but hold nothing against other documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from satchel.llm import bpe, decontaminate, lines, quality, setsketch
from satchel.llm.common import fresh
from satchel.llm.queries import vocabulary_path
from satchel.plans.session import ship_package, stage

#: SQL has neither the fitted trees nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the base rules or the trees reject."""
    ship_package(spark)
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of five or more documents stay in the largest doc_id only; ``n_chars`` follows the text."""
    ship_package(spark)
    kept = lines.without_repeats(docs)
    if "n_chars" in kept.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-duplicates (similarity 0.8 or more)."""
    ship_package(spark)
    return setsketch.keep_one(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain a benchmark item."""
    ship_package(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, the token ids and the digests of ids and decoded text."""
    ship_package(spark)
    file = bpe.load(spark, vocabulary_path())
    at = fresh("v", docs)
    return docs.withColumn(at, bpe.digests(F.col("text"), file, with_ids=True)).select("doc_id", f"{at}.*")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe_tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
