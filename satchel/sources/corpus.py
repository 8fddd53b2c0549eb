"""Corpora as tables: ``(corpus, path, content, size)``.

``read_corpus`` is the entry for real data.  The ``*_files`` views give the
driver tables the same shape.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from satchel.functions import paths as P
from satchel.sources import tree

# The extension given to a document, by its id.
DOC_EXTENSIONS = (".md", ".txt", ".py", ".json", ".log", "", ".min.js", ".cs")


def read_corpus(
    spark: SparkSession, path: str, format: str = "parquet", corpus: str = "corpus", splits: int = 8
) -> DataFrame:
    """Files as rows.

    ``parquet``/``json``/``orc`` tables already hold ``corpus, path, content``.
    ``binaryFile`` reads a raw folder through Spark's own source, which never sees
    names that start with ``.`` or ``_``; ``tree`` sees every file and also
    yields directory and error rows.  A tree is listed at once, in rounds of tasks; its files are read
    by at least ``splits`` tasks where they hold enough bytes.
    """
    if format == "tree":
        listing = tree.walk(spark, path, corpus)
        held = listing.agg(F.sum("size")).first()[0] or 0
        return tree.read_files(listing, path, max(1, min(tree.TASK_BYTES, held // splits + tree.OPEN_BYTES)))
    if format == "binaryFile":
        root = path.rstrip("/") + "/"
        raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        local = F.regexp_replace("path", "^file:/*", "/")
        return raw.select(
            F.lit(corpus).alias("corpus"),
            F.substring_index(local, root, -1).alias("path"),
            F.col("length").alias("size"),
            F.lit(False).alias("is_dir"),
            "content",
            F.lit(None).cast("string").alias("error"),
        )
    return spark.read.format(format).load(path)


def spread(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Give the rows of a few input files (of ``source``) to all cores, before work that is done per body.

    A table of at least as many files as there are cores is left alone, so no body of a
    large one is shuffled for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len((source or df).inputFiles()) < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path(doc_id: Column, source: Column, lang: Column) -> Column:
    ext = F.element_at(
        F.array(*[F.lit(e) for e in DOC_EXTENSIONS]), (doc_id % len(DOC_EXTENSIONS) + 1).cast("int"))
    return F.concat(
        source, F.lit("/"), lang, F.lit("/doc-"), F.lpad(doc_id.cast("string"), 6, "0"), ext)


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return as_files(docs, "docs", doc_path(F.col("doc_id"), F.col("source"), F.col("lang")), F.col("text"), "doc_id")


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by URL path; several pages may share one path."""
    bare = F.regexp_replace(F.regexp_replace("url", "^[a-zA-Z]+://", ""), "[?#].*$", "")
    return as_files(table(spark, sf_dir, "pages"), "pages", P.normalize(bare), F.col("html"), "page_id")


def conv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(
        F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("/turn-"),
        F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit("-"), F.col("role"), F.lit(".txt"))
    return as_files(table(spark, sf_dir, "conversations"), "talks", path, F.col("text"))


def as_files(df: DataFrame, corpus: str, path: Column, content: Column, *keep: str) -> DataFrame:
    return df.select(
        F.lit(corpus).alias("corpus"),
        path.alias("path"),
        content.alias("content"),
        F.octet_length(content).cast("bigint").alias("size"),
        *keep,
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per event, each touching one path."""
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("corpus"),
        F.col("event_id").alias("commit_id"),
        "ts",
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"), F.lit(".txt")).alias("path"),
    )
