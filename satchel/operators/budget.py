"""Byte caps: per file, and in total along the path order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from satchel.functions import content as C, paths as P
from satchel.plans.running import running_total

# A broadcast side larger than this is joined by shuffle instead.
MAX_BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting the rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def file_cap(size: Column | str, per_file: int) -> Column:
    n = F.col(size) if isinstance(size, str) else size
    return F.least(n, F.lit(per_file)) if per_file > 0 else n


def budget_edges(files: DataFrame, want: Column, total: int) -> DataFrame:
    """The file of each corpus at which ``total`` is used up, and what is left for it.

    ``corpus, edge_key, edge_path, left_over``; no row when everything fits.  Only
    keys and sizes are shuffled.
    """
    narrow = files.select("corpus", P.path_key("path").alias("path_key"), "path", want.alias("want"))
    run = running_total(narrow, ["path_key", "path"], F.col("want"), "before", ["corpus"])
    hit = (F.col("before") < total) & (F.col("before") + F.col("want") >= total)
    return run.filter(hit).select(
        "corpus", F.col("path_key").alias("edge_key"), F.col("path").alias("edge_path"),
        (F.lit(total) - F.col("before")).alias("left_over"))


def size_budget(
    files: DataFrame, per_file: int = 0, total: int = 0, weightless: Column | None = None
) -> DataFrame:
    """Add ``allowed`` bytes and ``is_truncated``; ``weightless`` files use up nothing.

    Files fill the total in path order; the file at the edge is cut and later
    ones get nothing.  Because that order is total, one row per corpus (the edge)
    decides every file, so bodies are never sorted or shuffled for it.
    """
    size = F.col("size") if weightless is None else F.when(weightless, F.lit(0)).otherwise(F.col("size"))
    want = file_cap(size, per_file)
    if total <= 0:
        out = files.withColumn("allowed", want)
    else:
        edges = broadcast_if_small(budget_edges(files, want, total))
        key, edge = F.struct(P.path_key("path"), F.col("path")), F.struct("edge_key", "edge_path")
        allowed = (
            F.when(F.col("edge_key").isNull() | (key < edge), want)
            .when(key == edge, F.col("left_over"))
            .otherwise(F.lit(0))
        )
        out = (
            files.join(edges, "corpus", "left")
            .withColumn("allowed", allowed)
            .drop("edge_key", "edge_path", "left_over")
        )
    return out.withColumn("is_truncated", F.col("allowed") < size)


def apply_caps(files: DataFrame, text: str = "content") -> DataFrame:
    """Cut each body to ``allowed`` bytes, on a character boundary."""
    cut = C.capped_text(F.col(text).cast("binary"), F.col("allowed"))
    return files.withColumn("capped", F.when(F.col("is_truncated"), cut).otherwise(F.col(text)))
