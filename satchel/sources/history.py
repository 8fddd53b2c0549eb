"""Change sets between two snapshots, and change counts from a commit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from satchel.functions.paths import path_key
from satchel.plans.running import ordinals
from satchel.plans.session import stage


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(corpus, path, status, previous_path)`` for every path that differs.

    A path that is new while its exact content vanished elsewhere is a rename; the
    destination is reported.  Equal contents are paired one to one in the order of
    their paths, and what is left over is added or deleted.  Contents meet as
    hashes; places in that order are counted without a window over one content, so
    a content shared by very many files does not make a hot group.
    """

    def narrow(df: DataFrame, side: str) -> DataFrame:
        return df.select(
            "corpus",
            path_key("path").alias("path_key"),
            F.col("path").alias(f"{side}_path"),
            F.sha2(F.col("content").cast("binary"), 256).alias(f"{side}_hash"),
        )

    # Hashed once; what follows reads a narrow table.
    both = stage(
        narrow(before, "old").join(narrow(after, "new"), ["corpus", "path_key"], "full")
        .filter(~F.col("old_hash").eqNullSafe(F.col("new_hash"))), "changes")

    def placed(side: str, other: str) -> DataFrame:
        lone = both.filter(F.col(f"{other}_path").isNull()).select(
            "corpus", F.col(f"{side}_hash").alias("hash"), F.col(f"{side}_path").alias(f"{side}_path"))
        return ordinals(lone, [f"{side}_path"], "place", ["corpus", "hash"])

    pairs = placed("new", "old").join(placed("old", "new"), ["corpus", "hash", "place"], "full")
    status = F.when(F.col("old_path").isNull(), "added").when(F.col("new_path").isNull(), "deleted").otherwise("renamed")
    moved = pairs.select(
        "corpus", F.coalesce("new_path", "old_path").alias("path"), status.alias("status"),
        F.when(status == "renamed", F.col("old_path")).alias("previous_path"))
    modified = both.filter("old_path IS NOT NULL AND new_path IS NOT NULL").select(
        "corpus", F.col("new_path").alias("path"), F.lit("modified").alias("status"),
        F.lit(None).cast("string").alias("previous_path"))
    return modified.unionByName(moved)


def last_commits(log: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` commits of each corpus.

    The rank filter lets Spark cut each partition to ``n`` rows before the shuffle.
    """
    w = Window.partitionBy("corpus").orderBy(F.col("ts").desc(), F.col("commit_id").desc())
    commits = log.groupBy("corpus", "commit_id").agg(F.max("ts").alias("ts"))
    return commits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def change_counts(log: DataFrame, n: int = 100) -> DataFrame:
    """How many of the last ``n`` commits touched each path, ignoring case."""
    recent = last_commits(log, n).select("corpus", "commit_id")
    return (
        log.join(recent, ["corpus", "commit_id"], "left_semi")
        .groupBy("corpus", path_key("path").alias("path_key"))
        .agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("changes"))
    )
