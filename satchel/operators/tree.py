"""Directory trees drawn one row per line.

A line needs to know, for every directory above it, whether that directory is
the last of its siblings.  Directories get their prefix from a join over their
few ancestors; files then take the prefix of their parent in one equi-join.
Directories that differ in case only are one line, spelled as the first of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from satchel.functions import paths as P
from satchel.operators.selection import chain


def _last_keys(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("corpus", F.col("__parent").alias("__dir")).agg(F.max("key").alias("last_key"))


def one_spelling(entries: DataFrame) -> DataFrame:
    """Each directory once, whatever its cases: ``corpus, path, is_dir``; files stay as they are."""
    rows = entries.select("corpus", "path", "is_dir")
    dirs = rows.filter("is_dir").groupBy("corpus", P.path_key("path").alias("__key")).agg(F.min("path").alias("path"))
    return rows.filter(~F.col("is_dir")).unionByName(dirs.select("corpus", "path", F.lit(True).alias("is_dir")))


def placed() -> Column:
    """A path whose directories are spelled alike in all rows: what sort keys are made of."""
    above = P.path_key(P.parent("path"))
    own = F.when(F.col("is_dir"), P.path_key(P.name("path"))).otherwise(P.name("path"))
    return F.when(above == "", own).otherwise(F.concat(above, F.lit("/"), own))


def box_lines(nodes: DataFrame, key: Column, label: Column, line_end: str, indent: str = "") -> DataFrame:
    """``corpus, path, key, line`` for every node.

    ``nodes``: ``corpus, path, is_dir``, directories once whatever their cases, and whatever ``label``
    reads; ``key`` sorts the whole tree and is unique.
    """
    keyed = nodes.withColumn("key", key).withColumn("__parent", P.path_key(P.parent("path")))
    last = _last_keys(keyed)
    dirs = keyed.filter("is_dir").select("corpus", P.path_key("path").alias("path"), "key", "__parent")
    flagged = dirs.join(
        last.withColumnRenamed("__dir", "__parent"), ["corpus", "__parent"]
    ).select("corpus", F.col("path").alias("__up"), (F.col("key") == F.col("last_key")).alias("is_last"))
    bar = F.when(F.col("is_last"), F.lit("    ")).otherwise(F.lit("│   "))
    # A path has few levels, so the list per directory is short.
    prefixes = (
        dirs.select("corpus", F.col("path").alias("__dir"), F.posexplode(chain("path")).alias("level", "__up"))
        .filter("level > 0")
        .join(flagged, ["corpus", "__up"])
        .groupBy("corpus", "__dir")
        .agg(F.array_sort(F.collect_list(F.struct("level", bar.alias("bar")))).alias("bars"))
        .select("corpus", "__dir", F.array_join(F.col("bars.bar"), "").alias("prefix"))
    )
    parents = last.join(prefixes, ["corpus", "__dir"], "left").select(
        "corpus", F.col("__dir").alias("__parent"), "last_key",
        F.concat(F.lit(indent), F.coalesce("prefix", F.lit(""))).alias("prefix"))
    branch = F.when(F.col("key") == F.col("last_key"), F.lit("└── ")).otherwise(F.lit("├── "))
    return keyed.join(parents, ["corpus", "__parent"]).select(
        "corpus", "path", "key", F.concat("prefix", branch, label, F.lit(line_end)).alias("line"))


def node_label() -> Column:
    return F.concat(P.name("path"), F.when(F.col("is_dir"), F.lit("/")).otherwise(F.lit("")))


def structure(entries: DataFrame, line_end: str = "\r\n") -> DataFrame:
    """Directories first, then names ignoring case."""
    return box_lines(one_spelling(entries), P.tree_key(placed(), "is_dir"), node_label(), line_end)


def token_lines(nodes: DataFrame, line_end: str = "\r\n") -> DataFrame:
    """The same order, each line with its token count."""
    label = F.concat(node_label(), F.lit("  ("), P.thousands("tokens"), F.lit(" tokens)"))
    return box_lines(nodes, P.tree_key(placed(), "is_dir"), label, line_end)


def digest_lines(entries: DataFrame, line_end: str = "\n") -> DataFrame:
    """README, files, hidden files, directories, hidden directories; below a root line."""
    return box_lines(one_spelling(entries), P.digest_key(placed(), "is_dir"), node_label(), line_end, indent="    ")


def indented(entries: DataFrame) -> DataFrame:
    """Two spaces per level, directories first, locale order."""
    line = F.concat(F.repeat(F.lit("  "), P.depth("path") - 1), node_label(), F.lit("\n"))
    return one_spelling(entries).select("corpus", "path", P.locale_key(placed(), "is_dir").alias("key"), line.alias("line"))
