"""Sums up the directory tree, and the listings built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from satchel.functions import paths as P
from satchel.operators.selection import chain, nearest_override
from satchel.plans.running import ordinals
from satchel.plans.session import shared_dir


def by_directory(files: DataFrame, /, **sums: Column) -> DataFrame:
    """Sums per directory and everything below it; the root is ``''``.

    Directories that differ in case only are one, spelled as the first of them in byte
    order.  Files are summed per parent first, so only one row per directory is exploded
    over its ancestors, and the root receives one partial sum per task.
    """
    parent = P.parent("path")
    per_parent = files.groupBy("corpus", P.path_key(parent).alias("__parent")).agg(
        F.min(parent).alias("__spelled"), *[F.sum(c).alias(n) for n, c in sums.items()])
    levels = F.explode(F.arrays_zip(chain("__parent").alias("key"), chain("__spelled").alias("directory")))
    return (
        per_parent.select("corpus", levels.alias("__d"), *sums)
        .groupBy("corpus", F.col("__d.key").alias("__key"))
        .agg(F.min("__d.directory").alias("directory"), *[F.sum(n).alias(n) for n in sums])
        .drop("__key")
    )


def contributions(files: DataFrame) -> DataFrame:
    """File count, text bytes and estimated tokens of every directory."""
    return by_directory(
        files, files=F.lit(1), text_bytes=F.col("text_bytes"), tokens=F.col("tokens"))


def share_of_total(rolled: DataFrame) -> DataFrame:
    """Add ``share``: percent of the root's bytes, 0 when the root is empty.

    The sums, one row per directory, are pinned so that the root's share of the
    work is not done twice.
    """
    shared_dir(rolled.sparkSession)
    rolled = rolled.checkpoint()
    root = rolled.filter("directory = ''").select("corpus", F.col("text_bytes").alias("__root"))
    share = F.when(F.col("__root") > 0, F.col("text_bytes") * 100.0 / F.col("__root")).otherwise(F.lit(0.0))
    return rolled.join(root, "corpus").withColumn("share", share).drop("__root")


def token_tree(files: DataFrame) -> DataFrame:
    """Tokens of token-bearing files and of every directory above them."""
    bearing = files.filter("tokens > 0")
    dirs = by_directory(bearing, tokens=F.col("tokens")).filter("directory <> ''")
    return dirs.select(
        "corpus", F.col("directory").alias("path"), F.lit(True).alias("is_dir"), "tokens"
    ).unionByName(bearing.select(
        "corpus", "path", F.lit(False).alias("is_dir"), F.col("tokens").cast("bigint").alias("tokens")))


def tristate(files: DataFrame, directories: DataFrame | None = None, overrides: DataFrame | None = None, default: bool = True) -> DataFrame:
    """Included, Excluded or Mixed per directory, from ``selected`` on files.

    ``directories`` (``corpus, path``) adds those without any file: they show the choice of the
    nearest directory that ``overrides`` (``corpus, path, included``) sets, themselves first, else the default.
    """
    rolled = by_directory(files, files=F.lit(1), chosen=F.col("selected").cast("int"))
    if directories is None:
        return rolled.withColumn("state", state(F.col("chosen"), F.col("files")))
    key = P.path_key(P.normalize("path"))
    named = directories.select("corpus", P.normalize("path").alias("path")).groupBy("corpus", key.alias("__key")).agg(F.min("path").alias("path"))
    bare = named.join(rolled.select("corpus", P.path_key("directory").alias("__key")), ["corpus", "__key"], "left_anti").drop("__key")
    none = F.lit(0).cast("bigint")
    if overrides is None:
        inherited = bare.withColumn("included", F.lit(default))
    else:
        inherited = nearest_override(bare, overrides, F.lit(default))
    empty = inherited.select("corpus", F.col("path").alias("directory"), none.alias("files"), none.alias("chosen"), state(none, none, F.col("included")).alias("state"))
    return rolled.withColumn("state", state(F.col("chosen"), F.col("files"))).unionByName(empty)


def state(chosen: Column, total: Column, inherited: Column | None = None) -> Column:
    """A directory without text shows what it inherits."""
    empty = F.lit(True) if inherited is None else inherited
    return (
        F.when(total == 0, F.when(empty, F.lit("Included")).otherwise(F.lit("Excluded")))
        .when(chosen == 0, F.lit("Excluded"))
        .when(chosen == total, F.lit("Included"))
        .otherwise(F.lit("Mixed"))
    )


def selected_rollup(files: DataFrame) -> DataFrame:
    """Bytes and counts of all, of basic and of selected text, per directory."""
    size = F.col("text_bytes")
    pick = lambda flag, what: F.when(F.col(flag), what).otherwise(F.lit(0))
    return by_directory(
        files,
        files=F.lit(1), text_bytes=size,
        basic_files=pick("is_basic", F.lit(1)), basic_bytes=pick("is_basic", size),
        selected_files=pick("selected", F.lit(1)), selected_bytes=pick("selected", size),
    )


def type_counts(files: DataFrame, extensions, dot_files) -> DataFrame:
    return files.groupBy(
        "corpus", P.type_kind("path").alias("type_kind"), P.type_value("path").alias("type_value")
    ).agg(
        F.count(F.lit(1)).alias("files"),
        F.bool_or(P.is_basic("path", list(extensions), list(dot_files))).alias("is_basic"))


def descendant_counts(entries: DataFrame) -> DataFrame:
    """How many files and directories lie below each directory."""
    is_file = (~F.col("is_dir")).cast("int")
    return by_directory(entries, descendants=F.lit(1), files=is_file)


def children(files: DataFrame) -> DataFrame:
    """Every file and directory as a child of its parent, with its contribution.

    ``parent`` is the directory as it is spelled in the roll-up.
    """
    whole = contributions(files)
    rows = whole.filter("directory <> ''").select(
        "corpus", F.col("directory").alias("path"), F.lit(True).alias("is_dir"), "files", "text_bytes", "tokens")
    leaves = files.select(
        "corpus", "path", F.lit(False).alias("is_dir"), F.lit(1).cast("bigint").alias("files"),
        F.col("text_bytes").cast("bigint").alias("text_bytes"), F.col("tokens").cast("bigint").alias("tokens"))
    both = rows.unionByName(leaves).withColumn("__key", P.path_key(P.parent("path")))
    spelled = whole.select("corpus", P.path_key("directory").alias("__key"), F.col("directory").alias("parent"))
    return both.join(spelled, ["corpus", "__key"]).drop("__key").withColumn("name", P.name("path"))


def _child_keys(df: DataFrame, key: str, descending: bool) -> tuple[DataFrame, list[str]]:
    """Sort columns for children; ties on contribution go by ascending name.

    Descending numbers are negated so that all columns sort the same way.
    """
    if key == "name":
        return df.withColumn("__n", F.upper("name")), ["__n", "name", "path"]
    sign = -1 if descending else 1
    return (
        df.withColumn("__b", F.col("text_bytes") * sign).withColumn("__n", F.upper("name")),
        ["__b", "__n", "name", "path"],
    )


def children_sorted(kids: DataFrame, key: str = "contribution", descending: bool = True) -> DataFrame:
    """Add ``position`` of each child within its parent.

    A directory may hold a third of all files, so positions come from a
    range-partitioned running count, not from a window over the parent.
    """
    keyed, order = _child_keys(kids, key, descending)
    out = ordinals(keyed, order, "position", ["corpus", "parent"])
    if key == "name" and descending:
        sizes = kids.groupBy("corpus", "parent").agg(F.count(F.lit(1)).alias("__size"))
        out = out.join(sizes, ["corpus", "parent"]).withColumn(
            "position", F.col("__size") + 1 - F.col("position")).drop("__size")
    return out.drop("__n", "__b")


def children_page(
    kids: DataFrame, offset: int, count: int, key: str = "contribution", descending: bool = True
) -> DataFrame:
    """One page of the children of every directory.

    The rank limit is applied in each partition before the shuffle.
    """
    if offset < 0 or count < 0:
        raise ValueError("offset and count must not be negative")
    keyed, order = _child_keys(kids, key, descending)
    by = [F.col(c).desc() if key == "name" and descending else F.col(c).asc() for c in order]
    w = Window.partitionBy("corpus", "parent").orderBy(*by)
    ranked = keyed.withColumn("position", F.row_number().over(w))
    return ranked.filter((F.col("position") <= offset + count) & (F.col("position") > offset)).drop("__n", "__b")


def top_files(files: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` files of each corpus with most tokens; ties by path, zero out."""
    w = Window.partitionBy("corpus").orderBy(
        F.col("tokens").desc(), P.path_key("path"), F.col("path"))
    return (
        files.filter("tokens > 0")
        .select("corpus", "path", "tokens")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= n)
    )


def pack_summary(files: DataFrame, max_tokens: int = 0) -> DataFrame:
    """Totals of a run per corpus; the token budget only flags, it never cuts."""
    n = F.size("findings")
    over = (F.col("tokens") > max_tokens) if max_tokens > 0 else F.lit(False)
    return files.groupBy("corpus").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.sum("tokens").alias("tokens"),
        F.sum(n).alias("findings"),
        F.count_if(n > 0).alias("files_with_findings"),
        F.count_if(F.col("content_omitted")).alias("files_omitted"),
    ).withColumn("over_budget", over)
