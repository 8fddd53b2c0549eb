"""The inventory of a corpus: directories, pruning, change filters, diagnostics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from satchel.functions import content as C, paths as P, rules as R
from satchel.functions.rules import PathRule


def once(df: DataFrame) -> DataFrame:
    """A path counts once per corpus, ignoring case; the first spelling in byte order stays.

    For reviews and streams.  The spelling is chosen on paths; rows follow by a join.
    Rows that repeat a path exactly are reduced to one of them.
    """
    first = df.groupBy("corpus", P.path_key("path")).agg(F.min("path").alias("path")).select("corpus", "path")
    return df.join(first, ["corpus", "path"], "left_semi").dropDuplicates(["corpus", "path"])


def directories(files: DataFrame) -> DataFrame:
    """Every directory above a file, root excluded, once.

    Parents are made distinct before they are exploded: the number of rows that
    get exploded is the number of directories, not of files.
    """
    parents = files.select("corpus", P.parent("path").alias("path")).distinct()
    return (
        parents.filter("path <> ''")
        .select("corpus", F.explode(P.ancestors("path", include_self=True)).alias("path"))
        .filter("path <> ''")
        .distinct()
    )


def inventory(files: DataFrame) -> DataFrame:
    """Files and the directories above them: ``corpus, path, is_dir, size``."""
    size = F.col("size") if "size" in files.columns else F.octet_length("content").cast("bigint")
    rows = files.select("corpus", "path", F.lit(False).alias("is_dir"), size.alias("size"))
    dirs = directories(files).select(
        "corpus", "path", F.lit(True).alias("is_dir"), F.lit(0).cast("bigint").alias("size"))
    return rows.unionByName(dirs)


#: Spellings of the names of ignore files that are looked for by value.
MOST_SPELLINGS = 100


def rule_files(corpus: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The ignore files of raw rows, with their paths normalised.

    Which rows these are is found by paths alone, so only they are read with their content.
    """
    wanted = P.normalize("path").isin(*names)
    spelled = [r["path"] for r in corpus.filter(wanted).select("path").distinct().limit(MOST_SPELLINGS + 1).collect()]
    rows = corpus.filter(F.col("path").isin(spelled) if len(spelled) <= MOST_SPELLINGS else wanted)
    return rows.withColumn("path", P.normalize("path"))


def rule_lines(
    corpus: DataFrame, names: tuple[str, ...], extra: tuple[str, ...] = (), corpora: DataFrame | None = None
) -> DataFrame:
    """Rule lines of each corpus, in the order they apply.

    Layers: each root ignore file in ``names``, then configured globs, which all ``corpora`` get (by
    default those of ``corpus``).  Comments and blanks go; order stays.
    """
    layer = F.coalesce(*[F.when(F.col("path") == n, F.lit(i)) for i, n in enumerate(names)])
    from_files = (
        corpus.filter(F.col("path").isin(*names) & F.col("content").isNotNull())
        .select(
            "corpus", layer.alias("layer"),
            F.posexplode(F.split(F.col("content").cast("string"), "\r\n|\n|\r")).alias("ordinal", "line"))
    )
    if extra:
        config = (corpus if corpora is None else corpora).select("corpus").distinct().select(
            "corpus", F.lit(len(names)).alias("layer"),
            F.posexplode(F.array(*[F.lit(x) for x in extra])).alias("ordinal", "line"))
        from_files = from_files.unionByName(config)
    pattern = F.regexp_replace("line", r"\s+$", "")
    return from_files.select("corpus", "layer", "ordinal", pattern.alias("pattern")).filter(
        (F.col("pattern") != "") & ~F.startswith("pattern", F.lit("#")))


def pruned_directories(
    listing: DataFrame, rules: list[PathRule], exclude_regex: str = R.DEFAULT_EXCLUDE_REGEX
) -> DataFrame:
    """Directories that are excluded or lie below an excluded one.

    Each distinct directory is judged once together with those above it, without
    another join; rules never meet a file here.
    """
    out = R.excluded_with_ancestors(F.col("path"), F.lit(True), rules, exclude_regex, R.in_corpus)
    return listing.filter("is_dir").filter(out).select("corpus", F.col("path").alias("__parent"))


def outside(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose parent is not pruned; a re-including rule cannot revive them."""
    return (
        rows.withColumn("__parent", P.parent("path"))
        .join(gone, ["corpus", "__parent"], "left_anti")
        .drop("__parent")
    )


def prune(
    entries: DataFrame, rules: list[PathRule], exclude_regex: str = R.DEFAULT_EXCLUDE_REGEX
) -> DataFrame:
    """Exclusion by one rule list for all corpora; ``entries`` as from ``inventory``."""
    own = R.excluded(F.col("path"), F.col("is_dir"), rules, exclude_regex, R.in_corpus(F.col("path")))
    return outside(entries.filter(~own), pruned_directories(entries, rules, exclude_regex))


def prune_rowwise(
    entries: DataFrame, rules: list[PathRule], exclude_regex: str = R.DEFAULT_EXCLUDE_REGEX
) -> DataFrame:
    """The same result without a shuffle; for streams and for shallow trees."""
    return entries.filter(
        ~R.excluded_with_ancestors(F.col("path"), F.col("is_dir"), rules, exclude_regex, R.in_corpus))


@F.pandas_udf(R.RULE_MAPS)
def _compiled(lists: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([R.rule_maps(R.compile_rules(lines)) for lines in lists], columns=["names", "suffixes", "paths", "rest", "every"])


def rule_lists(lines: DataFrame) -> DataFrame:
    """One row per corpus with its compiled rules: look-up maps and the regexes of the rest.

    The rules of a corpus come out of its own few ignore files, so a list is as
    small as those files.  A malformed rule fails the job.
    """
    ordered = F.sort_array(F.collect_list(F.struct("layer", "ordinal", "pattern")))
    return lines.groupBy("corpus").agg(F.transform(ordered, lambda x: x["pattern"]).alias("lines")).select("corpus", _compiled("lines").alias("rules"))


def judged_by_lists(rows: DataFrame, lists: DataFrame, exclude_regex: str) -> DataFrame:
    """Add ``__out``; each row meets the rule list of its corpus in one row."""
    own = R.legacy_excluded(F.col("path"), exclude_regex, R.in_corpus(F.col("path"))) | R.judged(F.col("path"), F.col("is_dir"), F.col("rules"))
    return rows.join(lists, "corpus", "left").withColumn("__out", own).drop("rules")


def pruned_directories_by_lists(listing: DataFrame, lists: DataFrame, exclude_regex: str) -> DataFrame:
    """As ``pruned_directories``; excluded directories are spread to those below by a join."""
    dirs = judged_by_lists(listing.filter("is_dir"), lists, exclude_regex)
    bad = dirs.filter("__out").select("corpus", F.col("path").alias("above"))
    return (
        dirs.select("corpus", "path", F.explode(P.ancestors("path", include_self=True)).alias("above"))
        .join(bad, ["corpus", "above"], "left_semi")
        .select("corpus", F.col("path").alias("__parent"))
        .distinct()
    )


def prune_by_rule_table(
    entries: DataFrame, lists: DataFrame, exclude_regex: str = R.DEFAULT_EXCLUDE_REGEX
) -> DataFrame:
    """Exclusion when every corpus brings its own rules (see ``rule_lists``)."""
    kept = judged_by_lists(entries, lists, exclude_regex).filter("NOT __out").drop("__out")
    return outside(kept, pruned_directories_by_lists(entries, lists, exclude_regex))


def changed_only(
    entries: DataFrame, changes: DataFrame | None, holders: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Changed files and the directories above them; no change set means no filter.

    ``holders`` names the changed files whose directories stay; by default all do.
    """
    if changes is None:
        return entries
    keys = changes.select("corpus", P.path_key("path").alias("path_key")).distinct()
    keyed = entries.withColumn("path_key", P.path_key("path"))
    files = keyed.filter(~F.col("is_dir")).join(keys, ["corpus", "path_key"], "left_semi")
    above = (
        directories((holders(files) if holders else files).select("corpus", "path"))
        .select("corpus", P.path_key("path").alias("path_key"))
        .distinct()
    )
    dirs = keyed.filter("is_dir").join(above, ["corpus", "path_key"], "left_semi")
    return files.unionByName(dirs).drop("path_key")


def single_item(
    files: DataFrame,
    path: Column,
    rules: list[PathRule],
    extensions: tuple[str, ...],
    dot_files: tuple[str, ...],
    include: list[PathRule] = [],
    exclude_regex: str = R.DEFAULT_EXCLUDE_REGEX,
    changes: DataFrame | None = None,
) -> DataFrame:
    """One chosen file; ``skip_reason`` is null, ``unchanged`` or ``not legible``.

    The minified-name filter does not apply to a file picked by hand.
    """
    chosen = files.filter(F.col("path") == path)
    p = F.col("path")
    legible = (
        P.is_legible(p, extensions, dot_files)
        & ~R.excluded(p, F.lit(False), rules, exclude_regex)
        & R.included(p, include)
    )
    if changes is None:
        changed = F.lit(True)
    else:
        keys = changes.select("corpus", P.path_key("path").alias("path_key")).distinct()
        chosen = (
            chosen.withColumn("path_key", P.path_key("path"))
            .join(keys.withColumn("__changed", F.lit(True)), ["corpus", "path_key"], "left")
            .drop("path_key")
        )
        changed = F.col("__changed").isNotNull()
    reason = F.when(~legible, "not legible").when(~changed, "unchanged")
    return chosen.withColumn("skip_reason", reason).drop("__changed")


def unreadable(decoded: DataFrame) -> DataFrame:
    """Files that are neither binary nor decodable: ``corpus, path, reason``."""
    reason = F.concat(F.lit("could not be decoded as "), F.col("encoding"))
    return decoded.filter(~C.is_binary("content") & F.col("text").isNull()).select(
        "corpus", "path", reason.alias("reason"))


def with_text(paths: DataFrame, texts: DataFrame) -> DataFrame:
    """All inventory paths with the weight of their text; others weigh nothing."""
    weights = texts.select("corpus", P.path_key("path").alias("path_key"), "text_bytes")
    return (
        paths.withColumn("path_key", P.path_key("path"))
        .join(weights, ["corpus", "path_key"], "left")
        .withColumn("text_bytes", F.coalesce("text_bytes", F.lit(0)))
        .withColumn("tokens", P.estimate_tokens("text_bytes"))
        .drop("path_key")
    )
