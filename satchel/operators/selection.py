"""Which content is selected: types, path overrides, assignments, layered settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from satchel.functions import paths as P


def mode_default(mode: str | Column, is_basic: Column) -> Column:
    """Thorough takes everything, Basic the configured types, None nothing."""
    m = F.lit(mode) if isinstance(mode, str) else mode
    return F.when(m == "Thorough", F.lit(True)).when(m == "Basic", is_basic).otherwise(F.lit(False))


def type_selection(types: DataFrame, choices: DataFrame, mode: str) -> DataFrame:
    """``types`` with ``selected``: a choice made by hand, else the mode decides."""
    manual = choices.filter("manual").select(
        "corpus", "type_kind", "type_value", F.col("selected").alias("__choice"))
    return types.join(manual, ["corpus", "type_kind", "type_value"], "left").withColumn(
        "selected", F.coalesce("__choice", mode_default(mode, F.col("is_basic")))).drop("__choice")


def chain(directory: Column | str) -> Column:
    """A directory and everything above it, root first; the root alone for ``''``."""
    d = F.col(directory) if isinstance(directory, str) else directory
    return F.when(d == "", F.array(F.lit(""))).otherwise(P.ancestors(d, include_self=True))


def _keyed(rules: DataFrame) -> DataFrame:
    return rules.withColumn("key", P.path_key(P.normalize("path"))).drop("path")


def _inherit(files: DataFrame, rules: DataFrame, value: str, rank, directory_rank) -> DataFrame:
    """Add ``value`` from the best rule on the path itself or on a directory above.

    Directories are resolved once each; files then need two equi-joins, on their
    own path and on their parent, and no row is multiplied by its depth.
    """
    keyed = _keyed(rules)
    parents = files.select("corpus", P.path_key(P.parent("path")).alias("__parent")).distinct()
    above = parents.select("corpus", "__parent", F.posexplode(chain("__parent")).alias("depth", "key"))
    by_dir = (
        above.join(keyed, ["corpus", "key"])
        .groupBy("corpus", "__parent")
        .agg(F.max_by(F.struct(F.col(value).alias("v"), directory_rank.alias("r")), directory_rank).alias("__dir"))
    )
    own = keyed.select("corpus", F.col("key").alias("__key"),
                       F.struct(F.col(value).alias("v"), rank.alias("r")).alias("__own"))
    return (
        files.withColumn("__key", P.path_key(P.normalize("path")))
        .withColumn("__parent", P.path_key(P.parent("path")))
        .join(own, ["corpus", "__key"], "left")
        .join(by_dir, ["corpus", "__parent"], "left")
        .drop("__key", "__parent")
    )


def nearest_override(files: DataFrame, overrides: DataFrame, default: Column) -> DataFrame:
    """Add ``included``: the override on the path, else on the nearest directory above.

    ``overrides``: ``corpus, path, included``, one row per path.
    """
    rank = F.lit(0)
    out = _inherit(files, overrides, "included", rank, F.col("depth"))
    return out.withColumn("included", F.coalesce("__own.v", "__dir.v", default)).drop("__own", "__dir")


def latest_assignment(files: DataFrame, assignments: DataFrame, default: str) -> DataFrame:
    """Add ``mode``: the newest assignment on the path or anywhere above it.

    Assigning a directory overrides everything older below it.  ``assignments``:
    ``corpus, path, mode, epoch``.
    """
    newest = (
        assignments.withColumn("path", P.normalize("path"))
        .groupBy("corpus", P.path_key("path").alias("path"))
        .agg(F.max_by("mode", "epoch").alias("mode"), F.max("epoch").alias("epoch"))
    )
    out = _inherit(files, newest, "mode", F.col("epoch"), F.col("epoch"))
    best = F.when(
        F.coalesce(F.col("__own.r"), F.lit(-1)) >= F.coalesce(F.col("__dir.r"), F.lit(-1)), F.col("__own.v")
    ).otherwise(F.col("__dir.v"))
    return out.withColumn("mode", F.coalesce(best, F.lit(default))).drop("__own", "__dir")


def compact_overrides(log: DataFrame) -> DataFrame:
    """The overrides that still count after every directory setting cleared older ones below.

    ``log``: ``corpus, path, is_dir, included, epoch``; the last setting of a path stays
    unless a directory above it was set later.
    """
    last = log.groupBy("corpus", P.path_key(P.normalize("path")).alias("key")).agg(
        F.max_by(F.struct("path", "included", "is_dir"), "epoch").alias("s"), F.max("epoch").alias("epoch"))
    # Only directory settings clear what lies below; root is the empty path.
    above = last.filter("key <> ''").select(
        "corpus", "key", "epoch", F.explode(chain(P.parent("key"))).alias("dir"))
    dirs = last.filter("s.is_dir").select("corpus", F.col("key").alias("dir"), F.col("epoch").alias("dir_epoch"))
    cleared = (
        above.join(dirs, ["corpus", "dir"]).filter("dir_epoch > epoch").select("corpus", "key").distinct()
    )
    return last.join(cleared, ["corpus", "key"], "left_anti").select(
        "corpus", F.col("s.path").alias("path"), F.col("s.included").alias("included"), "epoch")


# ---- layered settings ------------------------------------------------------

# Names an enumerated field may hold; anything else counts as unset.
ENUM_FIELDS = {
    "Theme": ("Graphite", "Blue"),
    "Style": ("Classic", "Plain", "Markdown", "MarkdownAi", "MarkdownCompact", "Xml", "XmlCompact",
              "Json", "JsonCompact", "Docx", "Repomix", "Gitingest"),
    "OutputTarget": ("File", "Clipboard", "Stdout"),
    "LastSelectionMode": ("Basic", "Thorough", "None"),
    "TokenEncoding": ("O200kBase", "Cl100kBase"),
    "SecretScan": ("Off", "Warn", "Redact", "Skip"),
}
CAP_FIELDS = ("MaxFileSizeBytes", "MaxTotalSizeBytes", "MaxTokens")


def settings_overlay(layers: DataFrame) -> DataFrame:
    """The value of each field after overlaying layers, nearest (deepest) last.

    ``layers``: ``corpus, depth, field, value``, value as text, lists as JSON arrays.
    An empty extension list and an undefined enum name count as unset; negative
    caps become 0; an old allowlist in a layer without always-hide patterns moves
    to the safer always-hide list.
    """
    field, value = F.col("field"), F.col("value")
    usable = F.lit(True)
    for name, known in ENUM_FIELDS.items():
        usable = usable & ((field != name) | F.lower(value).isin([k.lower() for k in known]))
    items = F.from_json(value, "array<string>")
    blank_list = F.size(F.filter(items, lambda x: x.isNotNull() & (x != ""))) <= 0
    usable = usable & ~((field == "ExtSet") & blank_list)
    usable = usable & ~((field == "ExcludeRegex") & (F.trim(value) == ""))
    clean = F.when(
        field.isin(*CAP_FIELDS), F.greatest(value.cast("bigint"), F.lit(0)).cast("string")
    ).otherwise(value)
    set_fields = layers.filter(value.isNotNull() & usable).withColumn("value", clean)

    # Old layers: the pair of list fields is read together, per layer.
    names = ("SecretAllowlist", "SensitiveValuePatterns")
    hides = F.max(F.when(field == names[1], value))
    allows = F.max(F.when(field == names[0], value))
    pairs = (
        set_fields.filter(field.isin(*names))
        .groupBy("corpus", "depth")
        .agg(hides.alias("hide"), allows.alias("allow"))
        .select("corpus", "depth", F.explode(F.array(
            F.struct(F.lit(names[1]).alias("field"), F.coalesce("hide", "allow").alias("value")),
            F.struct(F.lit(names[0]).alias("field"),
                     F.when(F.col("hide").isNull(), F.lit("[]")).otherwise(F.col("allow")).alias("value")),
        )).alias("p"))
        .select("corpus", "depth", "p.field", "p.value")
        .filter("value IS NOT NULL")
    )
    rest = set_fields.filter(~field.isin(*names)).select("corpus", "depth", "field", "value")
    return rest.unionByName(pairs).groupBy("corpus", "field").agg(F.max_by("value", "depth").alias("value"))
