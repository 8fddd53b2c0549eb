"""The registered queries, over the driver tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from satchel.functions import content as C, paths as P, rules as R, spans as S, text as X
from satchel.operators import budget, inventory as I, layouts as L, rollup, selection, sensitive as V, tree
from satchel.plans.export import Selection, prepare
from satchel.plans.presets import GITINGEST_IGNORE, REPOMIX_IGNORE
from satchel.plans.running import ordinals
from satchel.plans.session import stage
from satchel.plans.settings import DEFAULT_DOT_FILES, DEFAULT_EXTENSIONS, RunSettings
from satchel.sources import corpus as K, history as H
from satchel.streaming import progressive as T

EXT, DOTS = list(DEFAULT_EXTENSIONS), list(DEFAULT_DOT_FILES)

# Settings the queries run with; the check SQL states the same values.
EXCLUDE = ("*.log", "*.min.js", "/src1", "!src1/en/*.md", "src2/**/doc-*.py", "[Ss]rc3/", "!src3/en/*.txt")
PRUNE = ("src3/", "/src4/de", "*.min.js", "!src3/en/*.md")
INCLUDE = ("src1*/**", "**/fr/*.md")
LEGACY = r"\\src1\d\\(de|fr)\\"
HIDE = ("Licen[sc]e", "worthless [a-z]{3,}")
ALLOW = ("@mail1[.]", "^4[0-9]*7")
FILE_CAP, TOTAL_CAP = 4096, 1_000_000
MAX_TOKENS = 50_000


def _weighed(files: DataFrame) -> DataFrame:
    return files.withColumn("text_bytes", F.col("size")).withColumn("tokens", P.estimate_tokens("size"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    return _weighed(K.doc_files(spark, d))


def doc_paths(spark: SparkSession, d: str) -> DataFrame:
    """Documents without their bodies: only path columns and sizes are read on."""
    return docs(spark, d).drop("content")


def scanned(spark: SparkSession, d: str, settings: RunSettings = RunSettings()) -> DataFrame:
    return V.scan(K.spread(docs(spark, d)), settings)


def findings(spark: SparkSession, d: str, settings: RunSettings = RunSettings()) -> DataFrame:
    return V.finding_rows(scanned(spark, d, settings), settings)


def blobs(spark: SparkSession, d: str) -> DataFrame:
    """Documents re-encoded by type, to exercise classification and decoding."""
    text, kind = F.col("content"), F.col("doc_id") % 8
    mark = lambda h: F.unhex(F.lit(h))
    utf8 = text.cast("binary")
    content = (
        F.when(kind == 1, F.concat(mark("EFBBBF"), utf8))
        .when(kind == 2, F.encode(F.concat(F.lit("# coding: latin-1\n"), text), "ISO-8859-1"))
        .when(kind == 3, F.concat(mark("FFFE"), F.encode(text, "UTF-16LE")))
        .when(kind == 4, F.concat(mark("FEFF"), F.encode(text, "UTF-16BE")))
        .when(kind == 5, F.concat(utf8, mark("00")))
        .when(kind == 6, F.concat(mark("0000FEFF"), F.encode(text, "UTF-32")))
        .when(kind == 7, F.encode(text, "ISO-8859-1"))
        .otherwise(utf8)
    )
    return K.spread(docs(spark, d)).select("corpus", "path", content.alias("content"))


# ---- sources -----------------------------------------------------------------


def q_inventory(spark, d):
    return I.inventory(doc_paths(spark, d))


def q_single_item(spark, d):
    """Every file judged as if it were the chosen one."""
    changes = doc_paths(spark, d).join(K.table(spark, d, "labels"), "doc_id").select("corpus", "path")
    chosen = I.single_item(
        doc_paths(spark, d), F.col("path"), R.compile_rules(EXCLUDE), EXT, DOTS, changes=changes)
    return chosen.select("path", "skip_reason")


def _after(spark, d) -> DataFrame:
    """A later snapshot: toxic documents gone, poor ones edited, German ones moved."""
    labels = K.table(spark, d, "labels")
    return (
        docs(spark, d).join(labels, "doc_id", "left").filter(F.coalesce("toxic", F.lit(0)) == 0)
        .select(
            "corpus",
            F.when(F.col("path").contains("/de/"), F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path")).alias("path"),
            F.when(F.col("quality") == 0, F.concat("content", F.lit("\n"))).otherwise(F.col("content")).alias("content"))
        .unionByName(K.conv_files(spark, d).select(F.lit("docs").alias("corpus"), "path", "content"))
    )


def q_snapshot_changes(spark, d):
    return H.snapshot_changes(docs(spark, d), _after(spark, d))


def q_change_counts(spark, d):
    return H.change_counts(K.change_log(spark, d), 100).select("corpus", "path", "changes")


def q_last_commits(spark, d):
    return H.last_commits(K.change_log(spark, d), 100).select("corpus", "commit_id", F.col("rank").cast("bigint").alias("rank"))


def q_rule_lines(spark, d):
    """Turns read as ignore files: what a user says, then what an assistant says."""
    talks = K.table(spark, d, "conversations").select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("corpus"),
        F.when(F.col("role") == "user", ".gitignore").otherwise(".packignore").alias("path"),
        F.col("text").alias("content"))
    return I.rule_lines(talks, (".gitignore", ".packignore")).select(
        "corpus", F.col("layer").cast("bigint").alias("layer"), F.col("ordinal").cast("bigint").alias("ordinal"), "pattern")


def q_unreadable(spark, d):
    return I.unreadable(C.decode(blobs(spark, d)))


# ---- filters -------------------------------------------------------------------


def q_path_normalize(spark, d):
    return K.table(spark, d, "pages").select(
        "page_id", P.normalize(F.translate("url", "/", "\\")).alias("path"))


def q_path_exclusion(spark, d):
    rules = R.compile_rules(EXCLUDE)
    return doc_paths(spark, d).select("path", R.ignored(F.col("path"), F.lit(False), rules).alias("excluded"))


def q_pruned_tree(spark, d):
    return I.prune(I.inventory(doc_paths(spark, d)), R.compile_rules(PRUNE)).select("corpus", "path", "is_dir")


def q_pruned_rowwise(spark, d):
    """The shuffle-free form of the same pruning."""
    return I.prune_rowwise(I.inventory(doc_paths(spark, d)), R.compile_rules(PRUNE)).select("corpus", "path", "is_dir")


def q_pruned_by_rules(spark, d):
    """Every source is a corpus with its own ignore file: its language folder of its newest document."""
    files = doc_paths(spark, d).select(
        F.substring_index("path", "/", 1).alias("corpus"), F.regexp_replace("path", "^[^/]+/", "").alias("path"),
        "size", "doc_id")
    ignore = files.groupBy("corpus").agg(F.max_by(P.parent("path"), "doc_id").alias("lang")).select(
        "corpus", F.lit(".gitignore").alias("path"),
        F.concat(F.lit("# generated\n/"), F.col("lang"), F.lit("/\n*.log\n!doc-*1.log\n")).alias("content"))
    lists = I.rule_lists(I.rule_lines(ignore, (".gitignore",)))
    return I.prune_by_rule_table(I.inventory(files), lists).select("corpus", "path", "is_dir")


def q_legacy_exclude(spark, d):
    p = F.col("path")
    full = F.concat(F.lit("C:/"), F.col("corpus"), F.lit("/build/"), p)
    return doc_paths(spark, d).select(
        "path", R.legacy_excluded(p, R.DEFAULT_EXCLUDE_REGEX, full).alias("by_default"),
        R.legacy_excluded(p, LEGACY, full).alias("by_user"))


def q_include_globs(spark, d):
    rules = R.compile_rules(INCLUDE)
    return doc_paths(spark, d).select("path", R.included(F.col("path"), rules).alias("content_eligible"))


def q_legible_files(spark, d):
    return doc_paths(spark, d).filter(P.is_legible("path", EXT, DOTS) & ~P.is_minified("path")).select("path", "size")


def q_file_type(spark, d):
    return doc_paths(spark, d).select(
        "path", P.type_kind("path").alias("type_kind"), P.type_value("path").alias("type_value"),
        P.is_basic("path", EXT, DOTS).alias("is_basic"))


def q_self_output(spark, d):
    """The pack being written never packs itself: the largest path stands for it."""
    out = doc_paths(spark, d).agg(F.max("path")).first()[0]
    return doc_paths(spark, d).filter(P.path_key("path") != out.upper()).select("path")


def q_type_selection(spark, d):
    """Types chosen by hand where labelled documents are mostly good, else by the mode."""
    types = rollup.type_counts(doc_paths(spark, d), EXT, DOTS)
    labelled = doc_paths(spark, d).join(K.table(spark, d, "labels"), "doc_id")
    choices = labelled.groupBy("corpus", P.type_kind("path").alias("type_kind"), P.type_value("path").alias("type_value")).agg(
        (F.avg("quality") >= 0.7).alias("selected"), (F.sum("toxic") > 3).alias("manual"))
    return selection.type_selection(types, choices, "Basic")


def q_binary_flag(spark, d):
    return blobs(spark, d).select("path", C.is_binary("content").alias("is_binary"))


def q_text_like(spark, d):
    return blobs(spark, d).select("path", C.text_like("content", "path").alias("kind"))


def _overrides(spark, d) -> DataFrame:
    """Choices on three levels: sources, languages, single labelled documents."""
    paths = doc_paths(spark, d)
    top = paths.groupBy("corpus", F.substring_index("path", "/", 1).alias("path")).agg(
        (F.count(F.lit(1)) % 2 == 0).alias("included"))
    mid = paths.filter(~F.col("path").contains("/en/")).groupBy("corpus", P.parent("path").alias("path")).agg(
        (F.max("size") > 6000).alias("included"))
    leaf = paths.join(K.table(spark, d, "labels"), "doc_id").select("corpus", "path", (F.col("quality") == 1).alias("included"))
    return top.unionByName(mid).unionByName(leaf)


def q_nearest_override(spark, d):
    return selection.nearest_override(doc_paths(spark, d), _overrides(spark, d), F.lit(True)).select("path", "included")


def _assignments(spark, d) -> DataFrame:
    paths = doc_paths(spark, d)
    mode = lambda c: F.when(c % 3 == 0, "Basic").when(c % 3 == 1, "Thorough").otherwise("None")
    top = paths.groupBy("corpus", F.substring_index("path", "/", 1).alias("path")).agg(F.max("doc_id").alias("n"))
    mid = paths.groupBy("corpus", P.parent("path").alias("path")).agg(F.min("doc_id").alias("n"))
    leaf = paths.join(K.table(spark, d, "labels"), "doc_id").select("corpus", "path", F.col("doc_id").alias("n"))
    steps = top.withColumn("epoch", F.col("n") * 4).unionByName(mid.withColumn("epoch", F.col("n") * 16 + 1)).unionByName(
        leaf.withColumn("epoch", F.col("n") * 4 + 2))
    return steps.select("corpus", "path", mode(F.col("n")).alias("mode"), "epoch")


def q_latest_assignment(spark, d):
    return selection.latest_assignment(doc_paths(spark, d), _assignments(spark, d), "Basic").select("path", "mode")


def q_compact_overrides(spark, d):
    """A log of choices, folders included; only those still in force remain."""
    log = _assignments(spark, d).select(
        "corpus", "path", (~P.name("path").contains("doc-")).alias("is_dir"), (F.col("mode") == "Basic").alias("included"), "epoch")
    return selection.compact_overrides(log)


def q_changed_only(spark, d):
    entries = I.inventory(doc_paths(spark, d))
    changes = doc_paths(spark, d).join(K.table(spark, d, "labels").filter("quality = 0"), "doc_id").select("corpus", "path")
    return I.changed_only(entries, changes).select("corpus", "path", "is_dir")


def q_subtree(spark, d):
    return doc_paths(spark, d).filter(P.under("path", "SRC1/en/")).select("path", "size")


def _page_inventory(spark, d) -> DataFrame:
    """Pages re-rooted: the last path part picks well-known folder and file names."""
    pages = K.page_files(spark, d)
    folder = F.element_at(F.array(*[F.lit(x) for x in (
        "src", "node_modules", "build", "sub/dist", "dist", "vendor", "bin", "venv", "lib/.venv", "docs")]),
        (F.col("page_id") % 10 + 1).cast("int"))
    file = F.element_at(F.array(*[F.lit(x) for x in (
        "a.py", "b.pyc", "c.log", "package-lock.json", "d.rs.bk", ".env", "LICENSE", "e.min.js")]),
        (F.floor(F.col("page_id") / 10) % 8 + 1).cast("int"))
    path = F.concat(folder, F.lit("/p"), F.col("page_id").cast("string"), F.lit("/"), file)
    return I.inventory(pages.select("corpus", path.alias("path"), "size"))


def q_preset_repomix(spark, d):
    return I.prune(_page_inventory(spark, d), R.compile_rules(REPOMIX_IGNORE), R.NO_EXCLUDE_REGEX).select("path", "is_dir")


def q_preset_gitingest(spark, d):
    return I.prune(_page_inventory(spark, d), R.compile_rules(GITINGEST_IGNORE), R.NO_EXCLUDE_REGEX).select("path", "is_dir")


# ---- joins and sets ------------------------------------------------------------


def q_inventory_with_text(spark, d):
    texts = docs(spark, d).filter(~P.extension("path").isin(".log", "")).select("corpus", "path", "text_bytes")
    return I.with_text(I.inventory(doc_paths(spark, d)), texts).select("path", "is_dir", "text_bytes", "tokens")


def q_once(spark, d):
    """Several pages share a URL path; each path counts once."""
    return I.once(K.page_files(spark, d)).select("corpus", P.path_key("path").alias("path_key"))


def q_allowlist(spark, d):
    return _rows(findings(spark, d, RunSettings(allow_patterns=ALLOW)))


def q_settings_overlay(spark, d):
    """Events as setting layers: the user is the corpus, the event the depth."""
    n = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    field = (
        F.when(kind == "click", "Style").when(kind == "view", "MaxTotalSizeBytes").when(kind == "signup", "ExtSet")
        .when(kind == "purchase", "SecretAllowlist").otherwise(F.when(n % 9 == 0, "SensitiveValuePatterns").otherwise("DetectBinary")))
    value = (
        F.when(kind == "click", F.when(n % 4 == 0, "Fancy").when(n % 4 == 1, "json").otherwise("Plain"))
        .when(kind == "view", (n - 50).cast("string"))
        .when(kind == "signup", F.when(n % 3 == 0, "[]").otherwise(F.concat(F.lit('[".e'), n.cast("string"), F.lit('"]'))))
        .when(kind == "purchase", F.concat(F.lit('["a'), n.cast("string"), F.lit('"]')))
        .otherwise(F.when(n % 9 == 0, F.concat(F.lit('["h'), n.cast("string"), F.lit('"]'))).otherwise((n % 2 == 0).cast("string"))))
    layers = K.table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("corpus"), F.col("event_id").alias("depth"),
        field.alias("field"), value.alias("value"))
    return selection.settings_overlay(layers)


def q_capped_findings(spark, d):
    """Spans of bodies cut at a byte cap; values crossing the cap stay recognised."""
    s = RunSettings()
    base = K.spread(docs(spark, d)).withColumn("allowed", budget.file_cap("size", FILE_CAP)).withColumn(
        "is_truncated", F.col("allowed") < F.col("size"))
    capped = budget.apply_caps(base)
    both = V.scan(V.scan(capped, s, "content").withColumnRenamed("findings", "__full"), s, "capped")
    out = both.withColumn("findings", F.when(
        F.col("is_truncated"), S.capped_spans("__full", "findings", "capped")).otherwise(F.col("__full")))
    return _rows(V.finding_rows(out, s, "capped"))


# ---- aggregates -----------------------------------------------------------------


def _protected(spark, d, settings: RunSettings) -> DataFrame:
    safe = V.protect(scanned(spark, d, settings), settings)
    return safe.withColumn("tokens", P.estimate_tokens(F.octet_length("body").cast("bigint")))


def q_pack_summary(spark, d, max_tokens=0):
    settings = RunSettings(scan_mode="Redact", hide_patterns=HIDE)
    return rollup.pack_summary(_protected(spark, d, settings), max_tokens)


def q_token_budget(spark, d):
    return q_pack_summary(spark, d, MAX_TOKENS).select("corpus", "tokens", "over_budget")


def q_type_counts(spark, d):
    return rollup.type_counts(doc_paths(spark, d), EXT, DOTS)


def q_contribution_rollup(spark, d):
    """Which directories contribute how much text, after exclusion rules."""
    kept = I.prune(I.inventory(doc_paths(spark, d)), R.compile_rules(PRUNE)).filter(~F.col("is_dir"))
    return rollup.share_of_total(rollup.contributions(_weighed(kept))).withColumn("share", F.round("share", 6))


def q_page_rollup(spark, d):
    return rollup.contributions(_weighed(I.once(K.page_files(spark, d)).drop("content", "size").join(
        K.page_files(spark, d).groupBy("path").agg(F.max("size").alias("size")), "path")))


def q_share_of_total(spark, d):
    return rollup.share_of_total(rollup.contributions(_weighed(K.conv_files(spark, d)))).select(
        "directory", "text_bytes", F.round("share", 6).alias("share"))


def q_token_tree(spark, d):
    return rollup.token_tree(doc_paths(spark, d)).select("path", "is_dir", "tokens")


def q_rule_tally(spark, d):
    return V.rule_tally(scanned(spark, d))


def q_findings_by_file(spark, d):
    return V.by_file(scanned(spark, d)).select("path", F.col("findings").cast("bigint").alias("findings"), "rules")


def q_review_files(spark, d):
    return V.review_files(findings(spark, d))


def q_guard_findings(spark, d):
    out = V.finding_counts(scanned(spark, d))
    return out.select("corpus", F.col("run_findings").cast("bigint").alias("run_findings"),
                      F.col("max_file_findings").cast("bigint").alias("max_file_findings"))


def _selected(spark, d) -> DataFrame:
    chosen = selection.nearest_override(doc_paths(spark, d), _overrides(spark, d), F.lit(True))
    return chosen.withColumnRenamed("included", "selected").withColumn("is_basic", P.is_basic("path", EXT, DOTS))


def q_tristate(spark, d):
    return rollup.tristate(_selected(spark, d)).select("directory", "files", "chosen", "state")


def q_selected_rollup(spark, d):
    return rollup.selected_rollup(_selected(spark, d)).drop("corpus")


def _ticked() -> Column:
    return F.translate("content", "e", "`")


def q_fence_length(spark, d):
    return docs(spark, d).select(
        "doc_id", X.longest_backtick_run(_ticked()).cast("bigint").alias("run"),
        F.length(X.fence(_ticked())).cast("bigint").alias("fence"))


def q_descendant_counts(spark, d):
    return rollup.descendant_counts(I.inventory(doc_paths(spark, d))).select("directory", "descendants", "files")


# ---- order and limits ------------------------------------------------------------


def q_size_budget(spark, d):
    return budget.size_budget(doc_paths(spark, d), FILE_CAP, TOTAL_CAP).select("path", "size", "allowed", "is_truncated")


def q_file_cap(spark, d):
    return budget.size_budget(doc_paths(spark, d), FILE_CAP).select("path", "allowed", "is_truncated")


def q_top_files(spark, d):
    return rollup.top_files(doc_paths(spark, d), 10).select("path", "tokens", F.col("rank").cast("bigint").alias("rank"))


def _ordered(entries: DataFrame, key: Column) -> DataFrame:
    return ordinals(entries.select("corpus", "path", key.alias("key")), ["key", "path"], "ord", ["corpus"]).select("path", "ord")


def q_path_order(spark, d):
    return _ordered(doc_paths(spark, d), P.path_key("path"))


def q_tree_order(spark, d):
    return _ordered(I.inventory(doc_paths(spark, d)), P.tree_key("path", "is_dir"))


def q_repomix_order(spark, d):
    return _ordered(doc_paths(spark, d), P.locale_key("path", F.lit(False)))


def _change_files(spark, d) -> DataFrame:
    """Every path the change log has ever seen."""
    return K.change_log(spark, d).select("corpus", "path").distinct()


def q_change_order(spark, d):
    counts = H.change_counts(K.change_log(spark, d)).select("corpus", "path_key", "changes")
    files = _change_files(spark, d).withColumn("path_key", P.path_key("path")).join(counts, ["corpus", "path_key"], "left")
    key = F.struct(F.coalesce("changes", F.lit(0)).alias("n"), P.locale_key("path", F.lit(False)).alias("k"))
    return _ordered(files, key)


def q_gitingest_order(spark, d):
    return _ordered(_page_inventory(spark, d), P.digest_key("path", "is_dir"))


def q_children_sorted(spark, d):
    return rollup.children_sorted(rollup.children(doc_paths(spark, d))).select(
        "parent", "path", "is_dir", "files", "text_bytes", "position")


def q_children_by_name(spark, d):
    return rollup.children_sorted(rollup.children(doc_paths(spark, d)), "name", True).select("parent", "path", "position")


def q_children_page(spark, d):
    return rollup.children_page(rollup.children(doc_paths(spark, d)), 5, 10).select(
        "parent", "path", F.col("position").cast("bigint").alias("position"))


def q_review_sample(spark, d):
    return V.review_sample(findings(spark, d), 10).select(
        "path", "rule_id", "line", "preview", F.col("position").cast("bigint").alias("position"))


def q_preview(spark, d):
    """The first three files in path order, masked and cut."""
    return L.preview(docs(spark, d).withColumn("is_binary", F.lit(False)), RunSettings(hide_patterns=HIDE)).select("path", "content")


# ---- scalar functions --------------------------------------------------------------


def q_path_parts(spark, d):
    p = F.col("path")
    return doc_paths(spark, d).select(
        "path", P.name(p).alias("name"), P.parent(p).alias("parent"), P.extension(p).alias("extension"),
        P.depth(p).cast("bigint").alias("depth"), F.array_join(P.ancestors(p), "|").alias("ancestors"))


def q_format_size(spark, d):
    return K.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", P.format_size((F.col("l_extendedprice") * F.col("l_quantity") * 100).cast("bigint")).alias("size"))


def q_language_for(spark, d):
    return doc_paths(spark, d).select("path", P.language_for("path").alias("language"))


def q_safe_name(spark, d):
    return K.table(spark, d, "pages").select("page_id", P.safe_name("url").alias("safe_name"))


def q_token_estimate(spark, d):
    return doc_paths(spark, d).select("path", P.estimate_tokens("size").alias("tokens"))


def q_encoding(spark, d):
    return blobs(spark, d).select("path", C.encoding("content", "path").alias("encoding"))


def q_decoded_text(spark, d):
    return C.decode(blobs(spark, d)).filter(~C.is_binary("content")).select(
        "path", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def q_capped_text(spark, d):
    return docs(spark, d).select(
        "doc_id", C.capped_text(F.col("content").cast("binary"), 997).alias("text"))


def q_finding_line(spark, d):
    return findings(spark, d).select("path", "rule_id", "start", "line")


def q_xml_clean(spark, d):
    dirty = F.translate("content", "et", "\u0001\u000b")
    return docs(spark, d).select("doc_id", X.xml_clean(dirty).alias("text"))


def q_escapes(spark, d):
    return K.table(spark, d, "pages").select(
        "page_id", X.xml_text("html").alias("xml"), X.xml_attribute("url").alias("attribute"),
        F.md5(X.json_string("html").cast("binary")).alias("json_md5"))


def q_trim_space(spark, d):
    padded = F.concat(F.lit(" \t\u00a0"), F.col("content"), F.lit("\u2003\n"))
    return docs(spark, d).select("doc_id", X.trim_space(padded).alias("text"))


def q_comment_safe(spark, d):
    return K.table(spark, d, "pages").select(
        "page_id", P.comment_safe(F.replace("url", F.lit("/"), F.lit("--"))).alias("path"))


def q_preview_text(spark, d):
    return docs(spark, d).select("doc_id", X.preview_cut("content").alias("text"))


# ---- sensitive data ------------------------------------------------------------------


def _rows(rows: DataFrame) -> DataFrame:
    return rows.select("path", "rule_id", "start", "length", "line", "preview")


def q_sensitive_findings(spark, d):
    return _rows(findings(spark, d))


def q_custom_patterns(spark, d):
    return _rows(findings(spark, d, RunSettings(scan_mode="Off", hide_patterns=HIDE)))


def q_masked_preview(spark, d):
    return findings(spark, d).select("path", "rule_id", "preview")


def q_entropy_findings(spark, d):
    rows = findings(spark, d, RunSettings(scan_entropy=True))
    return rows.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))


def q_mode(spark, d, mode):
    settings = RunSettings(scan_mode=mode, hide_patterns=HIDE)
    return _protected(spark, d, settings).select("path", "body", "content_omitted", "tokens")


def q_redacted_text(spark, d):
    """Only the bodies that change."""
    settings = RunSettings(scan_mode="Redact")
    return _protected(spark, d, settings).filter("body <> content").select("path", "body")


def q_review_items(spark, d):
    settings = RunSettings(hide_patterns=HIDE)
    return V.review_items(findings(spark, d, settings)).drop("corpus")


# ---- streaming ---------------------------------------------------------------------------


def _doc_stream(spark, d) -> DataFrame:
    schema = K.table(spark, d, "documents").schema
    # A table is one file or a folder of files; a pattern may stand for either.
    raw = T.read_stream(spark, f"{d}/documents.parque[t]", schema)
    files = K.as_files(
        raw, "docs", K.doc_path(F.col("doc_id"), F.col("source"), F.col("lang")), F.col("text"), "doc_id")
    return _weighed(files)


def q_stream_type_counts(spark, d):
    stream = T.once(_doc_stream(spark, d).drop("content"))
    return T.drain(T.running_types(stream, EXT, DOTS), "types", "complete")


def q_stream_rollup(spark, d):
    return T.drain_rollup(_doc_stream(spark, d).drop("content"), "rollup")


def q_stream_selection(spark, d):
    overrides = stage(_overrides(spark, d), "overrides")
    return T.drain(
        T.inherit_choice(_doc_stream(spark, d).select("corpus", "path"), overrides, F.lit(True)), "selected"
    ).select("path", "included")


def q_stream_findings(spark, d):
    return _rows(T.drain(T.running_findings(_doc_stream(spark, d)), "findings"))


# ---- layouts -----------------------------------------------------------------------------

def _pack(spark, d, layout: str) -> tuple[L.Pack, RunSettings]:
    """A prepared pack of the documents."""
    settings = RunSettings(layout=layout, scan_mode="Redact", hide_patterns=HIDE, exclude_globs=PRUNE, max_tokens=MAX_TOKENS)
    return prepare(docs(spark, d).select("corpus", "path", "content"), settings), settings


def q_layout(spark, d, layout):
    """Blocks in order: the position within the corpus replaces the sort key."""
    pack, settings = _pack(spark, d, layout)
    blocks = stage(L.render(pack, settings), "blocks")
    place = ordinals(blocks.select("corpus", "section", "key"), ["section", "key"], "ord", ["corpus"])
    joined = blocks.join(place, (blocks.corpus == place.corpus) & (blocks.section == place.section)
                         & blocks.key.eqNullSafe(place.key))
    return joined.select("ord", "block")


def q_render_blocks(spark, d):
    """One block per file and layout, for the layouts whose blocks stand alone."""
    pack, _ = _pack(spark, d, "classic")
    blocks = [F.struct(F.lit(n).alias("layout"), L.file_block(n).alias("block"))
              for n in ("classic", "plain", "markdown", "markdown_ai", "markdown_compact")]
    return pack.files.select("path", F.explode(F.array(*blocks)).alias("b")).select("path", "b.layout", "b.block")


def q_structure_tree(spark, d):
    lines = tree.structure(I.inventory(doc_paths(spark, d)), "")
    return ordinals(lines.select("corpus", "key", "line"), ["key"], "ord", ["corpus"]).select("ord", "line")


def q_token_lines(spark, d):
    lines = tree.token_lines(rollup.token_tree(doc_paths(spark, d)), "")
    return ordinals(lines.select("corpus", "key", "line"), ["key"], "ord", ["corpus"]).select("ord", "line")


def _cased(spark, d) -> DataFrame:
    """Documents whose directories come in several spellings, by their number."""
    n, path = F.col("doc_id"), F.col("path")
    source, rest = F.substring_index(path, "/", 1), F.regexp_replace(path, "^[^/]+/", "")
    return doc_paths(spark, d).withColumn("path", F.concat(
        F.when(n % 3 == 0, F.initcap(source)).otherwise(source), F.lit("/"), F.when(n % 2 == 0, F.regexp_replace(rest, "^en/", "EN/")).otherwise(rest)))


def q_cased_rollup(spark, d):
    return rollup.contributions(_cased(spark, d)).select("directory", "files", "text_bytes", "tokens")


def q_cased_token_tree(spark, d):
    return rollup.token_tree(_cased(spark, d)).select("path", "is_dir", "tokens")


def q_cased_children(spark, d):
    return rollup.children_sorted(rollup.children(_cased(spark, d)), "name", False).select("parent", "path", "files", "position")


def q_cased_tree(spark, d):
    lines = tree.structure(I.inventory(_cased(spark, d)), "")
    return ordinals(lines.select("corpus", "key", "line"), ["key"], "ord", ["corpus"]).select("ord", "line")


def q_cased_states(spark, d):
    """Directories of chosen files and, beside them, directories whose files hold no text."""
    files, held = _cased(spark, d), F.col("doc_id") % 5 < 2
    chosen = files.filter(held).withColumn("selected", F.col("doc_id") % 2 == 0)
    set_by_hand = files.filter("doc_id % 7 = 0").select("corpus", P.parent("path").alias("path")).groupBy("corpus", P.path_key("path").alias("k")).agg(
        F.min("path").alias("path")).select("corpus", "path", (F.length("path") % 2 == 0).alias("included"))
    folders = files.select("corpus", F.concat(P.parent("path"), F.lit("/sub"), (F.col("doc_id") % 3).cast("string")).alias("path")).distinct()
    return rollup.tristate(chosen, folders, set_by_hand, False).select("directory", "files", "chosen", "state")


def q_records(spark, d):
    """Per-file records, as the row sink writes them."""
    pack, _ = _pack(spark, d, "json")
    return pack.files.select("path", "size", "tokens", F.col("body").alias("content"), "is_truncated",
                             F.size("report").cast("bigint").alias("findings"))


def registry():
    named = {k[2:]: v for k, v in globals().items() if k.startswith("q_") and k not in ("q_mode", "q_layout")}
    named |= {f"mode_{m.lower()}": partial(q_mode, mode=m) for m in ("Off", "Warn", "Redact", "Skip")}
    named |= {f"layout_{n}": partial(q_layout, layout=n) for n in (
        "classic", "plain", "markdown", "markdown_ai", "markdown_compact", "json", "json_compact",
        "xml", "xml_compact", "repomix", "gitingest")}
    return named
