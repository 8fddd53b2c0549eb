"""The packing job: select, read, protect, measure, order, write."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, functions as F

from satchel.functions import content as C, paths as P, rules as R, spans as S, text as X, tokens as K
from satchel.operators import budget, inventory as I, layouts as L, regions as G, selection, sensitive as V
from satchel.plans.session import scratch, stage
from satchel.plans.settings import RunSettings
from satchel.sources.corpus import spread


@dataclass(frozen=True)
class Selection:
    """Choices of one run that are not settings.

    ``overrides``: ``corpus, path, included``; ``types``: ``corpus, type_kind,
    type_value`` taken when given; ``mode`` stands in for the mode of the settings.  ``item``
    is the path of one file picked by hand: its siblings are not listed and a minified name
    does not keep it out.
    """

    overrides: DataFrame | None = None
    types: DataFrame | None = None
    mode: str | None = None
    item: str | None = None

    @property
    def of_content(self) -> bool:
        """Whether content was chosen by hand."""
        return self.overrides is not None or self.types is not None or self.mode is not None


def listing_of(corpus: DataFrame) -> DataFrame:
    """Every path of the corpus, directories included: ``corpus, path, is_dir, size``.

    Sizes are those of the source, null where it has none: no content is read for them.
    """
    size = F.col("size") if "size" in corpus.columns else F.lit(None)
    files = corpus.filter(~F.col("is_dir")) if "is_dir" in corpus.columns else corpus
    listed = I.inventory(files.select("corpus", "path", size.cast("bigint").alias("size")))
    if "is_dir" in corpus.columns:
        empty = corpus.filter("is_dir").select("corpus", "path", "is_dir", F.lit(0).cast("bigint").alias("size"))
        listed = listed.unionByName(empty).dropDuplicates(["corpus", "path"])
    return listed


def exclusion(corpus: DataFrame, listing: DataFrame, s: RunSettings):
    """A function that drops excluded rows from any table of paths.  ``corpus``: raw rows.

    Excluded directories are worked out once, from paths; tables with bodies then
    only meet that set and the rule lists, broadcast when they are small.
    """
    names = tuple(
        n for n, on in ((".gitignore", s.respect_gitignore), (s.extra_ignore_name, s.use_extra_ignore)) if on)
    if names:
        lines = I.rule_lines(I.rule_files(corpus, names), names, tuple(s.exclude_globs), listing)
        lists = budget.broadcast_if_small(stage(I.rule_lists(lines), "rules"))
        gone = I.pruned_directories_by_lists(listing, lists, s.exclude_regex)
        keep = lambda rows: I.judged_by_lists(rows, lists, s.exclude_regex).filter("NOT __out").drop("__out")
    else:
        rules = R.compile_rules(s.exclude_globs)
        gone = I.pruned_directories(listing, rules, s.exclude_regex)
        keep = lambda rows: rows.filter(~R.excluded(F.col("path"), F.col("is_dir"), rules, s.exclude_regex, R.in_corpus(F.col("path"))))
    gone = budget.broadcast_if_small(stage(gone, "pruned"))
    return lambda rows: I.outside(keep(rows), gone)


def candidates(entries: DataFrame, s: RunSettings, selection_: Selection = Selection(), output: str = "") -> DataFrame:
    """Listed files whose content is packed; other columns stay."""
    p = F.col("path")
    files = entries.filter(~F.col("is_dir"))
    if selection_.types is not None:
        keyed = files.withColumn("type_kind", P.type_kind(p)).withColumn("type_value", P.type_value(p))
        chosen = selection_.types.select("corpus", "type_kind", "type_value").distinct()
        files = keyed.join(
            chosen.withColumn("__type", F.lit(True)), ["corpus", "type_kind", "type_value"], "left"
        ).drop("type_kind", "type_value")
        wanted = F.coalesce("__type", F.lit(False))
    else:
        by_hand = selection_.mode is not None or selection_.overrides is not None
        basic = P.is_basic if by_hand else P.is_legible
        wanted = selection.mode_default(selection_.mode or s.selection_mode, basic(p, list(s.extensions), list(s.dot_files)))
    files = files.withColumn("__wanted", wanted)
    if selection_.overrides is not None:
        files = selection.nearest_override(files, selection_.overrides, F.col("__wanted"))
        files = files.withColumn("__wanted", F.col("included")).drop("included")
    minified = P.is_minified(p) if selection_.item is None else F.lit(False)
    keep = F.col("__wanted") & ~minified & R.included(p, R.compile_rules(s.include_globs))
    if output:
        keep = keep & (P.path_key(p) != output.upper())
    return files.filter(keep).drop("__wanted")


def read_bodies(chosen: DataFrame, s: RunSettings, by_type: bool = True) -> DataFrame:
    """Candidates with ``text``; ``undecodable`` marks bytes their encoding does not allow.

    Files that no configured type vouches for (``by_type`` false) must also look like text.
    """
    raw = chosen.select("corpus", "path", F.col("content").cast("binary").alias("content")).withColumn(
        "size", F.length("content").cast("bigint"))
    binary = C.is_binary("content") if s.detect_binary else F.lit(False)
    if s.detect_binary and not by_type:
        binary = binary | (C.text_like("content", "path") == "binary")
    read = C.decode(raw.withColumn("is_binary", binary))
    return read.withColumn("undecodable", ~F.col("is_binary") & F.col("text").isNull())


def scan_bodies(files: DataFrame, s: RunSettings, long: bool = False) -> DataFrame:
    """Cap, then find: values crossing a cap are recognised in the whole body.

    ``long``: some bodies are worth being scanned by regions.
    """
    # Files without text use up nothing of the budget.
    empty = F.col("is_binary") | F.col("undecodable")
    sized = (
        budget.size_budget(files, s.max_file_bytes, s.max_total_bytes, empty)
        .withColumn("text", F.when(empty, F.lit("")).otherwise(F.col("text")))
    )
    full = G.scan(stage(sized, "bodies"), s, "text") if long else V.scan(sized, s, "text")
    if s.max_file_bytes <= 0 and s.max_total_bytes <= 0:
        return full.withColumn("shown", F.col("text")).drop("content", "text", "allowed")
    cut = C.capped_decode("content", F.col("encoding"), F.col("allowed"))
    both = (
        V.scan(
            full.withColumnRenamed("findings", "__full").withColumn(
                "__cut", F.when(F.col("is_truncated"), cut)), s, "__cut")
        .withColumn("findings", F.when(
            F.col("is_truncated"), S.capped_spans("__full", "findings", "__cut")).otherwise(F.col("__full")))
        .withColumn("shown", F.coalesce("__cut", "text"))
    )
    return both.drop("content", "text", "allowed", "__full", "__cut")


def finish_bodies(scanned: DataFrame, s: RunSettings, vocab_path: str | None = None) -> DataFrame:
    """Protect, clean for XML, count tokens of what is emitted, and attach the report."""
    safe = V.protect(scanned, s, text="shown")
    if s.layout in L.XML_LAYOUTS:
        safe = safe.withColumn("body", X.xml_clean("body"))
    if vocab_path:
        count = K.exact_tokens(F.col("body"), s.token_encoding, vocab_path)
    else:
        count = P.estimate_tokens(F.octet_length("body").cast("bigint"))
    report = V.report(s, "findings", "shown")
    return safe.withColumn("tokens", count).withColumn("report", report).drop("shown", "findings")


def observed(finished: DataFrame, observation: Observation | None) -> DataFrame:
    """Count what passes by, without a pass of its own."""
    if observation is None:
        return finished
    good = ~F.col("undecodable")
    none = F.lit(0).cast("bigint")
    return finished.observe(
        observation, F.count_if(good).alias("files"), F.coalesce(F.sum(F.when(good, F.col("size"))), none).alias("bytes"),
        F.coalesce(F.sum(F.when(good, F.col("tokens"))), none).alias("tokens"), F.coalesce(F.sum(F.when(good, F.size("report"))), none).alias("findings"),
        F.count_if(good & F.col("content_omitted")).alias("omitted"), F.count_if("undecodable").alias("undecodable"))


def skipped_item(listing: DataFrame, legible: DataFrame) -> DataFrame:
    """``corpus, path, skip_reason`` of a chosen file that is not packed; one row per corpus at most.

    ``legible``: the file if rules and types let it pass, with ``changed``.
    """
    judged = listing.filter(~F.col("is_dir")).select("corpus", "path").join(
        legible.select("corpus", "path", "changed"), ["corpus", "path"], "left")
    reason = F.when(F.col("changed").isNull(), "not legible").when(~F.col("changed"), "unchanged")
    return judged.select("corpus", "path", reason.alias("skip_reason")).filter("skip_reason IS NOT NULL")


def prepare(
    corpus: DataFrame,
    settings: RunSettings,
    changes: DataFrame | None = None,
    commits: DataFrame | None = None,
    selection_: Selection = Selection(),
    vocab_path: str | None = None,
    guard: bool = True,
    observation: Observation | None = None,
) -> L.Pack:
    """Everything a layout needs.  ``changes`` limits the run when the settings ask for it.

    ``observation`` receives counts of the body pass while it runs: ``files``, ``bytes``, ``tokens``,
    ``findings``, ``omitted``, ``undecodable``; with a listener they are a run's progress.

    Of a run over a single item only that file is listed and read; a corpus without it is not
    part of the run, and ``FileNotFoundError`` tells that none has it.
    """
    # Paths that differ in case only are two files.
    clean = corpus.withColumn("path", P.normalize("path"))
    if selection_.item is not None:
        clean = clean.filter(F.col("path") == P.normalize(F.lit(selection_.item)))
        if "is_dir" in clean.columns:
            clean = clean.filter("NOT is_dir")
    # Paths only, read by several joins: kept as a narrow table.
    listing = stage(listing_of(clean), "listing")
    if selection_.item is not None and listing.isEmpty():
        raise FileNotFoundError(selection_.item)
    keep = exclusion(corpus, listing, settings)
    entries = keep(listing)
    rows = clean if "is_dir" in clean.columns else clean.withColumn("is_dir", F.lit(False))
    # What a source could not read has no content; its own message is the reason.
    failed = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    rows = rows.select("corpus", "path", "is_dir", "content", failed.alias("error"))
    unread = keep(rows.filter(F.col("error").isNotNull() | (~F.col("is_dir") & F.col("content").isNull()))).select(
        "corpus", "path", F.coalesce("error", F.lit("has no content")).alias("reason"))
    rows = keep(rows.filter(~F.col("is_dir") & F.col("content").isNotNull() & F.col("error").isNull()).drop("error"))
    skipped = None
    if selection_.item is not None:
        # Directories were needed for the rules only.
        entries = entries.filter(~F.col("is_dir"))
        legible = candidates(entries, settings, selection_)
        moved = I.changed_only(legible, changes) if settings.only_changed and changes is not None else legible
        skipped = stage(skipped_item(listing, legible.select("corpus", "path").join(
            moved.select("corpus", "path", F.lit(True).alias("changed")), ["corpus", "path"], "left").na.fill(False)), "skipped")
    if settings.only_changed and changes is not None:
        # A choice made by hand is about content: the directories of all that changed are listed.
        holders = None if selection_.of_content else lambda files: candidates(files, settings, selection_)
        entries, rows = I.changed_only(entries, changes, holders), I.changed_only(rows, changes)
    entries = stage(entries, "entries")
    # Selection runs on the rows that hold the bodies, which meet small tables only.
    by_type = selection_.overrides is None and (selection_.mode or settings.selection_mode) == "Basic"
    bodies = read_bodies(spread(candidates(rows, settings, selection_), corpus), settings, by_type)
    long = not entries.where(F.col("size") > G.LONG_CHARS).isEmpty()
    # One pass reads, scans and protects; header sums, listings, errors and blocks
    # all read the staged result.
    finished = finish_bodies(scan_bodies(bodies, settings, long), settings, vocab_path)
    staged = stage(observed(finished, observation), "files")
    files = staged.filter(~F.col("undecodable")).drop("undecodable", "encoding")
    errors = staged.filter("undecodable").select(
        "corpus", "path", F.concat(F.lit("could not be decoded as "), F.col("encoding")).alias("reason")).unionByName(unread)
    if guard and settings.max_findings > 0:
        V.guard_findings(files.withColumn("findings", F.col("report")), settings.max_findings)
    if settings.layout in ("repomix", "gitingest"):
        entries = entries.filter(~F.col("is_dir")).unionByName(
            I.directories(entries.filter(~F.col("is_dir"))).select(
                "corpus", "path", F.lit(True).alias("is_dir"), F.lit(0).cast("bigint").alias("size")))
    return L.Pack(entries, files, errors, commits, listing.select("corpus"), skipped)


def export(
    corpus: DataFrame,
    settings: RunSettings,
    path: str,
    decision: str = "Keep",
    **options,
) -> DataFrame | None:
    """Write a pack below ``path``, which must not exist; returns the result, one row per corpus.

    ``decision`` answers the review of a Warn run that has something to review: Cancel
    writes nothing and returns None, Redact hides all findings, Keep leaves automatic ones.
    The result holds what the headers count (files, bytes, tokens, findings, files with
    findings, omitted bodies, unreadable files), ``over_budget`` and the ``scan_mode`` that took effect.
    """
    if decision not in ("Keep", "Redact", "Cancel"):
        raise ValueError(f"Unknown decision: {decision}")
    reviewed = settings.scan_mode == "Warn"
    redacted = replace(settings, scan_mode="Redact") if reviewed and decision == "Redact" else settings
    with scratch(corpus.sparkSession, "export"):
        pack = prepare(corpus, redacted, **options)
        if reviewed and decision != "Keep":
            nothing = V.review_items_of(pack.files).isEmpty()
            if decision == "Cancel" and not nothing:
                return None
            # Bodies without findings are the same in both modes; the report names the mode.
            settings = settings if nothing else redacted
        L.write_pack(L.render(pack, settings), path)
        over = (F.col("n_tokens") > settings.max_tokens) if settings.max_tokens > 0 else F.lit(False)
        sums = L.totals(pack).withColumn("over_budget", over).withColumn("scan_mode", F.lit(settings.scan_mode))
        # One row per corpus; the staged tables it came from go now.
        return corpus.sparkSession.createDataFrame(sums.collect(), sums.schema)
