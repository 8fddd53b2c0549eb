"""Scanning, reviewing and protecting bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from satchel.functions import spans as S, text as X
from satchel.functions.binding import let
from satchel.functions.detectors import CUSTOM, CUSTOM_NAME, CUSTOM_ID, DETECTORS, ENTROPY, HIGH, check_patterns
from satchel.functions.paths import path_key
from satchel.plans.settings import RunSettings

_NAMES = {d.rule_id: d.rule_name for d in (*DETECTORS, ENTROPY)} | {CUSTOM_ID: CUSTOM_NAME}


def scan(files: DataFrame, settings: RunSettings = RunSettings(), text: str = "content") -> DataFrame:
    """Add ``findings``: spans found in each body, in reading order.  No shuffle.

    ``Off`` still looks for always-hide patterns.
    """
    automatic = settings.scan_mode != "Off"
    hide = check_patterns(settings.hide_patterns)
    allow = check_patterns(settings.allow_patterns) if automatic else []
    if not automatic and not hide:
        return files.withColumn("findings", F.array().cast(S.SPAN))
    return files.withColumn("findings", S.all_spans(
        text, automatic, settings.scan_entropy, allow, hide))


def report(settings: RunSettings, findings: str = "findings", text: str = "content") -> Column:
    """Findings as they may be shown: rule, place, masked preview; never the value."""
    return S.report(findings, text, _NAMES, settings.hide_patterns)


def finding_rows(scanned: DataFrame, settings: RunSettings = RunSettings(), text: str = "content") -> DataFrame:
    """One row per finding.

    The outer explode keeps the scan out of a filter, where it would run twice.
    """
    return (
        scanned.select("corpus", "path", F.explode_outer(report(settings, "findings", text)).alias("f"))
        .filter("f IS NOT NULL")
        .select("corpus", "path", "f.*")
    )


def omitted(settings: RunSettings, findings: Column | str = "findings") -> Column:
    """Skip drops the whole body when a vendor or private-key finding exists."""
    if settings.scan_mode != "Skip":
        return F.lit(False)
    return F.exists(findings, lambda s: s["tier"] == HIGH)


def protect(scanned: DataFrame, settings: RunSettings, text: str = "content", out: str = "body") -> DataFrame:
    """Add the body as it may be shown, and ``content_omitted``.

    Off and Warn hide custom spans only; Redact and Skip hide every span.
    """
    spans = "findings"
    gone = omitted(settings)
    if settings.scan_mode in ("Off", "Warn"):
        if not settings.hide_patterns:
            return scanned.withColumn("content_omitted", gone).withColumn(out, F.col(text))
        spans = f"filter(findings, s -> s.tier = {CUSTOM})"
    body = F.when(gone, F.lit("")).otherwise(S.redacted(text, spans))
    return scanned.withColumn("content_omitted", gone).withColumn(out, body)


def rule_tally(scanned: DataFrame) -> DataFrame:
    return (
        scanned.select("corpus", F.explode_outer("findings.rule_id").alias("rule_id"))
        .filter("rule_id IS NOT NULL")
        .groupBy("corpus", "rule_id")
        .agg(F.count(F.lit(1)).alias("findings"))
    )


def by_file(scanned: DataFrame) -> DataFrame:
    """Files with findings; the count and the rules come from the row itself."""
    row = let(F.col("findings.rule_id"), lambda ids: F.struct(
        F.size(ids).alias("findings"),
        F.array_join(F.array_sort(F.array_distinct(ids)), ",").alias("rules")))
    return (
        scanned.select("corpus", "path", F.explode_outer(F.array(row)).alias("f"))
        .filter("f.findings > 0")
        .select("corpus", "path", "f.*")
    )


def review_items(rows: DataFrame) -> DataFrame:
    """What a reviewer sees: masked automatic findings; custom ones stay out."""
    return rows.filter(~F.col("always_redact")).select(
        "corpus", "path", "line", "rule_id", "rule_name", "preview")


def review_items_of(files: DataFrame) -> DataFrame:
    """The same from files that already carry a ``report``."""
    rows = files.select("corpus", "path", F.explode_outer("report").alias("f")).filter("f IS NOT NULL")
    return review_items(rows.select("corpus", "path", "f.*"))


def review_files(rows: DataFrame) -> DataFrame:
    return rows.groupBy("corpus").agg(
        F.countDistinct(path_key("path")).alias("files"), F.count(F.lit(1)).alias("findings"))


def review_sample(rows: DataFrame, limit: int = 10) -> DataFrame:
    """A fair sample of ``limit`` findings per corpus, grouped by file.

    Every file first gets ``max(1, limit / files)`` places; free places go to the
    remaining findings in order.  Ranks above ``limit`` are cut before the
    shuffle, so a file or corpus with very many findings is no hot spot.
    """
    order = [F.col("path_key"), F.col("path"), F.col("start"), F.col("length").desc(), F.col("rule_id")]
    keyed = rows.withColumn("path_key", path_key("path"))
    in_file = Window.partitionBy("corpus", "path_key").orderBy(*order[1:])
    top = keyed.withColumn("in_file", F.row_number().over(in_file)).filter(F.col("in_file") <= limit)
    # Files beyond the first ``limit`` can never get a place.
    counts = keyed.groupBy("corpus").agg(F.countDistinct("path_key").alias("files"))
    share = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("files")))
    phased = top.join(counts, "corpus").withColumn(
        "phase", (F.col("in_file") > share).cast("int"))
    chosen = Window.partitionBy("corpus").orderBy("phase", *order)
    picked = phased.withColumn("place", F.row_number().over(chosen)).filter(F.col("place") <= limit)
    shown = Window.partitionBy("corpus").orderBy("path_key", "phase", *order[1:])
    return picked.withColumn("position", F.row_number().over(shown)).drop(
        "path_key", "in_file", "files", "phase", "place")


class FindingLimitExceeded(RuntimeError):
    """More findings than the run allows; nothing has been written."""


def finding_counts(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("corpus").agg(
        F.sum(F.size("findings")).alias("run_findings"),
        F.max(F.size("findings")).alias("max_file_findings"))


def guard_findings(scanned: DataFrame, limit: int = 100_000) -> None:
    """Fail before any output when a file or a run holds more findings than allowed."""
    over = finding_counts(scanned).filter(
        (F.col("run_findings") > limit) | (F.col("max_file_findings") > limit))
    worst = over.select("corpus").first()
    if worst is not None:
        raise FindingLimitExceeded(
            f"Corpus {worst[0]!r} exceeds {limit:,} findings; select fewer files. Nothing was written.")
