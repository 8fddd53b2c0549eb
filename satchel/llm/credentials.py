"""Secret scan with corpus-wide ownership, in DataFrame functions only.

Base spans of three kinds are found by patterns in whole texts.  What they hold, and other
credential-like words, are candidates: each is hashed, and the hash is counted over the
corpus by distinct owners and repositories.  A candidate with one owner that does not look
like a placeholder is a ``live`` span, one that many owners share or that looks like a
placeholder is an ``example`` span, the rest are ``shared`` spans.  These are added to the
base spans, which all stay.

Texts are read once; what is staged and shuffled afterwards are spans and hashes.  Counting
reduces (hash, owner, repository) before it shuffles, so a secret that a third of all
documents hold is counted in parts.  Null and empty texts have no spans.  A null owner or
repository counts as one owner or repository of its own.  Equal rows get equal answers.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from satchel.llm.common import running_sums
from satchel.plans.session import stage


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Kinds and patterns of the base.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = "(" + "|".join(map(either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, ACCESS_CHARS = "AKIA[A-Z0-9]+", 20
# A run that is too short cannot hold a longer one, so the length may be part of the pattern.
HEX, LEAST_VALUE = "[0-9a-f]{24,}", 6
BASE_KINDS = ("assign", "access", "hex")
#: Other candidates: long words of letters and digits of both cases.
WORD, WORD_NEEDS = "[A-Za-z0-9_]{20,}", ("[0-9]", "[a-z]", "[A-Z]")
PLACEHOLDER = "(?i)example|sample|dummy|changeme|placeholder|test|xxxx|123456|abcdef"
#: Owners from which on a value is widely copied.
MANY_OWNERS = 3
ADDED_KINDS = ("live", "example", "shared")
KINDS = BASE_KINDS + ADDED_KINDS
_SPAN = "array<struct<start: bigint, rank: int, end: bigint, value: string>>"


def _spans(text: Column, pattern: str, kind: int, group: int, good) -> Column:
    """Spans of all matches for which ``good(match, group)`` holds, in linear time: lengths of gaps and matches, summed."""
    rx = F.lit(pattern)
    found, held, gaps = F.regexp_extract_all(text, rx, F.lit(0)), F.regexp_extract_all(text, rx, F.lit(group)), F.split(text, pattern)
    parts = F.zip_with(found, held, lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    parts = F.zip_with(gaps, parts, lambda g, p: F.struct(F.length(g).cast("bigint").alias("g"), p["m"].alias("m"), p["v"].alias("v")))

    def placed(all_: Column) -> Column:
        starts = running_sums(F.transform(all_, lambda p: p["g"] + F.coalesce(F.length(p["m"]), F.lit(0)).cast("bigint")))
        return F.transform(F.filter(F.zip_with(all_, starts, lambda p, s: F.struct((s + p["g"]).alias("s"), p["m"].alias("m"), p["v"].alias("v"))),
                                    lambda p: p["m"].isNotNull() & good(p["m"], p["v"])),
                           lambda p: F.struct(p["s"].alias("start"), F.lit(kind).alias("rank"), (p["s"] + F.length(p["m"])).alias("end"), p["v"].alias("value")))

    spans = F.element_at(F.transform(F.array(parts), placed), 1)
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Base spans sorted by start and kind, with the value that each holds."""
    return F.array_sort(F.concat(
        _spans(text, ASSIGN, 0, 2, lambda m, v: F.length(v) >= LEAST_VALUE),
        _spans(text, ACCESS, 1, 0, lambda m, v: F.length(m) >= ACCESS_CHARS),
        _spans(text, HEX, 2, 0, lambda m, v: F.lit(True))))


def _listed(spans: Column, kind) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _name(s: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """``doc_id``, counts, ``base_sha256``, ``spans`` and counts by ownership for each row of ``docs(doc_id, text)``.

    ``owner`` and ``repository`` are expressions over the columns of ``docs``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base_spans(text)
    words = _spans(text, WORD, 3, 0, lambda m, v: reduce(and_, (m.rlike(x) for x in WORD_NEEDS)))
    # The row number is written with the rows, so it names them in whatever follows.
    found = stage(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), base.alias("base"), words.alias("words")), "spans")
    spans = F.array_distinct(F.transform(F.concat("base", "words"), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("lo"), F.xxhash64(F.lit(1), s["value"]).alias("hi"),
        s["value"].rlike(PLACEHOLDER).alias("fake"))))
    held = found.where((F.size("base") > 0) | (F.size("words") > 0)).select("row", "owner", "repository", F.explode(spans).alias("s")).select(
        "row", "owner", "repository", "s.*")
    uses = held.groupBy("lo", "hi", "owner", "repository").agg(F.max("fake").alias("fake"))
    owners = uses.groupBy("lo", "hi", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.max("fake").alias("fake"))
    owned = stage(owners.groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.max("fake").alias("fake"))
                  .select("lo", "hi", F.when(F.col("fake") | (F.col("owners") >= MANY_OWNERS), 4).when(F.col("owners") == 1, 3).otherwise(5).alias("rank")), "owned")
    judged = (held.select("row", "start", "end", "lo", "hi").join(owned, ["lo", "hi"])
              .groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("more")))
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    more = F.coalesce("more", F.array().cast("array<struct<start: bigint, rank: int, end: bigint>>"))

    def count(spans: str | Column, rank: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("bigint")

    return found.select("row", "doc_id", "base").join(judged, "row", "left").select(
        "doc_id", *(count("base", k).alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)),
        F.sha2(_listed(F.col("base"), _name), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat(plain, more)), _name).alias("spans"),
        *(count(more, k).alias(f"n_{kind}") for k, kind in enumerate(ADDED_KINDS, len(BASE_KINDS))))
