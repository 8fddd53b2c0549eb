"""Source divergence audit: how far the sources of a language lie from each other, and by which terms.

Identical texts of a language are one row with the number of its documents in each source, so
a text is split into terms once, however often it was copied; its term counts and document
frequencies are added with those weights.

* A term is a run of letters A-Z, a-z or of characters above U+007F; only A-Z is lowered.
* A language keeps its ``V`` terms that occur in at least ``least_docs`` of its documents.
* A group is a source within a language, with or without terms.  With ``N`` the occurrences of
  kept terms in the group, a term that occurs ``count`` times has
  ``p = 1 + floor(10**9 * (count + 2) / (N + 2 * V))``; languages have the same.
* The divergence at a term is ``floor((p - q)**2 / (p + q))``.

Part ``pair``: the other sources of the language, by the sum over all kept terms.  Part
``term``: the terms that a group uses more than its language, by divergence, ``top`` of them.
All arithmetic is exact (integers, decimals where a product may pass 64 bits).

The sum over all kept terms is evaluated sparsely: what two sources without a term differ by is
a constant of the pair, so terms in one of the two are added by a histogram of their ``p``, and
only terms that both have are met in a join.

Null text, language or source is the empty string; a text without terms only makes its group
known.  Repeated rows are further documents.  A language with one source has no pairs; without
kept terms its pairs have value 0.  No documents: no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from satchel.llm.common import texts
from satchel.plans.session import stage

LEAST_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: A task hands its counters on when they hold so many terms.
MOST_ENTRIES = 300_000
#: Longer texts are split into terms by pieces of this many bytes.
PIECE = 1 << 20
#: Maps every byte that is in no term to a blank, and A-Z to a-z.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(raw: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of about ``piece`` bytes of text."""
    at = 0
    left = b""
    while at < len(raw):
        part = left + raw[at:at + piece].translate(_PLAIN)
        at += piece
        if at < len(raw):
            cut = part.rfind(b" ") + 1
            part, left = part[:cut], part[cut:]
        if words := part.split():
            yield words


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each distinct text, counted for all sources that have it."""
    occurs: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
    within: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in occurs.items():
            docs = within[lang, source]
            n = len(counts)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string()),
                pa.array([docs[t] for t in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())],
                names=["lang", "source", "term", "n_docs", "n"])
        occurs.clear()
        within.clear()

    for batch in batches:
        for lang, raw, sources in zip(batch.column("lang").to_pylist(), texts(batch.column("text")), batch.column("sources").to_pylist()):
            seen: Counter[bytes] = Counter()
            for words in terms_of(raw):
                seen.update(words)
            for s in sources:
                counts, docs, weight = occurs[lang, s["source"]], within[lang, s["source"]], s["n"]
                if weight == 1:
                    counts.update(seen)
                    docs.update(seen.keys())
                else:
                    for t, k in seen.items():
                        counts[t] += k * weight
                        docs[t] += weight
            if sum(map(len, occurs.values())) > MOST_ENTRIES:
                yield from flush()
    yield from flush()


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``lang, text, sources``: one row for each distinct text of a language, with ``sources`` an
    array of (source, n).  Every row holds the text once, whatever its number of copies."""
    blank = F.lit("")
    rows = docs.select(*(F.coalesce(F.col(c), blank).alias(c) for c in ("lang", "source", "text"))).withColumn("h", F.unhex(F.sha2("text", 256)))
    # Copies are added up on the map side, first by source, then their texts.
    held = rows.groupBy("lang", "h", "source").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("lang", "h").agg(F.collect_list(F.struct("source", "n")).alias("sources"))
    return rows.groupBy("lang", "h").agg(F.any_value("text").alias("text")).join(held, ["lang", "h"]).select("lang", "text", "sources")


def _share(count: Column, total: Column, v: Column) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * v))``; null where no term is kept."""
    wide = "decimal(38,0)"
    top = F.lit(SCALE).cast(wide) * (count + 2)
    return F.when(v > 0, 1 + F.call_function("div", top, (total + 2 * v).cast(wide)))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` as the module says, for ``docs(lang, source, text)``."""
    schema = "lang string, source string, term string, n_docs bigint, n bigint"
    cells = distinct_texts(docs).mapInArrow(_counted, schema).groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
    # A term's row holds a number for each source that has it.
    terms = cells.groupBy("lang", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", F.col("n").alias("n_here"))).alias("cells"))
    terms = stage(terms.where(F.col("n_docs") >= least_docs).drop("n_docs"), "terms")

    here = terms.select("lang", "term", F.col("n").alias("n_lang"), F.inline("cells"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("total_lang"))
    totals = here.groupBy("lang", "source").agg(F.sum("n_here").alias("total"))
    none = F.lit(0).cast("bigint")
    groups = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    groups = groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["v", "total_lang", "total"])
    groups = stage(groups.withColumn("p0", _share(none, F.col("total"), F.col("v"))), "groups")
    shares = here.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "p0", _share(F.col("n_here"), F.col("total"), F.col("v")).alias("p"), _share(F.col("n_lang"), F.col("total_lang"), F.col("v")).alias("q"))
    shares = stage(shares, "shares")

    ahead = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = ahead.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    by_pair = _pairs(groups, shares).withColumn("rank", F.row_number().over(order))
    return _part(by_pair, "pair").unionByName(_part(by_term, "term"))


def _part(found: DataFrame, name: str) -> DataFrame:
    return found.select("lang", "source", F.lit(name).alias("part"), "item", F.col("value").cast("bigint").alias("value"), F.col("rank").cast("int").alias("rank"))


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for the sources of a language, each with each other."""
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    both = groups.join(other, "lang").where(F.col("source") != F.col("item"))
    absent = both.select("lang", "source", "item", F.coalesce(F.col("v") * _apart(F.col("p0"), F.col("q0")), F.lit(0)).alias("value"))
    # Terms that one side has, as if the other had none of them.
    levels = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("m"))
    single = levels.join(other, "lang").where(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(
        F.sum(F.col("m") * (_apart(F.col("p"), F.col("q0")) - _apart(F.col("p0"), F.col("q0")))).alias("value"))
    # Terms that both have.
    right = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    p, p0, q, q0 = (F.col(c) for c in ("p", "p0", "q", "q0"))
    common = shares.select("lang", "term", "source", "p", "p0").join(right, ["lang", "term"]).where(F.col("source") < F.col("item")).groupBy("lang", "source", "item").agg(
        F.sum(_apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)).alias("value"))

    def turned(x: DataFrame) -> DataFrame:
        return x.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")

    parts = (absent, single, turned(single), common, turned(common))
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.union(x)
    return whole.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
