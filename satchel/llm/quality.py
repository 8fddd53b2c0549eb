"""Quality rules: base rules, then gradient-boosted trees over document statistics.

Each text is read once by an Arrow function that counts words, symbols, repeated lines
and repeated five-word windows and scores the trees; the other columns do not pass
Python.  Null text: no words, so it fails the base rules.  Empty texts likewise.  Equal
rows get equal answers.  Without labels of both classes there are no trees: the score is
null and the base rules alone decide.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from satchel.llm.boosting import Forest, fit
from satchel.llm.common import codes_of, fresh, texts

#: Labelled rows that the trees are fitted on, at most.
SAMPLE = 6000
#: A document is kept from this probability on.
THRESHOLD = 0.5
LEAST_WORDS, MOST_REPEATED = 10, 20
# The symbols that are counted.
SYMBOLS = b"[#*$%&|<>]"[1:-1]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the trees see, and how quality may follow each: -1 falling, 0 free.
FEATURES = (("log_words", 0), ("word_length", 0), ("symbols", -1), ("dup_lines", -1), ("repeated", -1), ("digits", -1),
            ("upper", 0), ("punctuation", 0), ("non_ascii", 0), ("line_words", 0), ("distinct", 0), ("odd_words", -1))
SIGNS = np.array([s for _, s in FEATURES])

_CLASS = np.zeros((256, 7), np.int64)
for _k, _of in enumerate((range(0x80, 0xC0), b" \t\n\x0b\x0c\r", SYMBOLS, range(48, 58), range(65, 91),
                          b".,;:!?'\"()-", range(0xC0, 256))):
    _CLASS[list(_of), _k] = 1


def repeated_words(words: list[bytes], window: int = 5) -> tuple[int, int]:
    """Words that lie in windows found twice or more, and distinct words.  Exact: no hashes."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    n = len(words)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    kinds = len(numbers)
    if n <= window:
        return 0, kinds
    code, size = ids, kinds
    for k in range(1, window):
        if size * kinds >= 2**62:
            code, size = codes_of(code), n
        code, size = code[:-1] * kinds + ids[k:], size * kinds
    ranked = np.sort(code)
    again = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(again):
        return 0, kinds
    starts = np.flatnonzero(np.isin(code, again))
    steps = np.zeros(n + 1, np.int64)
    steps[starts] += 1
    steps[starts + window] -= 1
    return int((np.cumsum(steps[:n]) > 0).sum()), kinds


def measure(raw: bytes) -> tuple[list[int], list[float]]:
    """The base counts of a text and the statistics that the trees see."""
    words = raw.split()
    n = len(words)
    follow, space, symbols, digits, upper, points, leads = (
        np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS).tolist()
    chars = len(raw) - follow - space
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat, kinds = repeated_words(words)
    odd = sum(map(_odd, words)) if symbols else 0
    per = max(chars, 1)
    return [n, chars, symbols, dup, repeat], [
        float(np.log1p(n)), chars / max(n, 1), symbols / per, dup / max(len(lines), 1), repeat / max(n, 1), digits / per,
        upper / per, points / per, leads / per, n / max(len(lines), 1), kinds / max(n, 1), odd / max(n, 1)]


def _odd(word: bytes) -> bool:
    return any(c in SYMBOLS for c in word)


_STATS = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ", features: array<double>>"
_VERDICT = "struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ", base_failed: boolean, score: double, kept: boolean>"


def statistics(text: Column) -> Column:
    """Base counts and features of a text."""

    def stats(array: pa.Array) -> pa.Array:
        got = [measure(x or b"") for x in texts(array)]
        fields = [pa.array([g[0][k] for g in got], pa.int64()) for k in range(len(COUNTS))]
        return pa.StructArray.from_arrays([*fields, pa.array([g[1] for g in got], pa.list_(pa.float64()))], [*COUNTS, "features"])

    return F.arrow_udf(stats, _STATS).asNondeterministic()(text)


def verdict(text: Column, forest: Forest | None, threshold: float = THRESHOLD) -> Column:
    """Counts, ``base_failed``, ``score`` and ``kept`` of a text."""

    def judge(array: pa.Array) -> pa.Array:
        got = [measure(x or b"") for x in texts(array)]
        counts = np.array([g[0] for g in got], np.int64).reshape(-1, len(COUNTS))
        n, repeat = counts[:, 0], counts[:, 4]
        failed = (n < LEAST_WORDS) | (100 * repeat > MOST_REPEATED * n)
        if forest is None:
            score, kept = pa.nulls(len(got), pa.float64()), ~failed
        else:
            chance = forest.score(np.array([g[1] for g in got]).reshape(-1, len(FEATURES)))
            score, kept = pa.array(chance), ~failed & (chance >= threshold)
        return pa.StructArray.from_arrays(
            [*(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array(failed), score, pa.array(kept)],
            [*COUNTS, "base_failed", "score", "kept"])

    return F.arrow_udf(judge, _VERDICT).asNondeterministic()(text)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **options) -> Forest | None:
    """Fit the trees on at most ``sample`` labelled documents, chosen by a hash of their id.

    ``labels(doc_id, quality)``: 1 good, 0 bad; rows with a null in either are no labels, a
    document with several labels counts as its worst.  The sample's ids are bounded, so they
    are broadcast; one row of statistics for each comes to the driver.
    """
    chosen = (labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
            .select("doc_id", "quality", statistics(F.col("text"))["features"].alias("features"))
            .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("features").alias("features"))
            .orderBy("doc_id").collect())
    if not rows:
        return None
    return fit(np.array([r.features for r in rows]), np.array([float(r.quality) for r in rows]), SIGNS, **options)


def judged(docs: DataFrame, forest: Forest | None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one struct column of :func:`verdict`; its name is returned by ``fresh("quality", docs)``."""
    return docs.withColumn(fresh("quality", docs), verdict(F.col("text"), forest, threshold))


def keep_good(docs: DataFrame, forest: Forest | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they were."""
    at = fresh("quality", docs)
    return judged(docs, forest, threshold).where(F.col(at)["kept"]).select(*(docs[c] for c in docs.columns))
