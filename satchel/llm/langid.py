"""Language identification as a mixture of languages in each document.

A language is a distribution over hashed letter trigrams.  Expectation-maximisation
finds each document's proportions of all languages; sets of the one, two, ... largest are
then fitted again, and the set with the best penalised likelihood (log-likelihood less
half of log n for each further language) is selected.  Sets grow as long as that rises,
whatever their size.  All documents of a slice of a batch that still rise step together.

Null texts and texts without letters are ``und`` with score 0.  Without any learned
language every text is ``und``.  Equal texts get equal answers; ties go to the first
language by name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from satchel.llm.common import in_slices, texts

#: Trigrams are counted in so many bins, so a model has a bounded size.
BINS = 1 << 15
#: Documents that each language is learned from, about: a fraction of its rows is chosen by a hash of their id.
SAMPLE = 4000
#: Languages that one model may have.
MOST_LANGUAGES = 500
#: Characters of a batch that are fitted at once.
SLICE = 1_500_000
#: Sets up to this size are tried for every document; a larger one while the size before it was the best yet.
ALWAYS, STEPS = 3, 12


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    #: Log-probability of a bin, by bin and language.
    logs: np.ndarray


class _Letters:
    """For each code point its lower-case form, and 32 for what is no letter; built once in a worker."""

    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        if cls.table is None:
            table = np.full(0x110000, 32, np.uint32)
            for c in range(0x110000):
                x = chr(c)
                if x.isalpha():
                    table[c] = ord(x.lower()[0])
            cls.table = table
        return cls.table


def trigram_bins(raws: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the letters of each text: (document, bin) of every trigram, and which documents have a letter."""
    parts = [np.frombuffer((x or b"").decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for x in raws]
    ends = np.cumsum([len(p) + 2 for p in parts])
    flat = np.full(int(ends[-1]) if len(parts) else 0, 32, np.uint32)
    for p, e in zip(parts, ends):
        flat[e - 1 - len(p):e - 1] = p
    flat = _Letters.get()[flat]
    owner = np.repeat(np.arange(len(parts)), [len(p) + 2 for p in parts])
    letters = np.zeros(len(parts), bool)
    letters[owner[flat != 32]] = True
    mixed = flat[:-2] * np.uint32(0x9E3779B1) + flat[1:-1] * np.uint32(0x85EBCA6B) + flat[2:] * np.uint32(0xC2B2AE35)
    bins = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)
    # A trigram needs two letters at least, and lies within one text.
    good = ((flat[:-2] != 32).astype(np.int8) + (flat[1:-1] != 32) + (flat[2:] != 32) >= 2) & (owner[:-2] == owner[2:])
    return owner[:-2][good], bins[good].astype(np.int64), letters


def learn(docs: DataFrame, sample: int = SAMPLE, smoothing: float = 0.5) -> Model:
    """Fit on the rows of ``docs(doc_id, text, lang)`` with text and lang.

    Counting rows is one narrow pass; texts are read of about ``sample`` rows for each
    language.  What comes to the driver is at most ``MOST_LANGUAGES`` times ``BINS`` counts.
    """
    rows = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = dict(sorted((r.lang, r.n) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()))
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"More than {MOST_LANGUAGES} languages.")
    if not sizes:
        return Model((), np.zeros((BINS, 0)))
    names = tuple(sizes)
    place = {x: k for k, x in enumerate(names)}
    grain = 1 << 30
    share = F.create_map(*(F.lit(y) for x, n in sizes.items() for y in (x, int(grain * min(1.0, sample / n)))))
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < F.element_at(share, F.col("lang")))

    def count(batches):
        total = np.zeros((len(names), BINS), np.int64)
        for batch in batches:
            raws, langs = texts(batch.column("text")), batch.column("lang").to_pylist()
            for a, b in in_slices((len(x) for x in raws), SLICE):
                owner, bins, _ = trigram_bins(raws[a:b])
                kinds = np.array([place[x] for x in langs[a:b]])
                total += np.bincount(kinds[owner] * BINS + bins, minlength=len(names) * BINS).reshape(len(names), BINS)
        kind, at = np.nonzero(total)
        yield pa.record_batch([pa.array(kind, pa.int32()), pa.array(at, pa.int32()), pa.array(total[kind, at], pa.int64())], ["kind", "bin", "n"])

    counts = chosen.select("text", "lang").mapInArrow(count, "kind int, bin int, n bigint").groupBy("kind", "bin").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    table = np.full((BINS, len(names)), smoothing)
    table[got["bin"].to_numpy(), got["kind"].to_numpy()] += got["n"].to_numpy()
    return Model(names, np.log(table / table.sum(axis=0)))


def _fit(prob: np.ndarray, count: np.ndarray, starts: np.ndarray, owner: np.ndarray, share: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once: proportions and log-likelihoods.  Languages with share 0 stay out."""
    total = np.add.reduceat(count, starts)[:, None]
    for _ in range(steps):
        joint = prob * share[owner]
        joint *= (count / joint.sum(axis=1))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / total
    return share, np.add.reduceat(count * np.log((prob * share[owner]).sum(axis=1)), starts)


def mixtures(raws: list[bytes | None], model: Model, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each language in each text, and which texts have letters.

    A text with letters but without any trigram (one letter words only) gets equal proportions.
    """
    n, langs = len(raws), len(model.names)
    out = np.zeros((n, langs))
    if not langs:
        return out, np.zeros(n, bool)
    owner, bins, letters = trigram_bins(raws)
    out[letters] = 1 / langs
    if not len(owner):
        return out, letters
    key, count = np.unique(owner * BINS + bins, return_counts=True)
    owner, bins = key // BINS, key % BINS
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    docs = owner[starts]
    owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(owner)]))
    logs = model.logs[bins]
    top = logs.max(axis=1, keepdims=True)
    prob = np.exp(logs - top)
    full, _ = _fit(prob, count, starts, owner, np.full((len(docs), langs), 1 / langs), steps)
    order = np.argsort(-full, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(langs)[None, :].repeat(len(docs), 0), axis=1)
    penalty = 0.5 * np.log(np.maximum(np.add.reduceat(count, starts), 2))
    best, chosen = np.full(len(docs), -np.inf), np.zeros((len(docs), langs))
    rising = np.arange(len(docs))
    for k in range(1, langs + 1):
        start = np.where(rank[rising] < k, np.maximum(full[rising], 1e-6), 0)
        start /= start.sum(axis=1, keepdims=True)
        share, fitted = _fit(prob, count, starts, owner, start, steps if k > 1 else 0)
        gain = fitted - penalty[rising] * (k - 1)
        better = gain > best[rising]
        best[rising[better]] = gain[better]
        chosen[rising[better]] = share[better]
        if k >= ALWAYS:
            if not better.any():
                break
            held = better[owner]
            prob, count, rising = prob[held], count[held], rising[better]
            sizes = np.diff(np.r_[starts, len(owner)])[better]
            starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
    out[docs] = chosen
    return out, letters


def predict(text: Column, model: Model) -> Column:
    """``lang_pred``, ``score`` (its proportion) and ``langs``, the selected set with proportions."""

    def guess(array: pa.Array) -> pa.Array:
        raws = texts(array)
        names, scores, sets = [], [], []
        for a, b in in_slices((len(x or b"") * max(1, len(model.names) // 8) for x in raws), SLICE):
            share, letters = mixtures(raws[a:b], model)
            for row, known in zip(share, letters):
                if not known:
                    names.append("und"), scores.append(0.0), sets.append([])
                    continue
                k = int(np.argmax(row))
                names.append(model.names[k])
                scores.append(min(1.0, float(row[k])))
                sets.append([{"lang": model.names[j], "share": float(row[j])} for j in np.argsort(-row, kind="stable") if row[j] > 0])
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                                           pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                                          ["lang_pred", "score", "langs"])

    return F.arrow_udf(guess, "struct<lang_pred: string, score: double, langs: array<struct<lang: string, share: double>>>").asNondeterministic()(text)
