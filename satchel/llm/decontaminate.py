"""Benchmark decontamination: SimHash fingerprints of item-sized windows, then exact similarity.

An item is the bag of its five-word shingles, weighted by how often they occur.  Words are
runs of letters, digits and underscores in lower case, so neither capitals nor punctuation
hide a passage.  A document contains an item if one of its windows
of as many words as the item has a weighted Jaccard similarity of ``LEAST`` or more with
it.  An item of fewer than five words is one shingle; a document shorter than an item is
one window.

1. The benchmark is cut into blocks of bounded size; each block is broadcast and all
   documents pass it once.
2. Every window of every length in the block is looked at: a window can only reach the
   similarity if that share of an item's shingles occurs in it.  Running counts of the
   shingles that items of this length have rule out the rest exactly.
3. What remains gets a 64-bit SimHash.  Items are indexed by eight blocks of eight bits,
   each under all values within two bits.  Fingerprints within 23 bits differ by at most
   two bits in some block, so every item within the radius is found.
4. The exact similarity decides.

Null texts and texts without words contain nothing; such items are contained nowhere.  Equal
rows get equal answers.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from satchel.llm.common import texts

SHINGLE, LEAST, RADIUS = 5, 0.8, 23
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 16 << 20


_WORD = re.compile(r"\w+")


def words_of(raw: bytes | None) -> list[str]:
    return _WORD.findall(raw.decode("utf-8", "replace").lower()) if raw else []


def _shingles(words: list) -> list[tuple]:
    size = min(SHINGLE, len(words))
    return [tuple(words[k:k + size]) for k in range(len(words) - size + 1)] if words else []


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    common = sum((a & b).values())
    union = sum(a.values()) + sum(b.values()) - common
    return common / union if union else 0.0


class _Bits(dict):
    """Shingle to its 64 signs."""

    def __missing__(self, shingle: tuple) -> np.ndarray:
        h = np.frombuffer(xxhash.xxh3_64_digest("\x00".join(shingle).encode()), np.uint8)
        if len(self) > 100_000:
            self.clear()
        out = self[shingle] = np.unpackbits(h).astype(np.int32) * 2 - 1
        return out


class Index:
    """A block of the benchmark: its shingles, and its fingerprints by blocks of bits."""

    def __init__(self, items: list[tuple[int, bytes]], least: float = LEAST):
        self.least, self.bits = least, _Bits()
        split = [(i, words_of(x)) for i, x in items]
        split = [(i, w) for i, w in split if w]
        self.ids = [i for i, _ in split]
        self.bags = [Counter(_shingles(w)) for _, w in split]
        self.lengths: defaultdict[int, list[int]] = defaultdict(list)
        for k, (_, w) in enumerate(split):
            self.lengths[len(w)].append(k)
        self.sizes = sorted(self.lengths)
        self.smallest: dict[int, int] = {n: int(np.ceil(least * max(1, n - SHINGLE + 1) - 1e-9)) for n in self.sizes}
        self.words = {w: k + 1 for k, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        base = len(self.words) + 1
        self.powers = [base**k for k in range(SHINGLE)]
        self.exact = base**SHINGLE < 2**62
        self.full, self.sizes_of = self._known([w for _, w in split if len(w) >= SHINGLE])
        # Shorter items have one shingle each, the whole item.
        self.brief: defaultdict[int, set[tuple]] = defaultdict(set)
        for _, w in split:
            if len(w) < SHINGLE:
                self.brief[len(w)].add(tuple(w))
        self.prints = np.array([self.fingerprint(b) for b in self.bags], np.uint64)
        self.near: list[dict[int, np.ndarray]] = []
        ones = np.array([bin(x).count("1") for x in range(256)])
        for k in range(8):
            mine = ((self.prints >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64) if split else np.zeros(0, np.int64)
            self.near.append({v: np.flatnonzero(ones[mine ^ v] <= RADIUS // 8) for v in range(256)})

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of shingles from numbers of words; 0 where a word is not in the block."""
        n = len(ids) - SHINGLE + 1
        kind = np.int64 if self.exact else np.uint64
        out, good = np.zeros(n, kind), np.ones(n, bool)
        for k in range(SHINGLE):
            part = ids[k:k + n]
            good &= part > 0
            out = out * kind(self.powers[1] if self.exact else 0x9E3779B97F4A7C15) + part.astype(kind)
        return np.where(good, out, 0)

    def _known(self, items: list[list[str]]) -> tuple[np.ndarray, list[list[int]]]:
        """The numbers of all shingles, and the lengths of the items that each occurs in."""
        where: defaultdict[int, set[int]] = defaultdict(set)
        for ws in items:
            for code in self._codes(np.array([self.words[w] for w in ws])).tolist():
                where[code].add(len(ws))
        known = sorted(where)
        return np.array(known, np.int64 if self.exact else np.uint64), [sorted(where[c]) for c in known]

    def fingerprint(self, bag: Counter) -> int:
        total = np.zeros(64, np.int64)
        for shingle, weight in bag.items():
            total += weight * self.bits[shingle]
        return int.from_bytes(np.packbits(total > 0).tobytes(), "little")

    def candidates(self, print_: int) -> np.ndarray:
        """All items whose fingerprints lie within the radius."""
        found = np.unique(np.concatenate([self.near[k][print_ >> (8 * k) & 255] for k in range(8)]))
        apart = self.prints[found] ^ np.uint64(print_)
        return found[np.bitwise_count(apart) <= RADIUS]

    def matches(self, raw: bytes | None) -> dict[int, tuple[float, int]]:
        """Items that a text contains: the best similarity and the first word of that window."""
        words = words_of(raw)
        if not words or not self.sizes:
            return {}
        n = len(words)
        best: dict[int, tuple[float, int]] = {}
        hits: defaultdict[int, list[int]] = defaultdict(list)
        if n >= SHINGLE and len(self.full):
            get = self.words.get
            codes = self._codes(np.array([get(w, 0) for w in words]))
            at = np.minimum(np.searchsorted(self.full, codes), len(self.full) - 1)
            for s in np.flatnonzero((codes != 0) & (self.full[at] == codes)).tolist():
                for size in self.sizes_of[at[s]]:
                    hits[size].append(s)
        for size in self.brief if n >= SHINGLE else self.sizes:
            hits[size] = hits.get(size, [])
        for size, places in sorted(hits.items()):
            span = min(size, n)
            if span < SHINGLE:
                # One shingle each; a document of so few words can only equal a short item.
                known = self.brief.get(span, ())
                starts = [s for s in range(n - span + 1) if tuple(words[s:s + span]) in known]
            else:
                width = span - SHINGLE + 1
                mark = np.zeros(n - SHINGLE + 2, np.int64)
                mark[np.array(places, np.int64) + 1] = 1
                running = np.cumsum(mark)
                starts = np.flatnonzero(running[width:] - running[:-width] >= self.smallest[size]).tolist()
            for s in starts:
                bag = Counter(_shingles(words[s:s + span]))
                for k in self.candidates(self.fingerprint(bag)):
                    if k in self.lengths[size]:
                        close = similarity(bag, self.bags[k])
                        if close >= self.least and close > best.get(self.ids[k], (0.0, 0))[0]:
                            best[self.ids[k]] = (close, s)
        return best


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The items of ``benchmark(item_id, text)`` in blocks of bounded size, read one block at a time."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-int(size) // most))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for k in range(count):
        yield [(r.item_id, r.text.encode()) for r in items.where(part == k).orderBy("item_id", "text").collect()]


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, item_id, similarity, first_word`` for each item that a document contains.

    One row for each pair; a repeated doc_id counts once with its best window.
    """
    found = None
    spark = docs.sparkSession
    for items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, least)
            for batch in batches:
                rows = [(i, item, *got) for i, raw in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")))
                        for item, got in sorted(index.matches(raw).items())]
                yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in
                                       enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))],
                                      ["doc_id", "item_id", "similarity", "first_word"])

        part = docs.select("doc_id", "text").mapInArrow(search, "doc_id bigint, item_id bigint, similarity double, first_word bigint")
        found = part if found is None else found.unionByName(part)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("back")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("first_word"))


def _clean(shared, least: float):
    """Whether a text contains none of the broadcast items, for each text of a batch."""
    index: list[Index] = []

    def run(column: pa.Array) -> pa.Array:
        # A task has its own list, so the index is built once in each.
        if not index:
            index.append(Index(shared.value, least))
        return pa.array([not index[0].matches(x) for x in texts(column)], pa.bool_())

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without the rows that contain an item; other rows as they were.  Each row answers for its own text, whatever its id."""
    for items in blocks(benchmark):
        clean = _clean(docs.sparkSession.sparkContext.broadcast(items), least)
        docs = docs.where(F.arrow_udf(clean, "boolean").asNondeterministic()(F.col("text")))
    return docs
