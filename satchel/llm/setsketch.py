"""Near-duplicates by SetSketch registers.

A document is the set of its five-word shingles (hashed to 64 bits).  A register holds an
exponentially spaced, truncated minimum over the set: ``floor(1 - log_base(min))`` of an
exponential value for each shingle, kept within one byte.  Registers of a union are the
maxima of the registers, and two documents agree in a register about as often as their
sets are alike.

1. Equal sets are one class, represented by its smallest document.
2. Bands of registers are keys.  In each key's group all members are paired with the
   smallest one only.
3. A pair's registers and set sizes give its most likely similarity; what is clearly
   below the threshold goes, the rest is confirmed on the full sets.
4. A group whose members are all linked is done.  Members of the others meet in blocks of
   bounded size: in a task, pairs of members not yet linked are estimated from their
   registers, confirmed on full sets and joined, so a block gives at most as many links as
   it has members and no link between different texts is lost.
5. Connected components of the links.

The bands are chosen so that a pair just at the threshold is missed with a chance of less
than one in 100,000.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from satchel.llm.common import fresh, texts
from satchel.llm.components import components
from satchel.plans.session import stage

#: Registers of a document, one byte each, spaced by this base.
REGISTERS, BASE = 256, 1.2
#: A register of an empty set would be 0; the rate puts small sets well above it.
RATE, TOP = 20.0, 255
SHINGLE = 5
MISSED = 1e-5
#: Members of a block in step 4; pairs that are estimated at once.
BLOCK, SLICE = 256, 500
#: Hashed words that a worker remembers.
MEMORY = 200_000
_MULTIPLIERS = (np.random.default_rng(20).integers(0, 1 << 32, REGISTERS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


class _Words(dict):
    """Hashes of words; emptied when full."""

    _own: _Words | None = None

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    @classmethod
    def get(cls) -> _Words:
        if cls._own is None:
            cls._own = cls()
        return cls._own


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(raw: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles.

    A-Z count as a-z.  Fewer words than a shingle: the whole sequence is one.  No words: none.
    """
    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    of = np.fromiter(map(_Words.get().__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(of))
    n = len(of) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + of[k:k + n])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set that is not empty."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    small = _mix(hashes).astype(np.uint32)
    for k in range(0, len(small), 256):
        np.minimum(low, (small[k:k + 256, None] * _MULTIPLIERS[None, :]).min(axis=0), out=low)
    value = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(value) / math.log(BASE)), 0, TOP).astype(np.uint8)


def _agree(x: np.ndarray) -> np.ndarray:
    return -np.log(1 - x * (BASE - 1) / BASE) / math.log(BASE)


def likely_similarity(greater, less, size_a, size_b) -> np.ndarray:
    """The Jaccard similarity that makes the numbers of greater and smaller registers most likely."""
    greater, less, size_a, size_b = (np.atleast_1d(np.asarray(x, float)) for x in (greater, less, size_a, size_b))
    u = size_a / (size_a + size_b)
    v = 1 - u
    share = np.linspace(0, 1, 65)
    best, out = np.full(len(u), -np.inf), np.zeros(len(u))
    for s in share:
        j = s * np.minimum(u / v, v / u)
        up, down = _agree(np.clip(u - v * j, 1e-9, 1)), _agree(np.clip(v - u * j, 1e-9, 1))
        fit = greater * np.log(up) + less * np.log(down) + (REGISTERS - greater - less) * np.log(np.maximum(1 - up - down, 1e-12))
        out, best = np.where(fit > best, j, out), np.maximum(fit, best)
    return out


def rows_of_band(threshold: float) -> int:
    """The longest bands that miss a pair at the threshold rarely enough."""
    same = 1 - 2 * float(_agree(np.array((1 - threshold) / 2)))
    return max((r for r in range(1, 33) if (1 - same**r) ** (REGISTERS // r) <= MISSED), default=1)


def margin(threshold: float) -> float:
    """An estimate below this is five standard deviations from the threshold."""
    return threshold - 5 * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _sketch(with_sets: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws = batch.column("doc_id").to_pylist(), texts(batch.column("text"))
            for at in range(0, len(ids), 1000):
                sets = [shingles(x) for x in raws[at:at + 1000]]
                cells = [pa.array(ids[at:at + 1000], batch.schema.field("doc_id").type), pa.array([len(s) for s in sets], pa.int64()),
                         pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary())]
                last = [s.tobytes() if with_sets else xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.record_batch([*cells, pa.array(last, pa.binary())], ["doc_id", "n_shingles", "regs", "hashes" if with_sets else "same"])

    return run


def sketches(docs: DataFrame, with_sets: bool = False) -> DataFrame:
    """``doc_id, n_shingles, regs`` and a digest of the set (``same``) or the set (``hashes``)."""
    return docs.select("doc_id", "text").mapInArrow(
        _sketch(with_sets), "doc_id bigint, n_shingles bigint, regs binary, " + ("hashes binary" if with_sets else "same binary"))


def _confirm(percent: int):
    least = margin(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                x = {n: batch.column(n).slice(at, SLICE).to_pylist() for n in batch.schema.names}
                ra, rb = (np.frombuffer(b"".join(x[k]), np.uint8).reshape(-1, REGISTERS) for k in ("regs_a", "regs_b"))
                sizes = [np.array([len(s) // 8 for s in x[k]]) for k in ("set_a", "set_b")]
                likely = likely_similarity((ra > rb).sum(1), (ra < rb).sum(1), *sizes)
                good = [k for k in np.flatnonzero(likely >= least) if _linked(_set(x["set_a"][k]), _set(x["set_b"][k]), percent)]
                yield pa.record_batch([pa.array([x[n][k] for k in good], pa.int64()) for n in ("a", "b")], ["a", "b"])

    return run


def _within_blocks(percent: int):
    least = margin(percent / 100)

    def run(table: pa.Table) -> pa.Table:
        ids, roots, side = (table.column(n).to_numpy() for n in ("doc_id", "root", "side"))
        regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint8).reshape(-1, REGISTERS)
        sets = [_set(x) for x in table.column("hashes").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := parent.get(x, x)) != x:
                parent[x] = parent.get(y, y)
                x = y
            return x

        one = len(set(side.tolist())) == 1
        left = np.arange(len(ids)) if one else np.flatnonzero(side == 0)
        right = np.arange(len(ids)) if one else np.flatnonzero(side == 1)
        firsts, seconds, counts = [], [], []
        for i in left:
            other = right[(roots[right] != roots[i]) & (100 * np.minimum(sizes[right], sizes[i]) >= percent * np.maximum(sizes[right], sizes[i]))]
            if one:
                other = other[other > i]
            # Registers agree at least as often as the sets do: a first, cheap bound.
            same = (regs[i] == regs[other]).sum(1)
            other = other[same >= least * REGISTERS]
            if len(other):
                firsts.append(np.full(len(other), i))
                seconds.append(other)
                counts.append(np.stack([(regs[i] > regs[other]).sum(1), (regs[i] < regs[other]).sum(1)]))
        out = []
        if firsts:
            first, second, count = np.concatenate(firsts), np.concatenate(seconds), np.concatenate(counts, axis=1)
            likely = np.concatenate([likely_similarity(count[0, k:k + 20_000], count[1, k:k + 20_000], sizes[first[k:k + 20_000]], sizes[second[k:k + 20_000]])
                                     for k in range(0, len(first), 20_000)])
            for k in np.flatnonzero(likely >= least):
                i, j = first[k], second[k]
                if find(roots[i]) != find(roots[j]) and _linked(sets[i], sets[j], percent):
                    parent[find(roots[i])] = find(roots[j])
                    out.append((ids[i], ids[j]))
        return pa.table([pa.array([int(x[k]) for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``.

    Two documents are linked if ``100 * intersection >= percent * union`` of their sets.
    Null and empty texts, and texts without words, have no set and are linked with nothing.
    Of equal texts the smallest doc_id stands for all.  Each row answers for its own text;
    rows that repeat both id and text get equal answers.  A row without id stays out: it
    gets the component of its text if others have it, else null, and is kept.
    """
    own = stage(sketches(docs), "sketches")
    filled = own.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stage(filled.groupBy("same").agg(F.min(F.struct("doc_id", "regs")).alias("rep")).select("same", "rep.doc_id", "rep.regs"), "classes")

    rows = rows_of_band(percent / 100)
    keys = classes.select("doc_id", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(REGISTERS // rows - 1)),
        lambda k: F.xxhash64(k, F.substring(F.col("regs"), k * rows + 1, F.lit(rows))))).alias("key"))
    groups = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key", "first")
    held = stage(keys.join(groups, "key"), "groups")
    pairs = held.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    near = held.select("doc_id").distinct()
    full = stage(sketches(docs.select("doc_id", "text").join(near, "doc_id", "left_semi"), with_sets=True), "sets")
    sides = [full.select(F.col("doc_id").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("hashes").alias(f"set_{x}")) for x in "ab"]
    links = stage(pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(_confirm(percent), "a bigint, b bigint"), "links")

    # The first of a group has met all others; they meet each other where they are not linked yet.
    roots = components(links)
    others = held.where("doc_id <> first")
    rooted = stage(others.join(roots, others.doc_id == roots.node, "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root")), "rooted")
    unmet = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    spread = rooted.join(unmet.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "key").withColumn(
        "mine", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    met = spread.select("key", "doc_id", "root", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "doc_id", "root",
        F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"))
    more = met.join(full.select("doc_id", "regs", "hashes"), "doc_id").groupBy("key", "x", "y").applyInArrow(_within_blocks(percent), "a bigint, b bigint")
    roots = components(links.union(stage(more, "links")))

    placed = own.join(classes.select("same", F.col("doc_id").alias("rep")), "same", "left")
    return placed.join(roots, placed.rep == roots.node, "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "rep", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of smallest doc_id; their columns stay as they were.

    Each row is a document of its own, also where rows share an id: of equal ids in a group
    one row stays.  Rows without id, and texts without words, are in no group.
    """
    row = fresh("row", docs)
    own = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    ids = own.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    found = near_duplicates(own.where("doc_id IS NOT NULL").select(F.col(row).alias("doc_id"), "text"), percent).select(F.col("doc_id").alias("row"), "component_id")
    first = found.join(ids, "row").groupBy("component_id").agg(F.min(F.struct("id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    kept = first.unionByName(ids.where("id IS NULL").select("row")).withColumnRenamed("row", row)
    return own.join(kept, row, "left_semi").select(*docs.columns)
