"""Reversible line deduplication: exact reference counts, and cuckoo filters of the frequent lines.

A line's key is its text without white space at both ends, with A-Z in lower case.  The
state of a corpus is two tables:

* ``counts(shard, key, n_docs)`` and ``holders(shard, key, doc_id)``: for each key (128-bit
  hash) of a long enough line, in how many documents it occurs, and in which.  Both are exact.
* ``filters(shard, cells)``: per shard a cuckoo filter of the keys that have reached the
  threshold.  A key can be removed from it, so the filters follow insertions and deletions.

Reading documents against a state, a line is looked up in the filters first; only what
they report is joined with the exact counts, so false reports change nothing and few lines
move.  Filters of up to ``MOST_BROADCAST`` bytes in all are broadcast; beyond that the
lines go to their shards.

Inserting documents adds to the counts, deleting takes away; a line that falls below the
threshold comes back.  Documents are named by doc_id; rows that repeat one add up to one
document.  Rows without doc_id hold no lines against others and lose none of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from satchel.llm.common import fresh, texts
from satchel.plans.session import stage

LEAST_CHARS, LEAST_DOCS = 40, 5
#: Filters are broadcast up to so many bytes.
MOST_BROADCAST = 32 << 20
#: Frequent keys that a shard's filter is meant for.
SHARD_KEYS = 20_000
SLOTS, KICKS = 4, 500


class Cuckoo:
    """A cuckoo filter: buckets of four 16-bit fingerprints, each with one other bucket."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.mask = cells, len(cells) - 1

    @classmethod
    def sized(cls, keys: int) -> Cuckoo:
        buckets = 1
        while buckets * SLOTS * 0.8 < keys + 1:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def load(cls, raw: bytes) -> Cuckoo:
        return cls(np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.cells.tobytes()

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and the two buckets of keys (unsigned 64-bit)."""
        print_ = (keys >> np.uint64(48)).astype(np.uint16)
        print_ = np.where(print_ == 0, np.uint16(1), print_)
        first = (keys & np.uint64(self.mask)).astype(np.int64)
        return print_, first, self.other(first, print_)

    def other(self, bucket, print_):
        return bucket ^ ((np.asarray(print_).astype(np.int64) * 0x5BD1E995) & self.mask)

    def has(self, keys: np.ndarray) -> np.ndarray:
        print_, a, b = self.places(keys)
        return (self.cells[a] == print_[:, None]).any(1) | (self.cells[b] == print_[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Add keys; False if there is no room, when the filter is to be rebuilt larger."""
        for p, a, b in zip(*(x.tolist() for x in self.places(keys))):
            at = a
            for turn in range(KICKS):
                row = self.cells[at]
                free = np.flatnonzero(row == 0)
                if len(free):
                    row[free[0]] = p
                    break
                if turn == 0 and at != b:
                    at = b
                    continue
                slot = (turn * 7 + at) % SLOTS
                p, row[slot] = int(row[slot]), p
                at = int(self.other(at, p))
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Take out keys that were inserted."""
        for p, a, b in zip(*(x.tolist() for x in self.places(keys))):
            for at in (a, b):
                slots = np.flatnonzero(self.cells[at] == p)
                if len(slots):
                    self.cells[at, slots[0]] = 0
                    break


def build(keys: np.ndarray) -> Cuckoo:
    """A filter with all keys, as large as needed."""
    room = len(keys)
    while not (made := Cuckoo.sized(room)).insert(keys):
        room *= 2
    return made


def line_key(line: bytes, least: int = LEAST_CHARS) -> bytes | None:
    """The hash of a line's key, or None if the key is short.  White space and case as documented."""
    if len(line) < least:
        return None
    key = line.strip().lower()
    if len(key) < least or (not key.isascii() and len(key.decode("utf-8", "replace")) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, raws = batch.column("doc_id").to_pylist(), texts(batch.column("text"))
        out: list[tuple[int, bytes]] = []
        for at, (i, raw) in enumerate(zip(ids, raws)):
            if i is not None and raw:
                out.extend((i, k) for k in {line_key(x) for x in raw.split(b"\n")} if k)
            if len(out) > 50_000 or at == len(ids) - 1:
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["doc_id", "key"])
                out = []


def line_keys(docs: DataFrame) -> DataFrame:
    """``doc_id, key``: the distinct keys of each row's long lines."""
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_keys_of, "doc_id bigint, key binary")


@dataclass(frozen=True)
class State:
    """What a corpus holds.  ``shards`` is fixed when it begins."""

    holders: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    least_docs: int


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")


def _u64(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), "<u8").astype(np.uint64)


def _filters(counts: DataFrame, least_docs: int) -> DataFrame:
    """One filter for each shard, from the exact counts."""

    def make(table: pa.Table) -> pa.Table:
        made = build(_u64(table.column("key").to_pylist()))
        return pa.table([table.column("shard").slice(0, 1).cast(pa.int32()), pa.array([made.dump()], pa.binary())], ["shard", "cells"])

    return counts.where(F.col("n_docs") >= least_docs).select("shard", "key").groupBy("shard").applyInArrow(make, "shard int, cells binary")


def begin(docs: DataFrame, least_docs: int = LEAST_DOCS, shards: int | None = None) -> State:
    """The state of a first set of documents.

    A row is kept for each key and document, so that both can be taken out again.  Unless
    given, the number of shards is such that none can hold more than ``SHARD_KEYS`` frequent
    keys on average: each of them takes ``least_docs`` rows.  It stays when documents come and go.
    """
    rows = stage(line_keys(docs).distinct(), "holders")
    shards = shards or 1 + rows.count() // (least_docs * SHARD_KEYS)
    holders = rows.withColumn("shard", _shard(shards))
    counts = stage(_counted(holders), "counts")
    return State(holders, counts, stage(_filters(counts, least_docs), "filters"), shards, least_docs)


def _counted(holders: DataFrame) -> DataFrame:
    return holders.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last"))


def _changed(state: State, holders: DataFrame, touched: DataFrame) -> State:
    """Count the touched keys anew and carry over the others; the filters follow what crossed the threshold."""
    keys = touched.select("shard", "key").distinct()
    fresh_counts = stage(_counted(holders.join(keys, ["shard", "key"], "left_semi")), "counts")
    counts = stage(state.counts.join(keys, ["shard", "key"], "left_anti").unionByName(fresh_counts), "counts")
    least = state.least_docs
    old = state.counts.where(F.col("n_docs") >= least).join(keys, ["shard", "key"], "left_semi").select("shard", "key")
    new = fresh_counts.where(F.col("n_docs") >= least).select("shard", "key")
    moves = old.join(new, ["shard", "key"], "left_anti").withColumn("up", F.lit(False)).unionByName(
        new.join(old, ["shard", "key"], "left_anti").withColumn("up", F.lit(True)))
    held = counts.where(F.col("n_docs") >= least).select("shard", "key").withColumn("up", F.lit(None).cast("boolean"))

    def update(key, cells: pa.Table, rows: pa.Table) -> pa.Table:
        up = rows.column("up").to_pylist()
        keys = rows.column("key").to_pylist()
        filter_ = Cuckoo.load(cells.column("cells")[0].as_py()) if cells.num_rows else Cuckoo.sized(0)
        filter_.delete(_u64([k for k, u in zip(keys, up) if u is False]))
        if not filter_.insert(_u64([k for k, u in zip(keys, up) if u is True])):
            filter_ = build(_u64([k for k, u in zip(keys, up) if u is None]))
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([filter_.dump()], pa.binary())], ["shard", "cells"])

    filters = state.filters.groupBy("shard").cogroup(moves.unionByName(held).groupBy("shard")).applyInArrow(update, "shard int, cells binary")
    return State(holders, counts, stage(filters, "filters"), state.shards, least)


def insert(state: State, docs: DataFrame) -> State:
    """The state with further documents; ids it has already gain the lines they lack."""
    added = stage(line_keys(docs).withColumn("shard", _shard(state.shards)).join(state.holders, ["doc_id", "key", "shard"], "left_anti").distinct(), "holders")
    return _changed(state, state.holders.unionByName(added), added)


def delete(state: State, ids: DataFrame) -> State:
    """The state without the documents named in ``ids(doc_id)``."""
    gone = state.holders.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    holders = stage(state.holders.join(ids.select("doc_id").distinct(), "doc_id", "left_anti"), "holders")
    return _changed(state, holders, stage(gone, "holders"))


def reported(state: State) -> DataFrame:
    """``shard, key, doc_id`` of the holders that the filters report as frequent, false reports included."""
    size = state.filters.agg(F.sum(F.length("cells"))).first()[0] or 0
    schema = state.holders.select("shard", "key", "doc_id").schema
    rows = state.holders.select("shard", "key", "doc_id")
    if size <= MOST_BROADCAST:
        shared = state.holders.sparkSession.sparkContext.broadcast({r.shard: bytes(r.cells) for r in state.filters.collect()})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = {s: Cuckoo.load(x) for s, x in shared.value.items()}
            for batch in batches:
                yield batch.filter(pa.array(_reports(loaded, batch.column("shard").to_numpy(), batch.column("key").to_pylist())))

        return rows.mapInArrow(probe, schema)

    def meet(key, cells: pa.Table, lines: pa.Table) -> pa.Table:
        loaded = {s: Cuckoo.load(x) for s, x in zip(cells.column("shard").to_pylist(), cells.column("cells").to_pylist())}
        return lines.filter(pa.array(_reports(loaded, lines.column("shard").to_numpy(), lines.column("key").to_pylist())))

    # Parts of a shard's lines, so that a frequent line does not make one task.
    parts = 64
    spread = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    copies = state.filters.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return copies.groupBy("shard", "part").cogroup(spread.groupBy("shard", "part")).applyInArrow(
        lambda key, a, b: meet(key, a, b.select(["shard", "key", "doc_id"])), schema)


def _reports(loaded: dict[int, Cuckoo], shard: np.ndarray, keys: list[bytes]) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    values = _u64(keys)
    for s in np.unique(shard):
        if int(s) in loaded:
            at = np.flatnonzero(shard == s)
            out[at] = loaded[int(s)].has(values[at])
    return out


def losses(state: State) -> DataFrame:
    """``doc_id, lost``: the keys whose lines a document loses: frequent ones it is not the largest holder of."""
    frequent = state.counts.where(F.col("n_docs") >= state.least_docs).select("key", "last")
    return (reported(state).select("key", "doc_id").join(frequent, "key").where("doc_id < last")
            .groupBy("doc_id").agg(F.collect_set("key").alias("lost")))


def rebuild(text: Column, lost: Column) -> Column:
    """``n_lines``, ``n_dropped`` and ``text`` without the lines whose keys are lost.  Null text: one empty line."""

    def run(raws: pa.Array, keys: pa.Array) -> pa.Array:
        rows = []
        for raw, gone in zip(texts(raws), keys.to_pylist()):
            lines = (raw or b"").split(b"\n")
            kept = lines if not gone else [x for x, k in zip(lines, map(line_key, lines)) if k is None or k not in gone]
            rows.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                                           pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())], ["n_lines", "n_dropped", "text"])

    return F.arrow_udf(run, "struct<n_lines: bigint, n_dropped: bigint, text: string>").asNondeterministic()(text, lost)


def resolve(docs: DataFrame, state: State) -> DataFrame:
    """``docs`` with a struct of :func:`rebuild` as last column, named by ``fresh("lines", docs)``.

    Null and empty texts have one empty line and stay as they are.
    """
    at = fresh("lines", docs)
    side = losses(state).select(F.col("doc_id").alias(fresh("lost_id", docs)), F.col("lost").alias(fresh("lost", docs)))
    return docs.join(side, docs.doc_id == side[side.columns[0]], "left").select(
        *(docs[c] for c in docs.columns), rebuild(docs.text, side[side.columns[1]]).alias(at))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts rebuilt; other columns as they were, a null text stays null."""
    at = fresh("lines", docs)
    new = F.when(F.col("text").isNotNull(), F.col(at)["text"]).alias("text")
    return resolve(docs, begin(docs)).select(*(new if c == "text" else F.col(c) for c in docs.columns))
