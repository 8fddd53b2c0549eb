"""Trie of conversation prefixes, built by adaptive radix trees over ids of turns.

A turn (role, text) has an id of 16 bytes, a conversation is the ids of its turns one after the
other, and a node of the trie is a prefix of whole turns.  Several conversations may be one key;
its members' ids are hashed in order, however many there are.

* Conversations are dealt out by ranges of (key, conversation), so that no key, however
  common, fills a task; runs of equal keys become pieces of up to ``PIECE`` ids.
* Pieces are dealt out by ranges of keys.  A task builds an adaptive radix tree over each block of
  keys in order: nodes of 4, 16, 48 and 256 places that grow as needed, paths without branches as
  one node.  Only bytes that end a turn give nodes of the trie.
* All prefixes that are neither of the first nor of the last key of a block lie whole in it and are
  done.  Along these two keys a block hands on what it has added up, one row for each.  These rows are
  merged in key order on a stack, one frame for each turn: two rows a block, not the rows
  of the table.

The result has a row for each node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
``n_convs``, ``n_children``, ``n_leaves`` (childless nodes below or at the node), ``saved_tokens`` (over the
nodes below or at it, what members beyond the first would repeat of the last text, in bytes of UTF-8)
and ``ends_sha256`` (ids of the conversations that end here, ascending, comma-joined).

Null roles and texts are empty.  Turns with equal numbers come in the order of role and text, null
numbers first; repeated rows are repeated turns.  Rows without a conversation id belong to no
conversation and make no node.  A conversation without turns is a member of the root.  No conversations: no
nodes.  A conversation's ids, some 40 bytes a turn, are one row.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from satchel.plans.session import stage

WIDTH = 16
#: Ids of one key that are hashed at once.
PIECE = 4096
#: Keys and bytes of keys of one tree.
BLOCK_KEYS, BLOCK_BYTES = 20_000, 16 << 20
#: Parts in which the children of one node meet it.
SALT = 16
NOTHING = hashlib.sha256().hexdigest()


class Few:
    """Places in order of their byte, for 4 or 16 children."""

    __slots__ = ("room", "bytes", "nodes")

    def __init__(self, room: int = 4):
        self.room, self.bytes, self.nodes = room, bytearray(), []

    def get(self, byte: int) -> Node | None:
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node: Node) -> Few | Many | All:
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
            return self
        if len(self.nodes) == self.room:
            larger = Few(16) if self.room == 4 else Many()
            for b, n in self:
                larger.put(b, n)
            return larger.put(byte, node)
        self.bytes.insert(at, byte)
        self.nodes.insert(at, node)
        return self

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.nodes)


class Many:
    """A byte for each value names one of 48 places."""

    __slots__ = ("slots", "nodes")

    def __init__(self):
        self.slots, self.nodes = bytearray(256), []

    def get(self, byte: int) -> Node | None:
        return self.nodes[self.slots[byte] - 1] if self.slots[byte] else None

    def put(self, byte: int, node: Node) -> Many | All:
        if self.slots[byte]:
            self.nodes[self.slots[byte] - 1] = node
        elif len(self.nodes) == 48:
            larger = All()
            for b, n in self:
                larger.put(b, n)
            return larger.put(byte, node)
        else:
            self.nodes.append(node)
            self.slots[byte] = len(self.nodes)
        return self

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.nodes[s - 1]) for b, s in enumerate(self.slots) if s)


class All:
    """A place for each byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int) -> Node | None:
        return self.nodes[byte]

    def put(self, byte: int, node: Node) -> All:
        self.nodes[byte] = node
        return self

    def __iter__(self) -> Iterator[tuple[int, Node]]:
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


class Node:
    """A path without branches, the key that ends there if any, and what follows."""

    __slots__ = ("path", "end", "kids", "sizes", "n", "least", "open", "tops", "leaves", "saved")

    def __init__(self, path: bytes, sizes: list[int], end: tuple | None = None):
        self.path, self.sizes, self.end, self.kids = path, sizes, end, Few()
        self.n, self.least, self.open = 0, None, 0
        # Of the nodes of the trie below: those without a parent yet, childless ones, what they save.
        self.tops = self.leaves = self.saved = 0


def _shared(a: bytes, b: bytes, at: int = 0) -> int:
    """How many bytes of ``a`` stand in ``b`` from ``at``."""
    if b.startswith(a, at):
        return len(a)
    return next((k for k, (x, y) in enumerate(zip(a, memoryview(b)[at:])) if x != y), len(b) - at)


class RadixTree:
    def __init__(self):
        self.root = Node(b"", [])

    def insert(self, key: bytes, sizes: list[int], end: tuple[int, int, str]) -> None:
        """``sizes`` of the key's turns; ``end``: members, their smallest id, their digest."""
        node, above, at = self.root, None, 0
        while True:
            same = _shared(node.path, key, at)
            if same < len(node.path):
                upper = Node(node.path[:same], node.sizes)
                upper.kids = upper.kids.put(node.path[same], node)
                node.path = node.path[same:]
                above.kids = above.kids.put(upper.path[0], upper)
                node = upper
            at += same
            if at == len(key):
                node.end, node.sizes = end, sizes
                return
            if (below := node.kids.get(key[at])) is None:
                node.kids = node.kids.put(key[at], Node(key[at:], sizes, end))
                return
            node, above = below, node

    def mark(self, key: bytes, number: int) -> None:
        """The nodes on the way to a key are open."""
        node, at = self.root, 0
        while True:
            node.open = number
            at += len(node.path)
            if at == len(key):
                return
            node = node.kids.get(key[at])

    def in_order(self) -> list[tuple[Node, int, int]]:
        """(node, byte where its path begins, number of the node above) in key order, parents first."""
        found, left = [], [(self.root, 0, -1)]
        while left:
            node, at, above = left.pop()
            found.append((node, at, above))
            mine = len(found) - 1
            left += [(kid, at + len(node.path), mine) for _, kid in reversed(list(node.kids))]
        return found


def _depths(at: int, node: Node) -> range:
    """The turns that end on a node's path; the root has the trie's root."""
    return range(0 if not at and not node.path else at // WIDTH + 1, (at + len(node.path)) // WIDTH + 1)


def _grow(block: list[tuple[bytes, list[int], tuple[int, int, str]]]) -> tuple[list[tuple], list[tuple]]:
    """Nodes of the trie that lie whole in a block of keys in order, and what it adds to the others.

    Nodes: (conv_id, depth, parent_conv_id, path of an open parent, n_convs, n_children, n_leaves, saved, ends).
    Additions: (key, first depth, then a list by depth of each: n, least, children, leaves, saved, ends, size).
    """
    tree = RadixTree()
    for key, sizes, end in block:
        tree.insert(key, sizes, end)
    ends_of = block[0][0], block[-1][0]
    for number, key in enumerate(ends_of, 1):
        tree.mark(key, number)
    order = tree.in_order()
    for node, at, above in reversed(order):
        if node.end:
            node.n += node.end[0]
            node.least = node.end[1] if node.least is None else min(node.least, node.end[1])
        depths = _depths(at, node)
        own = node.tops, node.leaves, node.saved
        if depths and node.open:
            own = 0, 0, 0
        elif depths:
            own = 1, node.leaves or 1, node.saved + (node.n - 1) * sum(node.sizes[depths[0] - 1:depths[-1]])
        if above >= 0:
            up = order[above][0]
            up.n += node.n
            up.least = node.least if up.least is None else min(up.least, node.least)
            up.tops, up.leaves, up.saved = up.tops + own[0], up.leaves + own[1], up.saved + own[2]

    done: list[tuple] = []
    parents: list[tuple[int | None, int, bytes]] = []  # what the children of each node of the tree hang on: smallest member, depth, key
    for node, at, above in order:
        parent, depths = parents[above] if above >= 0 else (None, -1, b""), _depths(at, node)
        if node.open:
            parents.append((None, depths[-1], ends_of[node.open - 1]) if depths else parent)
            continue
        if not depths:
            parents.append(parent)
            continue
        saved, leaves = node.saved, node.leaves or 1
        for d in reversed(depths):
            deepest = d == depths[-1]
            saved += (node.n - 1) * node.sizes[d - 1]
            # The first turn of a path hangs on what is above, the others on one with the same members.
            least, hook = (node.least, None) if d > depths[0] else (parent[0], None if parent[0] is not None else _name(parent[2], parent[1]))
            ends = node.end[2] if deepest and node.end else NOTHING
            done.append((node.least, d, least, hook, node.n, node.tops if deepest else 1, leaves, saved, ends))
        parents.append((node.least, depths[-1], b""))
    common = _shared(ends_of[0], ends_of[1]) // WIDTH + 1
    added = [(ends_of[0], 0, _along(tree.root, ends_of[0], 0))]
    if len(block) > 1:
        added.append((ends_of[1], common, _along(tree.root, ends_of[1], common)))
    return done, added


def _along(node: Node, key: bytes, first: int) -> list[dict]:
    """What a block adds to the prefixes of a key from a depth on."""
    parts, at = [], 0
    while True:
        depths = _depths(at, node)
        for d in depths:
            deepest = d == depths[-1]
            parts.append({
                "n": node.n, "least": node.least, "children": node.tops if deepest else 0, "leaves": node.leaves if deepest else 0,
                "saved": node.saved if deepest else 0, "ends": node.end[2] if deepest and node.end else None, "size": node.sizes[d - 1] if d else 0})
        at += len(node.path)
        if at == len(key):
            return parts[first:]
        node = node.kids.get(key[at])


def _name(key: bytes, depth: int) -> bytes:
    return hashlib.sha256(key[:depth * WIDTH]).digest()[:WIDTH]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys, at most ``PIECE`` members in a row."""
    key, sizes, run = None, None, []

    for batch in batches:
        out: list[tuple] = []
        for k, s, i in zip(*(batch.column(c).to_pylist() for c in ("key", "sizes", "conv_id"))):
            if run and (k != key or len(run) == PIECE):
                out.append((key, sizes, run[0], len(run), ",".join(map(str, run))))
                run = []
            key, sizes = k, s
            run.append(i)
        yield _batch(out, _PIECES)
    if run:
        yield _batch([(key, sizes, run[0], len(run), ",".join(map(str, run)))], _PIECES)


_LONG = pa.int64()
_PIECES = pa.schema([("key", pa.binary()), ("sizes", pa.list_(_LONG)), ("first", _LONG), ("n", _LONG), ("ids", pa.string())])
_PART = pa.struct([("n", _LONG), ("least", _LONG), ("children", _LONG), ("leaves", _LONG), ("saved", _LONG), ("ends", pa.string()), ("size", _LONG)])
_NODE = [("conv_id", _LONG), ("depth", _LONG), ("parent_conv_id", _LONG), ("parent", pa.binary()), ("n_convs", _LONG), ("n_children", _LONG),
         ("n_leaves", _LONG), ("saved_tokens", _LONG), ("ends_sha256", pa.string())]
_TREES = pa.schema([*_NODE, ("key", pa.binary()), ("base", _LONG), ("parts", pa.list_(_PART))])
_SPINE = pa.schema([*_NODE, ("name", pa.binary())])
_SQL_NODE = ("conv_id bigint, depth bigint, parent_conv_id bigint, parent binary, n_convs bigint, n_children bigint, n_leaves bigint, "
             "saved_tokens bigint, ends_sha256 string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[int], tuple[int, int, str]]]:
    """Distinct keys in order, with their members' number, smallest id and digest."""
    now, sizes, n, least, digest = None, None, 0, 0, None
    for batch in batches:
        for k, s, first, m, ids in zip(*(batch.column(c).to_pylist() for c in _PIECES.names)):
            if k != now:
                if now is not None:
                    yield now, sizes, (n, least, digest.hexdigest())
                now, sizes, n, least, digest = k, s, 0, first, hashlib.sha256()
            digest.update(("," if n else "").encode() + ids.encode())
            n += m
    if now is not None:
        yield now, sizes, (n, least, digest.hexdigest())


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trees over blocks of keys: nodes that are done, and additions to the others."""

    def rows(block: list) -> Iterator[pa.RecordBatch]:
        done, added = _grow(block)
        for at in range(0, len(done), 10_000):
            yield _batch([(*x, None, None, None) for x in done[at:at + 10_000]], _TREES)
        yield _batch([(*[None] * len(_NODE), *x) for x in added], _TREES)

    block, size = [], 0
    for item in _keys(batches):
        block.append(item)
        size += len(item[0])
        if len(block) == BLOCK_KEYS or size >= BLOCK_BYTES:
            yield from rows(block)
            block, size = [], 0
    if block:
        yield from rows(block)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Additions in key order, added up on a stack: one frame for each turn of the present key."""
    path, frames, out = b"", [], []

    def close() -> None:
        x, depth = frames.pop(), len(frames)
        x["leaves"] = x["leaves"] or 1
        x["saved"] += (x["n"] - 1) * x["size"]
        out.append((x["least"], depth, None, _name(path, depth - 1) if depth else None, x["n"], x["children"], x["leaves"], x["saved"], x["ends"] or NOTHING, _name(path, depth)))
        if frames:
            frames[-1]["children"] += 1
            frames[-1]["leaves"] += x["leaves"]
            frames[-1]["saved"] += x["saved"]

    for batch in batches:
        for key, base, parts in zip(*(batch.column(c).to_pylist() for c in ("key", "base", "parts"))):
            same = _shared(path, key) // WIDTH
            while len(frames) > same + 1:
                close()
            for depth, part in enumerate(parts, base):
                if depth == len(frames):
                    frames.append(part)
                    continue
                x = frames[depth]
                x["least"] = min(x["least"], part["least"])
                x["ends"] = x["ends"] or part["ends"]
                for c in ("n", "children", "leaves", "saved"):
                    x[c] += part[c]
            path = key
            if len(out) > 10_000:
                yield _batch(out, _SPINE)
                out = []
    while frames:
        close()
    yield _batch(out, _SPINE)


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, key, sizes`` for ``turns(conv_id, turn, role, text)``: ids of the turns in order, and bytes of their texts."""
    blank = F.lit("")
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = rows.withColumn("id", F.substring(F.sha2(whole, 256), 1, 2 * WIDTH))
    narrow = stage(rows.select("conv_id", "turn", "id", F.octet_length("text").cast("bigint").alias("size")), "turns")
    # Only turns with equal numbers need their texts for the order.
    mark = F.xxhash64("id")
    tied = narrow.groupBy("conv_id", "turn").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a <> b").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    narrow = narrow.withColumn("place", F.lit(0))
    tied = stage(tied, "ties")
    if not tied.isEmpty():
        same = (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
        place = F.dense_rank().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
        placed = rows.join(tied, same, "left_semi").select("conv_id", "turn", "id", place.alias("p")).distinct()
        placed = placed.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("id").alias("i"), "p")
        narrow = narrow.join(placed, same & (F.col("id") == F.col("i")), "left").withColumn("place", F.coalesce("p", "place"))
    whole = narrow.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "place", "id", "size"))).alias("turns"))
    return whole.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: x["id"]), "")).alias("key"), F.transform("turns", lambda x: x["size"]).alias("sizes"))


def spliced(head: Column, head_sizes: Column, tail: Column, tail_sizes: Column, turns: Column) -> tuple[Column, Column]:
    """Key and sizes of the first ``turns`` turns of one conversation, then all after as many of the other."""
    nothing, none = F.lit(b""), F.array().cast("array<bigint>")
    key = F.concat(F.coalesce(F.substring(head, F.lit(1), turns * WIDTH), nothing), F.substring(tail, turns * WIDTH + 1, F.length(tail)))
    sizes = F.concat(F.coalesce(F.slice(head_sizes, F.lit(1), turns), none), F.slice(tail_sizes, turns + 1, F.size(tail_sizes)))
    return key, sizes


def nodes(found: DataFrame) -> DataFrame:
    """The trie's nodes for ``found(conv_id, key, sizes)``, one row for each conversation."""
    dealt = stage(found.select("key", "sizes", "conv_id"), "sequences").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = stage(dealt.mapInArrow(_pieces, "key binary, sizes array<bigint>, first bigint, n bigint, ids string"), "pieces")
    parts = "array<struct<n bigint, least bigint, children bigint, leaves bigint, saved bigint, ends string, size bigint>>"
    ordered = pieces.repartitionByRange("key").sortWithinPartitions("key", "first")
    trees = stage(ordered.mapInArrow(_built, f"{_SQL_NODE}, key binary, base bigint, parts {parts}"), "trees")
    added = trees.where("parts IS NOT NULL").select("key", "base", "parts")
    spine = stage(added.repartition(1).sortWithinPartitions("key", "base").mapInArrow(_merged, f"{_SQL_NODE}, name binary"), "spine")

    done = trees.where("parts IS NULL").select(*(f.name for f in _SPINE if f.name != "name"))
    columns = [c for c in done.columns if c != "parent"]
    # The root alone may have as many children as there are conversations.
    names = spine.select(F.col("name"), F.col("conv_id").alias("found"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    hung = done.where("parent IS NOT NULL").unionByName(spine.drop("name")).withColumn("salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALT)).cast("int"))
    hung = hung.join(names.withColumnRenamed("name", "parent"), ["parent", "salt"], "left").withColumn("parent_conv_id", F.col("found"))
    return done.where("parent IS NULL").select(*columns).unionByName(hung.select(*columns))
