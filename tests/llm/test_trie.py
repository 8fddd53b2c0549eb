"""Prefix tries against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from satchel.llm import checks, queries, trie
from tests.run_checks import compare, connect

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def brute(conversations):
    """Rows of the result for ``{conv_id: [(turn, bytes of its text), ...]}``."""
    members, size, ends = defaultdict(list), {}, defaultdict(list)
    for c in sorted(conversations):
        path = tuple(t for t, _ in conversations[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            size[path[:d]] = conversations[c][d - 1][1] if d else 0
        ends[path].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, found in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(found) - 1) * size[path]
            leaves[path[:d]] += path not in kids
    return sorted((found[0], len(p), members[p[:-1]][0] if p else None, len(found), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, found in members.items())


def rows_of(frame):
    order = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(r[c] for c in order) for r in frame)


def grown(conversations, blocks, monkeypatch, pieces=3):
    """The same by blocks and pieces of given sizes, without Spark."""
    monkeypatch.setattr(trie, "BLOCK_KEYS", blocks)
    monkeypatch.setattr(trie, "PIECE", pieces)
    rows = sorted((b"".join(t for t, _ in turns), c, [s for _, s in turns]) for c, turns in conversations.items())
    source = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.int64())], names=["key", "sizes", "conv_id"])
    trees = [r for b in trie._built(trie._pieces([source.slice(k, 7) for k in range(0, len(rows), 7)])) for r in b.to_pylist()]
    added = sorted((r["key"], r["base"], r["parts"]) for r in trees if r["parts"] is not None)
    batch = pa.RecordBatch.from_arrays([pa.array([a[0] for a in added], pa.binary()), pa.array([a[1] for a in added], pa.int64()), pa.array([a[2] for a in added], pa.list_(trie._PART))], names=["key", "base", "parts"])
    spine = [r for b in trie._merged([batch]) for r in b.to_pylist()]
    names = {r["name"]: r["conv_id"] for r in spine}
    found = [r for r in trees if r["parts"] is None] + spine
    for r in found:
        if r["parent"] is not None:
            r["parent_conv_id"] = names[r["parent"]]
    return rows_of(found)


def shaped(rng, kinds, most):
    """Conversations over turns whose ids branch at every byte, many of them alike."""
    turns = [(bytes(rng.choices(range(kinds), k=rng.randint(1, 3))).ljust(15, b"\0") + bytes([k % 256]), k % 9) for k in range(250)]
    pool = [[rng.choice(turns[:rng.choice([2, 10, 250])]) for _ in range(rng.randint(0, most))] for _ in range(120)]
    pool += [p[:rng.randint(0, len(p))] + rng.choice(pool) for p in pool[:60]]
    return {c: rng.choice(pool[:rng.choice([3, len(pool)])]) for c in rng.sample(range(-500, 500), 300)}


@pytest.mark.parametrize("blocks", [1, 2, 5, 64, 10_000])
def test_blocks_of_any_size_give_the_same_trie(blocks, monkeypatch):
    rng = random.Random(blocks)
    for kinds, most in ((2, 4), (256, 3), (40, 12)):
        given = shaped(rng, kinds, most)
        assert grown(given, blocks, monkeypatch, rng.choice([1, 3, 4096])) == brute(given)


def test_layouts_grow_and_paths_are_compressed():
    tree = trie.RadixTree()
    keys = [bytes([k]) * trie.WIDTH for k in range(256)]
    seen = []
    for k, key in enumerate(random.Random(1).sample(keys, 256)):
        tree.insert(key, [1], (1, k, ""))
        seen.append((type(tree.root.kids).__name__, getattr(tree.root.kids, "room", None)))
    assert list(dict.fromkeys(seen)) == [("Few", 4), ("Few", 16), ("Many", None), ("All", None)]
    assert [seen.count(x) for x in dict.fromkeys(seen)] == [4, 12, 32, 208]
    assert [n.path for n, _, _ in tree.in_order()] == [b"", *keys]
    deep = trie.RadixTree()
    deep.insert(b"a" * trie.WIDTH * 5000, [1] * 5000, (1, 1, ""))
    deep.insert(b"a" * trie.WIDTH * 4000 + b"b" * trie.WIDTH, [1] * 4001, (1, 2, ""))
    deep.insert(b"a" * trie.WIDTH * 10, [1] * 10, (1, 3, ""))
    assert [len(n.path) for n, _, _ in deep.in_order()] == [0, 160, 16 * 3990, 16 * 1000, 16]


def test_deep_conversations(monkeypatch):
    a, b = (b"a" * trie.WIDTH, 2), (b"b" * trie.WIDTH, 3)
    given = {1: [a] * 700, 2: [a] * 500 + [b] * 100, 3: [a] * 500, 4: [], 5: [], 6: [b], 7: [a] * 700}
    for blocks in (1, 2, 100):
        assert grown(given, blocks, monkeypatch) == brute(given)


def turns_of(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append(((turn is not None, turn or 0), (role or "").encode(), (text or "").encode()))
    return {c: [((r, t), len(t)) for _, r, t in sorted(x)] for c, x in found.items()}


def test_turns_of_any_kind(spark):
    rng = random.Random(11)
    hot = [(c, t, "user", f"first {t}") for c in range(1000, 1120) for t in range(3)]
    rows = [(rng.randint(-20, 40), rng.choice([None, 0, 1, 2, 2, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "é" * 9, None, "", "x" * 50_000])) for _ in range(260)]
    rows += rows[:20] + hot + [(None, 1, "user", "nobody's"), (None, None, None, None), (9000, None, None, None)]
    df = spark.createDataFrame([(*r, 1.0, "k") for r in rows], SCHEMA + ", n double, key string")
    assert rows_of(trie.nodes(trie.sequences(df)).collect()) == brute(turns_of(rows))


def test_no_conversations_and_no_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.nodes(trie.sequences(empty)).count() == 0
    bare = spark.createDataFrame([(7, bytearray(), []), (3, bytearray(), [])], "conv_id bigint, key binary, sizes array<bigint>")
    assert rows_of(trie.nodes(bare).collect()) == brute({7: [], 3: []})


def test_query_equals_sql_and_brute_force(spark, tmp_path):
    assert compare(spark, connect(SF), queries.prefix_trie, checks.prefix_trie(), SF).startswith("ok")
    rng = random.Random(4)
    rows = [(c, t, "user" if t % 2 else "assistant", f"say {rng.randint(0, 2)}") for c in rng.sample(range(-60, 60), 70) for t in range(rng.randint(1, 14))]
    path = f"{tmp_path}/conversations.parquet"
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/all")
    import pyarrow.parquet as pq

    pq.write_table(pq.read_table(f"{tmp_path}/all"), path)
    con = connect(SF)
    con.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{path}'")
    assert compare(spark, con, queries.prefix_trie, checks.prefix_trie(), str(tmp_path)).startswith("ok")
    found = queries.prefix_trie(spark, str(tmp_path))
    assert found.where((F.col("n_convs") > 1) & (F.col("depth") > 0)).count() > 20
