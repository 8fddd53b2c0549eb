"""Shards by balanced label propagation: the law always holds, links stay together where they can."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from satchel.llm import balance, queries

SCHEMA = "doc_id bigint, links array<string>"


def assigned(spark, rows, shards=5, schema=SCHEMA, **more):
    df = balance.assign(spark.createDataFrame(rows, schema), F.col("links"), "doc_id", shards, **more)
    found = df.collect()
    assert df.columns[-2:] == ["shard", "slot"] and len(found) == len(rows)
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert set(by) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    return found


def spread(found):
    where = defaultdict(Counter)
    for r in found:
        for x in set(r.links or []) - {None}:
            where[x][r.shard] += 1
    return where


def test_copies_stay_together_and_a_hot_group_takes_the_fewest_shards(spark):
    rng = random.Random(3)
    rows, k = [(i, ["hot"]) for i in range(210)], 210
    while k < 600:
        n = rng.choice([1] * 12 + [2, 2, 3, 9])
        rows += [(k + i, [f"g{k}"]) for i in range(n)]
        k += n
    rng.shuffle(rows)
    where = spread(assigned(spark, rows, 10))
    cap = -(-len(rows) // 10)
    assert len(where["hot"]) <= -(-210 // cap) + 1
    whole = [len(v) == 1 for x, v in where.items() if x != "hot" and sum(v.values()) > 1]
    assert len(whole) > 25 and sum(whole) >= 0.95 * len(whole)


def test_pairs_are_exchanged_where_no_shard_has_room(spark):
    rows = [(i, [f"p{i // 2}"]) for i in range(400)]
    where = spread(assigned(spark, rows, 4))
    # Dealt in turn, all pairs would be cut.
    assert sum(len(v) == 1 for v in where.values()) >= 0.8 * len(where)


def test_neighbours_by_several_links(spark):
    rng = random.Random(5)
    rows = [(i, sorted({f"c{i // 20}-{rng.randint(0, 5)}" for _ in range(3)})) for i in range(400)]
    rng.shuffle(rows)
    together = sum(n * n for v in spread(assigned(spark, rows, 8)).values() for n in v.values())
    dealt = sum(n * n for v in spread(assigned(spark, rows, 8, rounds=0)).values() for n in v.values())
    assert together > 3 * dealt


def test_edges(spark):
    assert assigned(spark, []) == []
    assert len(assigned(spark, [(1, ["a"]), (2, ["a"])], 5)) == 2
    rows = [(None, None), (None, []), (1, [None]), (1, ["", None]), (2, [""]), (7, ["x" * 100_000]), (7, ["x" * 100_000])] + [(9, ["r", "r"])] * 4
    where = spread(assigned(spark, rows, 3))
    assert len(where["x" * 100_000]) == 1 and len(where[""]) == 1 and sum(where["r"].values()) == 4
    one = balance.assign(spark.createDataFrame([(1, ["a"], "s", 4.0, "p")], "doc_id bigint, links array<string>, Shard string, slot double, bunch string"), F.col("links"), "doc_id", 2)
    assert one.columns == ["doc_id", "links", "Shard", "slot", "bunch", "_shard", "_slot"]
    assert one.collect()[0][5:] == (0, 0)


def test_query(spark, tmp_path):
    texts = ["same"] * 30 + ["Ünï"] * 3 + [None, "", "", None] + [f"text {i}" for i in range(60)] + ["long " * 50_000] * 2
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.balanced_shards(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in found} == {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows}
    sizes = Counter(r.shard for r in found)
    assert len(found) == len(rows) and set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}
    shards = {r.doc_id: r.shard for r in found}
    assert len({shards[i] for i in (30, 31, 32)}) <= 2 and len({shards[i] for i in range(30)}) <= 14
