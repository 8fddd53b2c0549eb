"""Sums that batches add to, bounded state, and choices of late files."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from satchel.operators import rollup
from satchel.streaming import progressive as G

WEIGHED = "corpus string, path string, text_bytes bigint, tokens bigint, ingest_time timestamp"
SUMS = ["corpus", "directory", "files", "text_bytes", "tokens"]


def landed(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, WEIGHED).coalesce(1).write.mode("append").parquet(folder)


def rows_of(df, columns=SUMS):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture
def batches():
    rng, day = random.Random(2), datetime(2024, 1, 1)
    return [[("c", f"{rng.choice(['Src', 'src', 'doc'])}/{rng.choice('abC')}/{k}-{i}.txt", rng.randint(0, 9), 1, day + timedelta(days=k)) for i in range(4)]
            for k in range(11)]


def test_merged_tables_equal_a_batch_roll_up(spark, tmp_path, monkeypatch, batches):
    monkeypatch.setattr(G, "FAN", 3)
    landed(spark, str(tmp_path / "in"), batches)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = G.read_stream(spark, str(tmp_path / "in"), WEIGHED, batch_files=1)
    G.start_rollup(stream, out, state, availableNow=True).awaitTermination()
    assert len(G.committed_batches(spark, state)) == 11
    got = G.read_rollup(spark, out, state)
    assert rows_of(got) == rows_of(rollup.contributions(spark.read.parquet(str(tmp_path / "in"))))
    # Eleven batches are one table of nine and two of one.
    assert [x.removeprefix(out) for x in G._runs(out, 11)] == ["/level-0/run-9", "/level-0/run-10", "/level-2/run-0"]
    assert got.where("directory = ''").first().files == 44


def test_a_batch_writes_only_directories_that_it_touches(spark, tmp_path):
    now = datetime(2024, 1, 1)
    many = [("c", f"d{k}/e/f.txt", 1, 1, now) for k in range(200)]
    landed(spark, str(tmp_path / "in"), [many])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = G.read_stream(spark, str(tmp_path / "in"), WEIGHED, batch_files=1)
    G.start_rollup(stream, out, state, availableNow=True).awaitTermination()
    landed(spark, str(tmp_path / "in"), [[("c", "d7/e/g.txt", 5, 2, now)]])
    G.start_rollup(stream, out, state, availableNow=True).awaitTermination()
    assert rows_of(spark.read.parquet(f"{out}/level-0/run-1")) == [("c", "", 1, 5, 2), ("c", "d7", 1, 5, 2), ("c", "d7/e", 1, 5, 2)]
    assert ("c", "d7/e", 2, 6, 3) in rows_of(G.read_rollup(spark, out, state))


def test_an_unfinished_batch_adds_nothing_and_is_repeated(spark, tmp_path, monkeypatch, batches):
    monkeypatch.setattr(G, "FAN", 2)
    landed(spark, str(tmp_path / "in"), batches[:5])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = G.read_stream(spark, str(tmp_path / "in"), WEIGHED, batch_files=1)
    merge, calls = G._merged, []

    def breaks(deltas):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return merge(deltas)

    monkeypatch.setattr(G, "_merged", breaks)
    with pytest.raises(Exception, match="lost"):
        G.start_rollup(stream, out, state, availableNow=True).awaitTermination()
    monkeypatch.setattr(G, "_merged", merge)
    assert G.committed_batches(spark, state) == [0, 1, 2]
    assert G.read_rollup(spark, out, state).where("directory = ''").first().files == 12
    G.start_rollup(stream, out, state, availableNow=True).awaitTermination()
    assert rows_of(G.read_rollup(spark, out, state)) == rows_of(rollup.contributions(spark.read.parquet(str(tmp_path / "in"))))


def test_state_stops_growing_with_an_ingest_time(spark, tmp_path, batches):
    # Every path comes twice, an hour apart.
    twice = [rows + [(*r[:4], r[4] + timedelta(hours=1)) for r in rows] for rows in batches]
    landed(spark, str(tmp_path / "in"), twice)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = G.read_stream(spark, str(tmp_path / "in"), WEIGHED, batch_files=1)
    query = G.start_rollup(stream, out, state, "ingest_time", "1 day", availableNow=True)
    query.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(kept) <= 12 < 44
    assert G.read_rollup(spark, out, state).where("directory = ''").first().files == 44


def test_stamped_rows_are_never_too_late(spark, tmp_path, batches):
    landed(spark, str(tmp_path / "in"), batches[:4] + batches[:2])
    stream = G.stamped(G.read_stream(spark, str(tmp_path / "in"), WEIGHED, batch_files=1).drop("ingest_time"))
    assert G.drain_rollup(stream, "stamped", "ingest_time").where("directory = ''").first().files == 16


def test_nothing_arrived_is_an_empty_table(spark, tmp_path):
    assert G.read_rollup(spark, str(tmp_path / "out"), str(tmp_path / "state")).count() == 0
    assert G._runs("x", 0) == []


def test_choices_looked_up_equal_choices_joined(spark, monkeypatch):
    rng = random.Random(4)
    names = ["a", "B", "b", "c", "d.txt"]
    path = lambda: "/".join(rng.choice(names) for _ in range(rng.randint(1, 5)))
    files = [(rng.choice(["x", "y"]), path(), k) for k in range(400)] + [("x", None, 400), (None, "a/b", 401), ("z", "a", 402), ("x", "", 403)]
    chosen = [(rng.choice(["x", "y"]), path(), rng.random() < 0.5) for _ in range(60)] + [("y", "", False), (None, "a", True), ("x", None, True), ("x", "a/a", None)]
    files = spark.createDataFrame(files, "corpus string, path string, k int")
    chosen = spark.createDataFrame(chosen, "corpus string, path string, included boolean")
    found = rows_of(G.inherit_choice(files, chosen, F.lit(True)), ["k", "included"])
    monkeypatch.setattr(G, "MOST_LOOKED_UP", 0)
    assert found == rows_of(G.inherit_choice(files, chosen, F.lit(True)), ["k", "included"])
    table = {}
    for r in chosen.collect():
        if None not in tuple(r):
            key = (r.corpus, r.path.upper())
            table[key] = table.get(key, True) and r.included

    def nearest(corpus, at):
        at = None if at is None else at.upper()
        while at is not None:
            if (corpus, at) in table:
                return table[corpus, at]
            at = at.rpartition("/")[0] if at else None
        return True

    assert found == sorted((r.k, nearest(r.corpus, r.path)) for r in files.collect())
    assert G.inherit_choice(files, chosen.limit(0), F.lit(False)).where("included").count() == 0
