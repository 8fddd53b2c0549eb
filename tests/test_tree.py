"""Raw folders: distributed walk, reading by bytes, streaming in bounded batches."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from satchel.functions import rules as R
from satchel.operators import inventory as I
from satchel.sources import tree
from satchel.sources.corpus import read_corpus


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """One top folder with everything below it: wide, deep, dotted, empty and odd."""
    root = tmp_path_factory.mktemp("tree")
    names = [f"top/wide/{k:03d}.txt" for k in range(300)] + [f"top/d{k % 17}/e{k % 5}/.f{k}" for k in range(120)]
    names += ["top/" + "/".join(["n"] * depth) + f"/at{depth}.md" for depth in (1, 20, 60)] + ["top/.git/config", "top/a b/ü.txt", "top/_x"]
    for k, name in enumerate(names):
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text("x" * (k % 40))
    os.makedirs(root / "top/empty")
    os.symlink(root / "top", root / "top/loop")
    return root


def seen(root):
    """What the standard library sees: path to (is_dir, size)."""
    out = {}
    for at, dirs, files in os.walk(root):
        for d in dirs:
            p = os.path.join(at, d)
            out[os.path.relpath(p, root)] = (not os.path.islink(p), 0)
        for f in files:
            out[os.path.relpath(os.path.join(at, f), root)] = (False, os.path.getsize(os.path.join(at, f)))
    return out


@pytest.mark.parametrize("ahead", [0, 3, tree.AHEAD])
def test_walk_lists_each_folder_once(spark, folder, ahead):
    rounds: list[tree.Round] = []
    rows = tree.walk(spark, str(folder), ahead=ahead, rounds=rounds).collect()
    want = seen(folder)
    assert Counter(r.path for r in rows) == Counter(want.keys())  # none twice: no folder is listed twice
    assert {r.path: (r.is_dir, r.size) for r in rows} == want
    assert {r.path: r.error for r in rows if r.error} == {"top/loop": "link content was not read"}
    if ahead == 0:
        assert sum(x.folders for x in rounds) == 1 + sum(r.is_dir for r in rows) and len(rounds) == 62
    else:
        assert len(rounds) < 30


def test_pruned_folders_are_not_entered(spark, folder):
    rules = R.compile_rules(["wide/", ".git/", "!x"])
    keep = lambda rows: rows.where(~R.excluded(F.col("path"), F.col("is_dir"), rules))
    rounds: list[tree.Round] = []
    rows = tree.walk(spark, str(folder), prune=keep, rounds=rounds)
    whole = tree.walk(spark, str(folder))
    assert sorted(r.path for r in rows.collect()) == sorted(r.path for r in I.prune(whole, rules).collect())
    assert sum(x.found for x in rounds) < whole.count() - 299


def test_files_are_dealt_out_by_bytes(spark, folder):
    listing = tree.walk(spark, str(folder))
    read = tree.read_files(listing, str(folder), task_bytes=2000, open_bytes=10)
    assert read.rdd.getNumPartitions() > 4
    rows = read.collect()
    assert {r.path: bytes(r.content) for r in rows if r.content is not None} == {p: b"x" * s for p, (d, s) in seen(folder).items() if not d and not p.endswith("loop")}
    by_task = [r.n for r in read.withColumn("t", F.spark_partition_id()).groupBy("t").agg(F.sum("size").alias("n")).collect()]
    assert max(by_task) <= 2040
    # One top folder, yet many tasks; the table form has the same inventory.
    table = read.where("content IS NOT NULL").select("corpus", "path", "content")
    assert {r.path for r in I.inventory(table).collect()} == {r.path for r in rows if r.path not in ("top/empty", "top/loop")}
    assert read_corpus(spark, str(folder), "tree").count() == len(rows)


def test_what_cannot_be_listed_or_named_is_an_error(spark, tmp_path):
    open(os.path.join(os.fsencode(tmp_path), b"bad\xff.txt"), "w").close()
    (tmp_path / "ok.txt").write_text("ok")
    rows = read_corpus(spark, str(tmp_path), "tree").collect()
    assert {r.path: r.error for r in rows} == {"bad?.txt": "name is not UTF-8", "ok.txt": None}
    assert [(r.path, r.error) for r in tree.walk(spark, str(tmp_path / "none")).collect()] == [("", "could not list: No such file or directory")]
    (tmp_path / "empty").mkdir()
    assert read_corpus(spark, str(tmp_path / "empty"), "tree").count() == 0


def drained(query_of, out, spark):
    query = query_of()
    query.processAllAvailable()
    query.stop()
    return spark.read.parquet(str(out)) if out.exists() else None


def test_stream_arrives_in_bounded_batches_and_equals_the_walk(spark, folder, tmp_path):
    batches: list[int] = []

    def save(batch, number):
        batches.append(batch.count())
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    def start():
        stream = tree.read_stream(spark, str(folder), str(tmp_path / "frontier"), batch_files=100)
        return stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{tmp_path}/state").start()

    table = drained(start, tmp_path / "out", spark)
    whole = read_corpus(spark, str(folder), "tree").drop("batch")
    assert max(batches) <= 100 and len(batches) >= 5
    assert table.drop("batch").exceptAll(whole).count() == 0 and whole.exceptAll(table.drop("batch")).count() == 0
    # Nothing new: nothing twice.
    assert drained(start, tmp_path / "out", spark).count() == whole.count()


def test_a_restart_repeats_the_batch_and_loses_nothing(spark, folder, tmp_path):
    failed = []

    def save(batch, number):
        if number == 3 and not failed:
            failed.append([r.path for r in batch.collect()])
            raise RuntimeError("lost in mid-batch")
        batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    def start():
        stream = tree.read_stream(spark, str(folder), str(tmp_path / "frontier"), batch_files=64)
        return stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{tmp_path}/state").start()

    with pytest.raises(Exception, match="lost in mid-batch"):
        drained(start, tmp_path / "out", spark)
    table = drained(start, tmp_path / "out", spark)
    assert Counter(r.path for r in table.collect()) == Counter(seen(folder).keys())
    assert [r.path for r in table.where("batch = 3").collect()] == failed[0]


def test_frontier_states(folder, tmp_path):
    """Batches on disk are what offsets say, also where a crash lies between state and Spark."""
    options = {"path": str(folder), "frontier": str(tmp_path), "batch_files": "50"}
    one = tree.TreeStream(options)
    first = one.latestOffset()
    rows = [r for p in one.partitions(one.initialOffset(), first) for r in p.rows]
    # Another reader takes over; the batch was handed out but Spark never saw its offset.
    two = tree.TreeStream(options)
    second = two.latestOffset()
    again = [r for p in two.partitions(two.initialOffset(), second) for r in p.rows]
    assert again[:len(rows)] == rows and len(again) == 100
    at, found = second, list(again)
    while (now := two.latestOffset()) != at:
        found += [r for p in two.partitions(at, now) for r in p.rows]
        two.commit(at)
        at = now
    assert Counter(r[0] for r in found) == Counter(seen(folder).keys())
    assert sorted(x for x in os.listdir(tmp_path) if x.startswith("batch")) == [f"batch-{at['batch']}.json"]
    with pytest.raises(ValueError):
        tree.TreeStream({"path": str(folder)})
