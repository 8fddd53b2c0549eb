"""Writes become visible as a whole, and never touch each other."""

from __future__ import annotations

import os

import pytest

from satchel.operators import layouts as L
from satchel.sources import committer
from satchel.sources.committer import Write, committed
from satchel.sources.pack_sink import read_pack


def put(write: Write, partition: int, attempt: int = 0, text: str = "x", folder: str = "") -> str:
    name = folder + write.name(partition, attempt, 0, ".txt")
    os.makedirs(os.path.dirname(f"{write.path}/{name}"), exist_ok=True)
    with open(f"{write.path}/{name}", "w") as out:
        out.write(text)
    return name


def test_two_writers_at_once_keep_both(tmp_path):
    path = str(tmp_path / "t")
    a, b = Write(path), Write(path)
    names = [put(a, 0), put(b, 0), put(a, 1), put(b, 1, folder="corpus=x/")]
    a.commit([names[0], names[2]])
    assert committed(path) == sorted([names[0], names[2]]) and os.path.exists(f"{path}/{names[1]}")
    b.commit([names[1], names[3]])
    assert committed(path) == sorted(names)


def test_lost_attempts_and_dead_jobs_are_not_seen(tmp_path):
    path = str(tmp_path / "t")
    dead = Write(path)
    put(dead, 0)
    assert committed(path) is None
    a = Write(path)
    lost, kept = put(a, 0, attempt=1), put(a, 0, attempt=2)
    a.commit([kept])
    assert committed(path) == [kept] and not os.path.exists(f"{path}/{lost}")


def test_a_kill_before_the_manifest_shows_nothing(tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    first = Write(path)
    old = put(first, 0)
    first.commit([old])
    second = Write(path, overwrite=True)
    names = [put(second, k) for k in range(3)]

    class Dead(Exception):
        pass

    real = committer.place

    def dying(where):
        store, folder = real(where)

        class Store:
            def __getattr__(self, name):
                if name == "move":
                    raise Dead
                return getattr(store, name)

        return Store(), folder

    monkeypatch.setattr(committer, "place", dying)
    with pytest.raises(Dead):
        second.commit(names)
    monkeypatch.undo()
    assert committed(path) == [old] and os.path.exists(f"{path}/{old}")


def test_overwriting_replaces_what_it_saw(tmp_path):
    path = str(tmp_path / "t")
    first, later, over = Write(path), Write(path), Write(path, overwrite=True)
    a, b, c = put(first, 0), put(later, 5), put(over, 0)
    first.commit([a])
    over.commit([c])
    later.commit([b])
    assert committed(path) == sorted([b, c]) and not os.path.exists(f"{path}/{a}")
    last = Write(path, overwrite=True)
    last.commit([])
    assert committed(path) == [] and not any(n.endswith(".txt") for n in os.listdir(path))


def test_an_aborted_write_leaves_others_alone(tmp_path):
    path = str(tmp_path / "t")
    a, b = Write(path), Write(path)
    put(b, 0)
    b.abort()
    assert not os.path.exists(path)
    kept = put(a, 0)
    a.commit([kept])
    put(b, 0)
    b.abort()
    assert committed(path) == [kept] and os.listdir(path).count(kept) == 1


def test_packs_are_read_by_their_manifest(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "p")
    blocks = spark.range(200).select(
        F.when(F.col("id") % 3 == 0, "a/ü").otherwise("b").alias("corpus"), F.lit(1).alias("section"),
        F.lpad(F.col("id").cast("string"), 4, "0").alias("key"), F.concat(F.col("id").cast("string"), F.lit("\n")).alias("block"))
    L.write_pack(blocks, path, partitions=4)
    # What a dead job left is part of no pack.
    put(Write(path), 0, text="stray", folder="corpus=b/")
    got = {}
    for r in sorted(read_pack(spark, path).collect(), key=lambda r: r.part):
        got[r.corpus] = got.get(r.corpus, "") + r.value
    assert got == {c: "".join(f"{k}\n" for k in range(200) if (k % 3 == 0) == (c == "a/ü")) for c in ("a/ü", "b")}
    with pytest.raises(FileNotFoundError):
        read_pack(spark, str(tmp_path))
    with pytest.raises(FileExistsError):
        L.write_pack(blocks, path)
