"""Exports lose nothing, write exact bytes and clean up after themselves."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from satchel.functions import content as C, spans as S
from satchel.operators import inventory as I, layouts as L
from satchel.plans.export import export, prepare
from satchel.plans.presets import apply_preset
from satchel.plans.session import shared_dir
from satchel.plans.settings import RunSettings
from satchel.sources import history as H
from satchel.sources.tree import TreeDataSource


def written(path) -> str:
    return b"".join(p.read_bytes() for p in sorted(Path(path).glob("corpus=root/part-*"))).decode()


def test_paths_that_differ_in_case_are_two_files(corpus):
    pack = prepare(corpus({"Makefile.txt": b"a", "makefile.txt": b"b"}), RunSettings())
    assert sorted(r.path for r in pack.files.collect()) == ["Makefile.txt", "makefile.txt"]
    rows = corpus({"A.txt": b"a", "a.txt": b"b", "c.txt": b"c"})
    assert sorted(r.path for r in I.once(rows.union(rows)).collect()) == ["A.txt", "c.txt"]


def test_what_a_source_cannot_read_is_an_error(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    (root / "good.txt").write_text("fine")
    os.symlink(root / "good.txt", root / "link.txt")
    spark.dataSource.register(TreeDataSource)
    tree = spark.read.format("satchel_tree").options(path=str(root), corpus="root").load()
    pack = prepare(tree, RunSettings())
    assert [r.path for r in pack.files.collect()] == ["good.txt"]
    assert [(r.path, r.reason) for r in pack.errors.collect()] == [("link.txt", "link content was not read")]


def test_the_mode_of_the_settings_counts(corpus):
    files = corpus({"a.rs": b"fn main() {}", "b.md": b"# b", "c.odd": b"\x01\x02\x03\x04abc"})
    names = lambda s: sorted((r.path, r.is_binary) for r in prepare(files, s).files.collect())
    assert names(apply_preset(RunSettings(), "repomix")) == [("a.rs", False), ("b.md", False), ("c.odd", True)]
    assert names(RunSettings()) == [("b.md", False)] and names(RunSettings(selection_mode="None")) == []


@pytest.mark.parametrize("layout", ["json", "json_compact"])
def test_written_json_is_json_and_equals_the_rendering(corpus, tmp_path, layout):
    files, s = corpus({"a.md": b"one\ntwo\n", "d/b.txt": "é\"\\".encode(), "d/c.txt": b""}), RunSettings(layout=layout)
    folder = Path(shared_dir(files.sparkSession).removeprefix("file:"))
    before = set(folder.glob("export-*"))
    sums = export(files, s, str(tmp_path / "p"))
    assert sums.count() == 1 and set(folder.glob("export-*")) == before
    text = written(tmp_path / "p")
    assert [f["path"] for f in json.loads(text)["fileList"]] == ["a.md", "d/b.txt", "d/c.txt"]
    assert text == L.materialize(L.render(prepare(files, s), s))["root"]


def test_a_failing_task_leaves_no_pack(spark, tmp_path):
    bad = F.when(F.col("id") == 900, F.raise_error(F.lit("no"))).otherwise(F.lit("x"))
    blocks = spark.range(1000).select(F.lit("c").alias("corpus"), F.lit(1).alias("section"), F.lpad(F.col("id").cast("string"), 4, "0").alias("key"), bad.alias("block"))
    with pytest.raises(Exception, match="no"):
        L.write_pack(blocks, str(tmp_path / "p"), partitions=4)
    assert not list(tmp_path.glob("p/**/*.txt"))


def test_renames_are_paired_one_to_one(spark):
    make = lambda files: spark.createDataFrame([("c", p, x) for p, x in files.items()], "corpus string, path string, content string")
    got = H.snapshot_changes(make({"a": "same", "b": "same", "k": "kept", "m": "1"}), make({"z": "same", "k": "kept", "m": "2", "n": "new"})).collect()
    assert {(r.path, r.status, r.previous_path) for r in got} == {
        ("z", "renamed", "a"), ("b", "deleted", None), ("m", "modified", None), ("n", "added", None)}


def test_capped_code_pages_keep_their_characters(spark):
    raw = "# coding: cp1252\nŠéœ”".encode("cp1252")
    df = spark.createDataFrame([("a.py", bytearray(raw))], "path string, content binary")
    cut = df.select(C.capped_decode("content", C.encoding(F.col("content"), "path"), F.lit(19)).alias("t")).first().t
    assert cut == "# coding: cp1252\nŠé"


def test_scanning_is_linear_in_the_matches(spark):
    def seconds(n: int) -> float:
        text = "".join(f"mail a{k}@mail.com\n" for k in range(n))
        df = spark.createDataFrame([(text,)], "text string").select(S.all_spans("text").alias("f"), "text")
        begun = time.time()
        rows = df.select("text", "f").first()
        took = time.time() - begun
        assert len(rows.f) == n and all(text[s.start:s.start + s.length] == s.value for s in rows.f[:: n // 50])
        return took

    seconds(500)
    small, large = seconds(4000), seconds(16_000)
    assert large < 6 * max(small, 0.5)


def test_redaction_joins_overlaps(spark):
    spans = "array<struct<rule_id:string,tier:int,start:int,length:int,value:string>>"
    rows = [("abcdefghij", [("r1", 2, 1, 3, ""), ("r2", 1, 3, 2, ""), ("r3", 1, 5, 1, ""), ("r4", 3, 8, 1, "")])]
    df = spark.createDataFrame(rows, f"text string, f {spans}")
    assert df.select(S.redacted("text", "f").alias("t")).first().t == "a[REDACTED:r2][REDACTED:r3]gh[REDACTED:r4]j"
