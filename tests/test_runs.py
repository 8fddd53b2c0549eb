"""What a run reads, excludes and reports."""

from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import Observation, functions as F

from satchel.functions import rules as R
from satchel.operators import inventory as I, layouts as L, rollup
from satchel.plans.export import exclusion, export, listing_of, prepare
from satchel.plans.session import stage
from satchel.plans.settings import RunSettings
from satchel.sources import tree
from satchel.streaming.progress import Progress


def schema_of_scans(df) -> str:
    return " ".join(re.findall(r"ReadSchema: (struct<[^\n]*)", df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))))


def test_a_user_regex_sees_the_full_path(corpus):
    files = corpus({"a.txt": b"a", "sub/b.txt": b"b"})
    names = lambda s: sorted(r.path for r in prepare(files, s).files.collect())
    for git in (True, False):
        assert names(RunSettings(exclude_regex=r"root\\sub", respect_gitignore=git, use_extra_ignore=git)) == ["a.txt"]
        assert names(RunSettings(exclude_regex=r"^root\\", respect_gitignore=git, use_extra_ignore=git)) == []
    # The built-in pattern sees relative paths only.
    built = files.withColumn("corpus", F.lit("build"))
    assert names(RunSettings()) == sorted(r.path for r in prepare(built, RunSettings()).files.collect()) == ["a.txt", "sub/b.txt"]
    entries = I.inventory(files)
    assert I.prune_rowwise(entries, [], r"root\\sub").count() == I.prune(entries, [], r"root\\sub").count() == 1


def test_listings_and_rules_read_no_bodies(spark, tmp_path):
    rows = [("c", "/.gitignore" if k % 2 else ".gitignore\\", bytearray(b"*.log\n")) if k < 2 else ("c", f"d{k % 3}/{k}.{'log' if k % 5 else 'txt'}", bytearray(b"x" * 50)) for k in range(300)]
    spark.createDataFrame(rows, "corpus string, path string, content binary").write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert "content" not in schema_of_scans(listing_of(table))
    files = I.rule_files(table, (".gitignore",))
    text = files._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*(In|EqualTo|Or)\(path", text) and sorted(r.path for r in files.collect()) == [".gitignore", ".gitignore"]
    keep = exclusion(table, stage(listing_of(table), "listing"), RunSettings(exclude_globs=("d1/",)))
    left = keep(listing_of(table)).filter("NOT is_dir").collect()
    assert left and all(not r.path.endswith(".log") and not r.path.startswith("d1/") for r in left)


def test_a_corpus_of_which_nothing_is_left_has_its_header(corpus):
    s = RunSettings(exclude_globs=("*",), layout="plain")
    files = corpus({"a.txt": b"a"})
    text = L.materialize(L.render(prepare(files, s), s))
    assert list(text) == ["root"] and "(no matching files)" in text["root"]


def test_counts_of_the_body_pass_equal_the_totals(corpus, tmp_path):
    secret = "AKIA" + "IOSFODNN7EXAMPLE"
    files = corpus({"a.txt": b"hello", "b.md": f"key {secret}".encode(), "c.py": b"# coding: nonsense\nx", "d.txt": b"mail a@mail.com"})
    seen = Observation("bodies")
    totals = export(files, RunSettings(scan_mode="Skip"), str(tmp_path / "p"), observation=seen).first()
    got = seen.get
    assert got == {"files": totals.n_files, "bytes": totals.n_bytes, "tokens": totals.n_tokens, "findings": totals.n_secrets, "omitted": totals.n_omitted, "undecodable": totals.n_errors}
    assert got["files"] == 3 and got["omitted"] == 1 and got["undecodable"] == 1


def test_a_listener_follows_streams(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    for k in range(25):
        (root / f"{k}.txt").write_text("x")
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        stream = tree.read_stream(spark, str(root), str(tmp_path / "frontier"), batch_files=10)
        query = stream.writeStream.queryName("review").foreachBatch(lambda b, n: b.count()).option("checkpointLocation", f"{tmp_path}/state").start()
        query.processAllAvailable()
        query.stop()
        for _ in range(100):
            if "review" in progress.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    assert progress.rows == {"review": 25} and progress.batches == {"review": 3} and progress.ended == {"review": None}


def test_directories_in_two_spellings_are_one(spark):
    rows = [("c", "Src/a.txt", 4, True), ("c", "src/B/b.txt", 6, False), ("c", "SRC/b/c.txt", 1, False), ("c", "x.txt", 1, True)]
    df = spark.createDataFrame(rows, "corpus string, path string, text_bytes long, selected boolean").withColumn("tokens", F.lit(1))
    assert {(r.directory, r.files, r.text_bytes) for r in rollup.contributions(df).collect()} == {("", 4, 12), ("SRC", 3, 11), ("SRC/b", 2, 7)}
    assert {(r.parent, r.path) for r in rollup.children(df).collect()} == {
        ("", "SRC"), ("", "x.txt"), ("SRC", "Src/a.txt"), ("SRC", "SRC/b"), ("SRC/b", "src/B/b.txt"), ("SRC/b", "SRC/b/c.txt")}
    dirs = spark.createDataFrame([("c", "src/empty"), ("c", "Src/EMPTY"), ("c", "src"), ("c", "other")], "corpus string, path string")
    set_ = spark.createDataFrame([("c", "SRC", False)], "corpus string, path string, included boolean")
    assert {(r.directory, r.state) for r in rollup.tristate(df, dirs, set_).collect()} == {
        ("", "Mixed"), ("SRC", "Mixed"), ("SRC/b", "Excluded"), ("Src/EMPTY", "Excluded"), ("other", "Included")}


def test_the_row_sink_writes_what_a_pack_holds(spark, corpus, tmp_path):
    secret = "AKIA" + "IOSFODNN7EXAMPLE"
    files = corpus({"a.txt": b"hello", "b.md": f"key {secret}".encode(), "z.txt": b"x\0y", "d.txt": b"mail a@mail.com"})
    pack = prepare(files, RunSettings(scan_mode="Skip"))
    L.write_records(pack.files, str(tmp_path / "rows"))
    rows = {r.path: r for r in spark.read.json(str(tmp_path / "rows")).collect()}
    assert {p: (r.content, r.is_binary, r.content_omitted, r.size) for p, r in rows.items()} == {
        "a.txt": ("hello", False, False, 5), "b.md": ("", False, True, 24), "z.txt": ("", True, False, 3), "d.txt": ("mail [REDACTED:email-address]", False, False, 15)}
    assert [f.rule_id for f in rows["d.txt"].report] == ["email-address"] and secret not in str(rows)
    with pytest.raises(Exception, match="already exists|EXISTS"):
        L.write_records(pack.files, str(tmp_path / "rows"))
