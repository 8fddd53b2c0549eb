from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from satchel.functions import rules as R
from satchel.operators import inventory as I
from satchel.plans.presets import PRESETS, apply_preset
from satchel.plans.settings import RunSettings

CASES = [
    ("foo.cs", "a/foo.cs", False, True), ("foo.cs", "foo.cs", False, True), ("foo.cs", "bar.cs", False, False),
    ("/dist", "dist", True, True), ("/dist", "src/dist", True, False),
    ("build/", "build", True, True), ("build/", "build", False, False),
    ("*.log", "a/b/c.log", False, True), ("*.log", "a/b/c.txt", False, False),
    ("**/temp", "temp", True, True), ("**/temp", "a/b/temp", True, True),
    ("[Dd]ebug/", "Debug", True, True), ("[Dd]ebug/", "debug", True, True), ("[Dd]ebug/", "Xebug", True, False),
    ("*.[oa]", "x/f.o", False, True), ("*.[oa]", "g.a", False, True), ("*.[oa]", "h.c", False, False),
    ("[!a]bc", "xbc", False, True), ("[!a]bc", "abc", False, False),
    ("a[!x]b", "a/b", False, False), ("a[!x]b", "aYb", False, True), ("a[!x]b", "axb", False, False),
    ("x[!-a]y", "xZy", False, True), ("x[!-a]y", "x5y", False, True), ("x[!-a]y", "xay", False, False),
    ("x[!-a]y", "x-y", False, False), ("x[!-a]y", "x/y", False, False),
    ("a[/]b", "a/b", False, False), ("a[/]b", "aXb", False, False),
    ("a[b", "a[b", False, True), ("a[b", "ab", False, False),
    ("src/**", "src/a.cs", False, True), ("src/**", "other/a.cs", False, False),
]


def test_single_patterns(spark):
    rows = spark.createDataFrame([(i, p, d) for i, (_, p, d, _) in enumerate(CASES)], "i int, path string, is_dir boolean")
    test = F.lit(None).cast("boolean")
    for i, (pattern, *_ ) in enumerate(CASES):
        verdict = R.ignored(F.col("path"), F.col("is_dir"), R.compile_rules([pattern]))
        test = F.coalesce(F.when(F.col("i") == i, verdict), test)
    got = {r.i: r.out for r in rows.select("i", test.alias("out")).collect()}
    assert got == {i: c[3] for i, c in enumerate(CASES)}


def test_last_match_wins_comments_and_errors(spark):
    rules = R.compile_rules(["# note", "", "*.log", "!keep.log", "secret.cs"])
    assert len(rules) == 3
    rows = spark.createDataFrame([("a.log",), ("keep.log",), ("secret.cs",), ("ok.cs",)], ["path"])
    got = {r.path: r.x for r in rows.select("path", R.ignored(F.col("path"), F.lit(False), rules).alias("x")).collect()}
    assert got == {"a.log": True, "keep.log": False, "secret.cs": True, "ok.cs": False}
    with pytest.raises(ValueError):
        R.compile_rules(["[z-a]bc", "keep.cs"])


def test_pruned_directory_cannot_be_revived(spark, corpus):
    files = corpus({"skip/deep.cs": b"z", "keep.cs": b"y", "node_modules/lib.js": b"x", "a/skip/b/c.cs": b"q"})
    entries = I.inventory(files)
    rules = R.compile_rules(["skip/", "!deep.cs", "!c.cs"])
    by_join = {r.path for r in I.prune(entries, rules).collect()}
    by_row = {r.path for r in I.prune_rowwise(entries, rules).collect()}
    lines = spark.createDataFrame([("root", 0, 0, "skip/"), ("root", 0, 1, "!deep.cs")],
                                  "corpus string, layer int, ordinal int, pattern string")
    by_table = {r.path for r in I.prune_by_rule_table(entries, I.rule_lists(lines)).collect()}
    assert by_join == by_row == by_table == {"keep.cs", "a"}


def test_presets_leave_protection_alone():
    kept = RunSettings(scan_mode="Redact", hide_patterns=("hunter2",))
    for name in PRESETS:
        out = apply_preset(kept, name.upper())
        assert (out.scan_mode, out.hide_patterns) == ("Redact", ("hunter2",))
    with pytest.raises(ValueError):
        apply_preset(kept, "unknown")


@pytest.mark.parametrize("preset,files,kept", [
    ("repomix", ["node_modules/x.js", "sub/node_modules/y.js", ".env", "sub/.env", "package-lock.json",
                 "sub/package-lock.json", "bin/tool.cs", "dist/a.js", "sub/dist/b.js", "LICENSE"],
     {"sub/.env", "bin/tool.cs", "sub/dist/b.js", "LICENSE"}),
    ("gitingest", ["logo.png", "sub/build/x.txt", "bin/tool.cs", "LICENSE", "keep.txt"], {"LICENSE", "keep.txt"}),
])
def test_tool_presets(corpus, preset, files, kept):
    s = apply_preset(RunSettings(), preset)
    entries = I.prune(I.inventory(corpus({f: b"x" for f in files})), R.compile_rules(s.exclude_globs), s.exclude_regex)
    assert {r.path for r in entries.collect() if not r.is_dir} == kept
