from __future__ import annotations

import random

from pyspark.sql import Window, functions as F

from satchel.operators import budget, rollup, selection
from satchel.plans.running import ordinals, running_total
from satchel.sources import history


def nearest(path, table, default):
    while True:
        if path in table:
            return table[path]
        if not path:
            return default
        path = path.rpartition("/")[0]


def test_overrides_equal_latest_assignments(spark):
    """500 files, 200 seeded steps: both formulations and a plain model agree."""
    rnd = random.Random(431)
    files = [(f"d{i % 10}/sub{i % 7}/{i}.txt", i % 3 == 0) for i in range(500)]
    nodes = sorted({""} | {f"d{i}" for i in range(10)} | {f"d{i}/sub{j}" for i in range(10) for j in range(7)}
                   | {p for p, _ in files})
    steps = [(rnd.choice(nodes), rnd.choice(["Basic", "Thorough", "None"]), n) for n in range(200)]
    model: dict[str, str] = {}
    for path, mode, _ in steps:
        if not path.endswith(".txt"):
            model = {k: v for k, v in model.items() if path and not k.startswith(path + "/")}
        model[path] = mode
    want = {p: nearest(p, model, "None") for p, _ in files}

    df = spark.createDataFrame([("c", p, b) for p, b in files], "corpus string, path string, is_basic boolean").coalesce(2)
    log = spark.createDataFrame([("c", p, m, e) for p, m, e in steps], "corpus string, path string, mode string, epoch long")
    got = {r.path: r.mode for r in selection.latest_assignment(df, log, "None").collect()}
    assert got == want

    as_flags = log.select("corpus", "path", (~F.col("path").endswith(".txt")).alias("is_dir"),
                          (F.col("mode") == "Thorough").alias("included"), "epoch")
    compact = selection.compact_overrides(as_flags)
    flags = {r.path: r.included for r in compact.collect()}
    assert flags == {p: m == "Thorough" for p, m in model.items()}
    got = {r.path: r.included for r in selection.nearest_override(df, compact, F.lit(False)).collect()}
    assert got == {p: m == "Thorough" for p, m in want.items()}


def test_settings_layers(spark):
    rows = [("a", 0, "DetectBinary", "false"), ("a", 1, "Style", "Json"), ("a", 2, "Style", "Fancy"),
            ("a", 3, "MaxTotalSizeBytes", "-5"), ("a", 4, "ExtSet", "[]"), ("a", 1, "ExtSet", '[".cs"]'),
            ("a", 2, "ExcludeGlobs", "[]"), ("a", 1, "ExcludeGlobs", '["x"]'), ("a", 5, "SecretAllowlist", '["w"]'),
            ("b", 1, "SecretAllowlist", '["w"]'), ("b", 1, "SensitiveValuePatterns", '["p"]')]
    df = spark.createDataFrame(rows, "corpus string, depth int, field string, value string")
    got = {(r.corpus, r.field): r.value for r in selection.settings_overlay(df).collect()}
    assert got == {
        ("a", "DetectBinary"): "false", ("a", "Style"): "Json", ("a", "MaxTotalSizeBytes"): "0", ("a", "ExtSet"): '[".cs"]',
        ("a", "ExcludeGlobs"): "[]", ("a", "SensitiveValuePatterns"): '["w"]', ("a", "SecretAllowlist"): "[]",
        ("b", "SensitiveValuePatterns"): '["p"]', ("b", "SecretAllowlist"): '["w"]'}


def test_running_total_equals_a_plain_window(spark):
    """One group holds most rows and spans several range partitions."""
    df = spark.range(20000).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("corpus"),
        F.hash("id").alias("k"), (F.col("id") % 17).alias("v"), "id")
    got = running_total(df, ["k", "id"], F.col("v"), "before", ["corpus"], partitions=7)
    w = Window.partitionBy("corpus").orderBy("k", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("before", F.coalesce(F.sum("v").over(w), F.lit(0)))
    assert got.select("id", "before").exceptAll(want.select("id", "before")).count() == 0
    assert got.count() == 20000
    overall = ordinals(df, ["k", "id"])
    assert overall.agg(F.min("ord"), F.max("ord"), F.countDistinct("ord")).first() == (1, 20000, 20000)


def greedy(sizes, cap, total):
    out, left = [], total
    for s in sizes:
        take = min(s, cap or s, left)
        left -= take
        out.append(take)
    return out


def test_budget_equals_the_greedy_walk(spark):
    rnd = random.Random(7)
    rows = [(c, f"{rnd.choice('abXY')}/{i:04d}", rnd.choice([0, 1, 8, 90])) for c in ("p", "q") for i in range(300)]
    df = spark.createDataFrame(rows, "corpus string, path string, size long").coalesce(3)
    for cap, total in ((0, 1000), (50, 1000), (10, 0), (0, 10**9), (0, 1)):
        got = {(r.corpus, r.path): r.allowed for r in budget.size_budget(df, cap, total).collect()}
        for corpus in ("p", "q"):
            mine = sorted((r for r in rows if r[0] == corpus), key=lambda r: (r[1].upper(), r[1]))
            want = greedy([r[2] for r in mine], cap, total or 10**12)
            assert [got[(corpus, r[1])] for r in mine] == want, (cap, total)


def test_rollup_order_and_states(spark):
    rows = [("c", "small/one.txt", 4, True), ("c", "large/one.txt", 100, True), ("c", "large/two.txt", 50, False), ("c", "top.md", 1, False)]
    df = spark.createDataFrame(rows, "corpus string, path string, text_bytes long, selected boolean").withColumn("tokens", F.lit(1))
    got = {r.directory: (r.files, r.text_bytes) for r in rollup.contributions(df).collect()}
    assert got == {"": (4, 155), "large": (2, 150), "small": (1, 4)}
    kids = [r.name for r in sorted((r for r in rollup.children_sorted(rollup.children(df)).collect() if r.parent == ""),
                                   key=lambda r: r.position)]
    assert kids == ["large", "small", "top.md"]
    states = {r.directory: r.state for r in rollup.tristate(df).collect()}
    assert states == {"": "Mixed", "large": "Mixed", "small": "Included"}


def test_changes_between_snapshots(spark):
    schema = "corpus string, path string, content string"
    old = spark.createDataFrame([("c", "a", "1"), ("c", "b", "2"), ("c", "x/m", "same"), ("c", "gone", "9")], schema)
    new = spark.createDataFrame([("c", "A", "1"), ("c", "b", "3"), ("c", "y/m", "same"), ("c", "n", "new")], schema)
    got = {(r.path, r.status, r.previous_path) for r in history.snapshot_changes(old, new).collect()}
    assert got == {("b", "modified", None), ("y/m", "renamed", "x/m"), ("n", "added", None), ("gone", "deleted", None)}
