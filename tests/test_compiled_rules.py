"""Look-ups and regexes of compiled rules against the regex of every rule."""

from __future__ import annotations

import random
import time
from dataclasses import replace

from pyspark.sql import functions as F

from satchel.functions import rules as R
from satchel.operators import inventory as I
from satchel.plans.presets import apply_preset
from satchel.plans.settings import RunSettings

PARTS = ["src", "SRC", "Kelvin", "Kelvin", "doc", "ſrc", "build", "bın", "BİN", "bin", "a b", "é", "É", ".env", "node_modules", "x[1]", "a\nb", "c\n", ""]
ENDS = ["", ".js", ".min.js", ".JS", ".MİN.js", ".txt", ".", "..", ".é", "~", ".js\n"]
LINES = ["src", "kelvin/", "!KELVIN", "*.js", "!*.min.js", "*.min.js", "*.txt", "/bin", "bin/", "src/bin", "!src/bin/", "a b", "é", "*.é", "*.", "*~", "**/doc", "doc/**", "**/*.txt", "!**/src/bin", "**/**/c", "**/", "b?n",
         "[sS]rc", "!.env", ".env", "x[1]", "*", "!*.JS", "build/", "/src/", "c", "node_modules", "\\x", "a]b", "*.tar.gz", "# no", ""]


def paths(rng, n):
    return [("/".join(rng.choice(PARTS) for _ in range(rng.randint(0, 3))) + "/" * rng.randint(0, 1) + rng.choice(PARTS) + rng.choice(ENDS), rng.random() < 0.4) for _ in range(n)]


def chain(path, is_dir, rules):
    """The last rule whose own regex matches."""
    out = F.lit(False)
    for r in rules:
        hit = F.rlike(path, F.lit(R.FLAGS + r.regex))
        out = F.when((is_dir | F.lit(not r.dir_only)) & hit, F.lit(not r.negate)).otherwise(out)
    return out


def test_compiled_rules_equal_the_chain_of_regexes(spark):
    rng = random.Random(3)
    given = paths(rng, 1500) + [(p, d) for p in ("", "src", "src/bin", "doc/src/bin", "a/c", "a/b/c", "src/bin\n", "\n", "a\\x", "a]b", "x.tar.gz") for d in (True, False)]
    df = spark.createDataFrame(given, "path string, is_dir boolean").cache()
    path, is_dir = F.col("path"), F.col("is_dir")
    for k in range(12):
        lines = LINES[::-1] if k == 0 else ["!**/src/bin", "src", "**/src/bin"] if k == 1 else [rng.choice(LINES) for _ in range(rng.choice([1, 2, 5, 30]))]
        rules = R.compile_rules(lines)
        listed = spark.createDataFrame([("c", 0, i, x) for i, x in enumerate(lines)] or [], "corpus string, layer int, ordinal int, pattern string")
        maps = I.rule_lists(listed.where("pattern <> '' AND NOT startswith(pattern, '#')"))
        both = df.withColumn("corpus", F.lit("c")).join(maps, "corpus", "left").select(
            "path", "is_dir", R.ignored(path, is_dir, rules).alias("sets"), R.judged(path, is_dir, F.col("rules")).alias("maps"), chain(path, is_dir, rules).alias("want"))
        wrong = both.where("sets <> want OR maps <> want").limit(3).collect()
        assert not wrong, (lines, wrong)
        included = R.included(path, rules)
        slow = R.included(path, [replace(r, kind=None, key=None) for r in rules])
        assert df.where(included != slow).count() == 0


def test_what_becomes_a_look_up():
    kinds = {x: (r.kind, r.key) for x in LINES if (r := R.translate(x))}
    assert kinds["src"] == ("name", "src") and kinds["!KELVIN"] == ("name", "kelvin") and kinds["*.min.js"] == ("suffix", ".min.js")
    assert kinds["/bin"] == ("path", "bin") and kinds["!src/bin/"] == ("path", "src/bin") and kinds["é"] == (None, None) and kinds["b?n"] == (None, None)
    preset = R.compile_rules(apply_preset(RunSettings(), "repomix").exclude_globs)
    assert len(preset) > 80 and sum(r.kind is not None for r in preset) > 0.5 * len(preset)


def test_a_hundred_rules_cost_a_fraction_of_their_regexes(spark):
    lines = [f"name{k}" for k in range(60)] + [f"*.ext{k}" for k in range(35)] + [f"gen*{k}/" for k in range(5)]
    rules = R.compile_rules(lines)
    maps = I.rule_lists(spark.createDataFrame([("c", 0, i, x) for i, x in enumerate(lines)], "corpus string, layer int, ordinal int, pattern string"))
    df = spark.range(120_000).select(F.lit("c").alias("corpus"), F.concat(F.lit("some/folder/"), F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.lit(False).alias("is_dir"))
    df = df.join(F.broadcast(maps), "corpus").cache()
    df.count()
    each = F.filter("rules.every", lambda r: F.rlike(F.col("path"), r["regex"]) & (F.col("is_dir") | ~r["dir_only"]))

    def seconds(test) -> float:
        took = []
        for _ in range(2):
            begun = time.time()
            assert df.where(test).count() == 0
            took.append(time.time() - begun)
        return min(took)

    fast, slow = seconds(R.judged(F.col("path"), F.col("is_dir"), F.col("rules"))), seconds(F.size(each) > 0)
    assert fast < slow / 3, (fast, slow)
    assert len(rules) == 100
    print("RULES", fast, slow)
