"""Regions of long bodies, and redaction and line numbers of bodies with many spans."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from satchel.functions import spans as S
from satchel.operators import regions as G, sensitive as V
from satchel.plans.export import prepare
from satchel.plans.settings import RunSettings

KEY = "-----BEGIN RSA " + "PRIVATE KEY-----\n"
PIECES = [
    "plain words here\n", "mail a.b@mail.com\n", "password:\n  hunter4242\n", "token\n= \"abcdefghij0123456789\"\n", "pwd = \n\nhunter77\n", "password123\n: x\n", "password123\n", "qwerty9\n\n\n=x\n",
    KEY + "MIIBOgIBAAJBAKj34GkxFhD90vcNLYLInFEX6Ppy1tPf\nab: c\n" + KEY.replace("BEGIN", "END"), KEY + "lines\n", "CH93 0076 2011 6238 5295 7\n", "4111 1111 1111 1111\r\n", "AKIA" + "IOSFODNN7EXAMPLE\n",
    "api_key: '" + "Zq3" * 9 + "'\n", "\r\n", "é😀 \n", ":\n", "=\n", "x", " \t", "phone\n:\n+41 79 123 45 67\n", "secret\"\n:\n'0123456789abcdefg\n", "gh" + "p_" + "A" * 36 + "\n"]


def scanned(spark, texts, settings, scan):
    df = spark.createDataFrame([("c", str(k), t, 1) for k, t in enumerate(texts)], "corpus string, path string, content string, key int")
    return {int(r.path): [tuple(s) for s in r.findings] for r in scan(df, settings).collect()}


@pytest.mark.parametrize("region", [1, 40, 700])
def test_regions_have_the_spans_of_the_whole(spark, region):
    rng = random.Random(region)
    texts = ["".join(rng.choice(PIECES if k % 3 else PIECES[:8] + PIECES[10:]) for _ in range(rng.randint(0, 120))) for k in range(40)]
    texts += [None, "", "no line ends " * 50, texts[3], texts[3]]
    settings = RunSettings(scan_entropy=True)
    want = scanned(spark, texts, settings, V.scan)
    got = scanned(spark, texts, settings, lambda df, s: G.scan(df, s, long=10, region=region))
    assert {k: v or [] for k, v in got.items()} == {k: v or [] for k, v in want.items()}
    assert sum(len(v or []) for v in want.values()) > 300
    places = [len(G.cuts(t, region)) for t in texts if t]
    assert max(places) > (10 if region < 100 else 2)


def test_user_patterns_see_the_whole_body(spark):
    s = RunSettings(hide_patterns=("plain[\\s\\S]+end",))
    text = "plain words\n" * 30 + "end\n"
    assert scanned(spark, [text], s, lambda df, x: G.scan(df, x, long=10, region=5)) == scanned(spark, [text], s, V.scan)


def test_a_long_body_is_many_tasks(spark):
    text = "".join(f"line {k} of a very long log, user{k % 97}@mail.com\n" for k in range(120_000))
    df = spark.createDataFrame([(text,)], "text string").select(F.lit("k").alias("key"), "text")
    parts = G.regions(df).select("region", "offset", F.length("text").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert len(parts) > 20 and len({p.task for p in parts}) >= 8
    parts.sort(key=lambda p: p.region)
    assert [p.offset for p in parts] == [sum(q.n for q in parts[:k]) for k in range(len(parts))] and sum(p.n for p in parts) == len(text)


def test_a_run_scans_long_files_by_regions(corpus, monkeypatch):
    body = "".join(f"row {k}: password = supersecret{k}\nnext line\n" for k in range(800))
    files, s = corpus({"long.txt": body.encode(), "short.txt": b"mail a@mail.com\n"}).withColumn("size", F.length("content").cast("bigint")), RunSettings(scan_mode="Redact")
    want = {r.path: (r.body, len(r.report)) for r in prepare(files, s).files.collect()}
    used = []
    monkeypatch.setattr(G, "LONG_CHARS", 1000)
    monkeypatch.setattr(G.scan, "__defaults__", (RunSettings(), "content", 1000, 500))
    real = G.regions
    monkeypatch.setattr(G, "regions", lambda *a: used.append(1) or real(*a))
    assert {r.path: (r.body, len(r.report)) for r in prepare(files, s).files.collect()} == want and used
    assert want["long.txt"][1] >= 800 and "supersecret7" not in want["long.txt"][0]


def test_line_numbers_and_redaction_across_blocks(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for n in (3, 40, 400):
        text = "".join(rng.choice(["x" * rng.randint(0, 300), "\r\n", "\r", "\n", "é😀", f"m{k}@mail.com ", "\n\n"]) for k in range(n * 6))
        texts += [text, "a" * 4095 + "\r\n" + text, "a" * 4096 + "\r\n" + text, "\n" * 4096 + text]
    df = spark.createDataFrame([("c", str(k), t) for k, t in enumerate(texts)], "corpus string, path string, content string")
    scanned = V.scan(df, RunSettings(scan_mode="Redact"))
    rows = V.finding_rows(scanned, RunSettings(scan_mode="Redact")).collect()
    assert len(rows) > 600
    for r in rows:
        before = texts[int(r.path)][:r.start]
        assert r.line == len(re.split("\r\n|\r|\n", before)), (r.path, r.start)
    for r in V.protect(scanned, RunSettings(scan_mode="Redact")).collect():
        text, out, at = texts[int(r.path)], "", 0
        for s in r.findings:
            out += text[at:s.start] + f"[REDACTED:{s.rule_id}]"
            at = s.start + s.length
        assert r.body == out + text[at:]


def test_redaction_and_lines_are_linear(spark):
    def seconds(n: int) -> float:
        text = "".join(f"some words before a mail a{k}@mail.com and more\n" for k in range(n))
        df = spark.createDataFrame([("c", "p", text)], "corpus string, path string, content string")
        settings = RunSettings(scan_mode="Redact")
        done = V.protect(V.scan(df, settings), settings).select(F.length("body").alias("n"), V.report(settings)[n - 1]["line"].alias("line"))
        begun = time.time()
        assert done.first().line == n
        return time.time() - begun

    seconds(500)
    small, large = seconds(4000), seconds(16_000)
    assert large < 6 * max(small, 0.5), (small, large)
