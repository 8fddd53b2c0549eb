from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from satchel.operators import layouts as L
from satchel.plans.export import Selection, export, prepare
from satchel.plans.presets import apply_preset
from satchel.plans.settings import RunSettings
from satchel.streaming import progressive as T

SEP = "=" * 30


def text_of(files, s, **options):
    return L.materialize(L.render(prepare(files, s, **options), s))["root"]


GOLDEN = {".gitignore": b"x\n", "a.cs": b"class A {}", "b.txt": b"hello\n", "app.min.js": b"m\n", "skip.bin": b"BIN",
          "sub/c.cs": b"class C {}\n", "node_modules/lib.js": b"y\n"}


def classic_golden() -> str:
    listed = [".gitignore", "a.cs", "app.min.js", "b.txt", "skip.bin", "sub", "sub/c.cs"]
    out = "===== DIRECTORY LIST (filtered) =====\r\nROOT: root\r\n\r\n" + "".join(f"root/{p}\r\n" for p in listed)
    out += "\r\n\r\n===== FILE CONTENTS (LEGIBLE ONLY) =====\r\n"
    for p in (".gitignore", "a.cs", "b.txt", "sub/c.cs"):
        body = GOLDEN[p].decode()
        out += f"\r\n{SEP}\r\nroot/{p}\r\n{SEP}\r\n{body}" + ("" if body.endswith("\n") else "\r\n")
    return out


def test_classic_golden_in_memory_and_in_shards(corpus, tmp_path):
    files, s = corpus(GOLDEN), RunSettings()
    assert text_of(files, s) == classic_golden()
    target = tmp_path / "pack"
    export(files, s, str(target))
    shards = sorted((target / "corpus=root").glob("part-*"))
    assert b"".join(p.read_bytes() for p in shards).decode() == classic_golden()
    with pytest.raises(Exception, match="exist"):
        export(files, s, str(target))


def test_written_order_over_many_partitions(spark, tmp_path):
    blocks = spark.range(5000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("corpus"), F.lit(60).alias("section"),
        F.lpad(F.col("id").cast("string"), 6, "0").alias("key"), F.concat(F.col("id").cast("string"), F.lit("\r\n")).alias("block"))
    L.write_pack(blocks.repartition(6), str(tmp_path / "p"), partitions=5)
    for corpus, odd in (("a", 0), ("b", 1)):
        parts = sorted((tmp_path / "p" / f"corpus={corpus}").glob("part-*"))
        lines = b"".join(p.read_bytes() for p in parts).decode().split("\r\n")[:-1]
        assert lines == [str(i) for i in range(odd, 5000, 2)]


def test_digest_golden(corpus):
    files = corpus({"README.md": b"# Hi\n", "src/main.py": b"print(1)\r\n", ".hidden": b"h", "b.txt": b"",
                    ".config/c.txt": b"c\n", "a.bin": b"\0\1\2\3"})
    s = RunSettings(layout="gitingest")
    sep = "=" * 48
    tree = ("Directory structure:\n└── root/\n    ├── README.md\n    ├── a.bin\n    ├── b.txt\n    ├── .hidden\n"
            "    ├── src/\n    │   └── main.py\n    └── .config/\n        └── c.txt\n")
    block = lambda p, c: f"{sep}\nFILE: {p}\n{sep}\n{c}\n\n"
    want = tree + "\n" + "\n".join([
        block("README.md", "# Hi\n"), block("a.bin", "[Binary file]"), block("b.txt", "[Empty file]"),
        block(".hidden", "h"), block("src/main.py", "print(1)\r\n"), block(".config/c.txt", "c\n")])
    assert text_of(files, s, selection_=Selection(mode="Thorough")) == want


def test_repomix_golden(spark, corpus):
    files = corpus({"README.md": b"  # Hi\n\n", "src/main.ts": b"x\n", "a.png": b"\x89PNG\0\0"})
    text = text_of(files, RunSettings(layout="repomix"))
    assert text.startswith("This file is a merged representation of the entire codebase, combined into a single document by Satchel.\n\n<file_summary>\n")
    assert text.endswith(
        "- Files matching patterns in .gitignore are excluded\n</notes>\n\n</file_summary>\n\n<directory_structure>\n"
        "src/\n  main.ts\na.png\nREADME.md\n</directory_structure>\n\n<files>\n"
        "This section contains the contents of the repository's files.\n\n"
        '<file path="src/main.ts">\nx\n</file>\n\n<file path="README.md">\n# Hi\n</file>\n\n</files>\n')
    commits = spark.createDataFrame([("root", "README.MD", 1), ("root", "SRC/MAIN.TS", 2)], "corpus string, path_key string, changes long")
    text = text_of(files, RunSettings(layout="repomix", exclude_globs=("*.log", "tmp/")), commits=commits)
    assert "containing files not matching ignore patterns, combined" in text
    assert "- Files matching these patterns are excluded: *.log, tmp/\n" in text
    assert text.index('path="README.md"') < text.index('path="src/main.ts"')


SECRET = "AKIA" + "IOSFODNN7EXAMPLE"


@pytest.fixture(scope="module")
def mixed(corpus):
    """Two prepared packs, one per way of cleaning bodies, shared by the layouts."""
    files = corpus({"a.md": f"key {SECRET} ```` <&>\r\n\x01".encode(), "d/b.txt": "é\"\\\n".encode(), "bad.txt": b"caf\xe9",
                    "n.cs": b"x\0y"})
    settings = {n: RunSettings(layout=n, scan_mode="Redact", max_tokens=3, max_file_bytes=40) for n in ("json", "xml")}
    return {n: prepare(files, s) for n, s in settings.items()}


@pytest.mark.parametrize("layout", ["json", "xml", "markdown", "json_compact", "xml_compact"])
def test_structured_layouts(mixed, layout):
    s = RunSettings(layout=layout, scan_mode="Redact", max_tokens=3, max_file_bytes=40)
    text = L.materialize(L.render(mixed["xml" if "xml" in layout else "json"], s))["root"]
    assert SECRET not in text and "[REDACTED:aws-access-key]" in text
    if layout.startswith("json"):
        doc = json.loads(text)
        assert (doc["files"], doc["overBudget"], doc["secretFindings"]) == (3, True, 1)
        assert [f["path"] for f in doc["fileList"]] == ["a.md", "d/b.txt", "n.cs"]
        assert doc["fileList"][1]["content"] == "é\"\\\n" and doc["fileList"][2]["binary"] is True
        assert "could not read" in doc["directoryStructure"]
    elif layout.startswith("xml"):
        root = ET.fromstring(text.encode())
        assert root.get("files") == "3" and root.find("files")[1].text == "é\"\\\n"
        assert root.find("files")[0].find("secret").tail.endswith("```` <&>\r\n")
    else:
        assert "\n`````markdown\r\n" in text


def test_cap_hides_a_value_that_crosses_it(corpus):
    files = corpus({"a.md": b"text " + SECRET.encode() + b" tail", "b.md": b"x" * 50, "c.md": b"late"})
    s = RunSettings(layout="json", scan_mode="Redact", max_file_bytes=15, max_total_bytes=20)
    listed = {f["path"]: f for f in json.loads(text_of(files, s))["fileList"]}
    assert listed["a.md"]["content"] == "text [REDACTED:aws-access-key]"
    assert listed["b.md"]["content"] == "x" * 5 and listed["c.md"]["content"] == ""
    assert all(f["truncated"] for f in listed.values())


def test_review_decisions(corpus, tmp_path):
    files, s = corpus({"secret.txt": b"password123\nknown-private-value\n"}), RunSettings(layout="plain", hide_patterns=("known-private-value",))
    assert export(files, s, str(tmp_path / "none"), decision="Cancel") is None and not (tmp_path / "none").exists()
    read = lambda p: "".join(f.read_text() for f in sorted(Path(p).glob("corpus=root/part-*")))
    export(files, s, str(tmp_path / "keep"), decision="Keep")
    kept = read(tmp_path / "keep")
    assert "password123" in kept and "known-private-value" not in kept and "[REDACTED:custom-sensitive-value]" in kept
    export(files, s, str(tmp_path / "redact"), decision="Redact")
    assert "password123" not in read(tmp_path / "redact")


def test_selection_and_changes(spark, corpus):
    files = corpus({"keep/a.odd": b"a", "drop/b.odd": b"b", "drop/c.txt": b"c"})
    overrides = spark.createDataFrame([("root", "drop", False), ("root", "drop/C.txt", True)], "corpus string, path string, included boolean")
    s = RunSettings(layout="json")
    doc = json.loads(text_of(files, s, selection_=Selection(mode="Thorough", overrides=overrides)))
    assert [f["path"] for f in doc["fileList"]] == ["drop/c.txt", "keep/a.odd"] and "b.odd" in doc["directoryStructure"]
    changes = spark.createDataFrame([("root", "drop/c.txt")], "corpus string, path string")
    doc = json.loads(text_of(files, apply_preset(s, "changed files"), changes=changes))
    assert [f["path"] for f in doc["fileList"]] == ["drop/c.txt"] and "keep" not in doc["directoryStructure"]


def test_memory_guard(spark):
    blocks = spark.createDataFrame([("c", 0, "k", "x" * 100)], "corpus string, section int, key string, block string")
    with pytest.raises(L.PackTooLarge):
        L.materialize(blocks, 99)


def test_stream_in_batches_equals_batch(spark, tmp_path):
    df = spark.range(200).select(
        F.lit("c").alias("corpus"), F.concat(F.lit("d"), (F.col("id") % 7).cast("string"), F.lit("/f"), F.col("id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("id").alias("text_bytes"), F.lit(1).cast("bigint").alias("tokens"))
    src = str(tmp_path / "in")
    df.repartition(6).write.parquet(src)
    df.limit(20).write.mode("append").parquet(src)  # the same paths again
    stream = T.once(T.read_stream(spark, src, df.schema, batch_files=2))
    first = T.drain(stream, "seen")
    assert first.count() == 200
    rolled = T.drain(T.running_rollup(T.read_stream(spark, src, df.schema, batch_files=2)), "roll", "complete")
    assert {r.directory: r.files for r in rolled.collect()}[""] == 220
