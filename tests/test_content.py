from __future__ import annotations

import base64

from pyspark.sql import functions as F

from satchel.functions import content as C, text as X, tokens as K


def test_encodings(corpus):
    files = {
        "cp.py": "# -*- coding: cp1252 -*-\n€é".encode("cp1252"), "l1.py": b"#!x\n# coding=latin_1\n\xe9",
        "cyr.py": "# coding: cp1251\nПривет".encode("cp1251"), "no.py": b"x = 1\ny = 2\n# coding: latin-1\n\xe9",
        "u16.txt": "hé😀".encode("utf-16"), "u32.txt": b"\xff\xfe\0\0" + "hé😀".encode("utf-32-le"),
        "be": b"\xfe\xff" + "h€".encode("utf-16-be"), "be32": b"\0\0\xfe\xff" + "h😀".encode("utf-32-be"),
        "bom.txt": b"\xef\xbb\xbfhi", "bad.txt": b"caf\xe9", "nul.cs": b"x\0y", "empty": b"",
        "clip": b"x" * 7999 + "é".encode() + b"zz", "odd.txt": b"\xff\xfeh", "unknown.py": b"# coding: bogus\nx",
    }
    rows = C.decode(corpus(files).withColumn("bin", C.is_binary("content")).withColumn(
        "kind", C.text_like("content", "path"))).collect()
    got = {r.path: (r.text, r.bin, r.kind) for r in rows}
    assert got["cp.py"][0].endswith("€é") and got["l1.py"][0].endswith("é") and got["cyr.py"][0].endswith("Привет")
    assert got["no.py"][0] is None and got["unknown.py"][0] is None and got["odd.txt"][0] is None
    assert [got[p][0] for p in ("u16.txt", "u32.txt", "be", "be32", "bom.txt")] == ["hé😀", "hé😀", "h€", "h😀", "hi"]
    assert got["bad.txt"] == (None, False, "undecodable") and got["nul.cs"][1:] == (True, "binary")
    assert got["empty"] == ("", False, "text") and got["clip"][2] == "text"
    assert not any(v[1] for k, v in got.items() if k != "nul.cs")


def test_capped_decode(corpus):
    rows = corpus({"a": "a😀z".encode(), "b": "é1".encode("utf-16")}).withColumn("encoding", C.encoding("content", "path"))
    cut = rows.select("path", *[C.capped_decode("content", F.col("encoding"), F.lit(n)).alias(f"c{n}") for n in (3, 5, 6)])
    got = {r.path: tuple(r)[1:] for r in cut.collect()}
    assert got["a"] == ("a�", "a😀", "a😀z")
    assert got["b"] == ("�", "é�", "é1")


def test_text_helpers(spark):
    df = spark.createDataFrame([("a``b```c\r\nd\re\nf",)], ["t"])
    row = df.select(
        X.longest_backtick_run("t").alias("run"), X.fence("t").alias("fence"), X.line_of("t", F.lit(12)).alias("line"),
        X.trim_space(F.concat(F.lit(" \n "), F.col("t"), F.lit("  "))).alias("trim"),
        X.xml_text(F.lit("a<b>&\r")).alias("xml"), X.json_string(F.lit('q"\\\n')).alias("json"),
        X.xml_clean(F.lit("a\u0001\u000bb😀")).alias("clean")).first()
    assert (row.run, row.fence, row.line) == (3, "````", 3)
    assert row.trim == "a``b```c\r\nd\re\nf" and row.xml == "a&lt;b&gt;&amp;&#xD;"
    assert row.json == '"q\\"\\\\\\n"' and row.clean == "ab😀"


def test_exact_tokens_with_a_supplied_vocabulary(spark, tmp_path):
    """Bytes plus one merge: every ``ab`` is one token."""
    ranks = [bytes([i]) for i in range(256)] + [b"ab"]
    vocab = tmp_path / "tiny.tiktoken"
    vocab.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(ranks)))
    df = spark.createDataFrame([("",), ("abab",), ("x ab",)], ["t"])
    got = [r.n for r in df.select(K.exact_tokens(F.col("t"), "o200k_base", str(vocab)).alias("n")).collect()]
    assert got == [0, 2, 3]


def test_tree_source_sees_dot_files(spark, tmp_path):
    from satchel.sources.corpus import read_corpus

    for name, body in {".env": "a", "_x.txt": "b", "sub/.git/config": "c", "sub/deep/er/y.txt": "dd"}.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(body)
    (tmp_path / "empty").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / ".env")
    rows = read_corpus(spark, str(tmp_path), "tree", splits=3).collect()
    files = {r.path: bytes(r.content or b"") for r in rows if not r.is_dir and r.error is None}
    assert files == {".env": b"a", "_x.txt": b"b", "sub/.git/config": b"c", "sub/deep/er/y.txt": b"dd"}
    assert {r.path for r in rows if r.is_dir} == {"empty", "sub", "sub/.git", "sub/deep", "sub/deep/er"}
    assert [r.path for r in rows if r.error] == ["link"]
