"""Quality rules, language mixtures, tokens, chat formatting."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from satchel.llm import bpe, chat, checks, langid, quality, queries
from satchel.llm.boosting import fit
from tests.run_checks import compare, connect

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
# Nulls, empty and blank texts, a long text, repeated rows, a row without id.
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "word " * 40_000), (4, "word " * 40_000), (None, "no id here"), (5, "é"), (6, "123 456")]


def frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id bigint, text string" + extra)


def plain_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)]


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b", " ", "\n", "\x0b", "é", "#", "c d e f g ", "  "]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    assert all(quality.measure(t.encode())[0] == plain_measure(t) for t in texts)
    big = [str(k).encode() for k in range(9000)] + [b"1", b"2", b"3", b"4", b"5", b"6"]
    assert quality.repeated_words(big) == (12, 9000)


def test_quality_verdicts_of_the_tables(spark):
    docs = queries.table(spark, SF, "documents")
    rows = {r.doc_id: r for r in queries.quality_rules(spark, SF).collect()}
    for r in docs.collect():
        got, want = rows[r.doc_id], plain_measure(r.text)
        assert [got[c] for c in quality.COUNTS] == want
        assert got.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert got.kept == (not got.base_failed and got.score >= quality.THRESHOLD)
    labels = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    assert np.mean([rows[i].kept == bool(q) for i, q in labels.items()]) > 0.9


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(1)
    rows = rng.random((800, 3))
    label = ((rows[:, 0] < 0.5) & (rows[:, 1] > 0.3)).astype(float)
    forest = fit(rows, label, np.array([-1, 1, 0]))
    assert ((forest.score(rows) > 0.5) == label).mean() > 0.97
    line = np.repeat(rows[:50], 40, axis=0)
    line[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(forest.score(line).reshape(50, 40), axis=1) <= 1e-12).all()
    assert fit(rows, np.ones(800), np.zeros(3)) is None and fit(rows[:0], label[:0], np.zeros(3)) is None


def test_quality_edges(spark):
    docs = frame(spark, [(*r, "x") for r in EDGES], ", quality string")
    out = quality.judged(docs, None)
    assert out.columns[-1] == "_quality" and out.count() == len(EDGES)
    assert [r._quality.kept for r in out.where("doc_id <= 3").collect()] == [False] * 3
    assert quality.keep_good(docs, None).count() == 0 and quality.keep_good(docs.limit(0), None).columns == docs.columns
    none = spark.createDataFrame([(None, None)], "doc_id bigint, quality int")
    assert quality.train(docs, none) is None and quality.train(docs.limit(0), none.limit(0)) is None


def test_languages_held_out(spark):
    # The smallest table has few rows of each language; the next one is still small.
    rows = queries.language_id(spark, "/root/testdata/sf0.01").join(queries.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where(
        "held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixtures_find_both_languages(spark):
    texts = duckdb.sql(f"SELECT lang, text FROM '{SF}/documents.parquet' WHERE length(text) > 1500 ORDER BY doc_id").fetchall()
    learned = langid.learn(queries.table(spark, SF, "documents"))
    by = {}
    for lang, text in texts:
        by.setdefault(lang, text[:1500])
    en, fr = by["en"].encode(), by["fr"].encode()
    share, _ = langid.mixtures([en + b" " + fr, en, None, b"123"], learned)
    found = dict(zip(learned.names, share[0]))
    assert 0.3 < found["en"] < 0.7 and 0.3 < found["fr"] < 0.7 and share[1].max() > 0.9 and not share[2:].any()


def test_mixtures_find_four_languages(spark):
    rows = duckdb.sql(f"SELECT lang, string_agg(text, ' ' ORDER BY doc_id) FROM '{SF}/documents.parquet' GROUP BY lang HAVING sum(length(text)) > 3000 ORDER BY lang").fetchall()[:5]
    learned = langid.learn(queries.table(spark, SF, "documents"))
    for n in (4, len(rows)):
        share, _ = langid.mixtures([" ".join(t[:3000] for _, t in rows[:n]).encode(), rows[0][1][:3000].encode()], learned)
        found = dict(zip(learned.names, share[0]))
        assert all(0.5 / n < found[lang] < 2 / n for lang, _ in rows[:n]) and share[1].max() > 0.9


def test_language_edges(spark):
    model = langid.learn(queries.table(spark, SF, "documents"))
    docs = frame(spark, EDGES)
    got = [(r.doc_id, r.v.lang_pred, r.v.score) for r in docs.select("doc_id", langid.predict(F.col("text"), model).alias("v")).collect()]
    assert {x[1] for x in got if x[0] in (1, 2, 3, 6)} == {"und"} and got[3] == got[4] and got[6][1] != "und"
    nothing = langid.learn(frame(spark, [], ", lang string"))
    assert docs.select(langid.predict(F.col("text"), nothing).alias("v")).where("v.lang_pred <> 'und'").count() == 0


@pytest.fixture(scope="module")
def both():
    with open(VOCABULARY, "rb") as f:
        return bpe.Vocabulary(f.read()), Tokenizer.from_file(VOCABULARY)


def ids(vocabulary, text):
    return np.frombuffer(b"".join(vocabulary.encode(text)), "<u4").tolist()


def test_tokens_equal_the_library(both):
    own, library = both
    rng = random.Random(1)
    odd = ["a", "e", "in", "th", "'s", "'re", " ", "\t", "\x1c", "\x85", " ", "é", "é", "́", "Σ", "İ", "ß", "中", "9", "²", "<|endoftext|>", "!!",
           "😀", "ﬁ", "한", "\x00", "ing", "tion", "A", "_", "᠎"]
    for _ in range(3000):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 30)))
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("unit", ["a", "ha", "!", "=", "aab", "thein"])
def test_long_words_stream_in_windows(both, unit):
    own, library = both
    assert ids(own, unit * 3000) == library.encode(unit * 3000, add_special_tokens=False).ids
    assert own.lookahead < 1000 and max(len(x) for x in own.transduce(unit.encode() * 3000)) <= own.window


@pytest.mark.parametrize("size", [1, 2, 3, 5, 11])
def test_slices_of_any_size_give_the_same_tokens(both, monkeypatch, size):
    """Words, endings, accents and special tokens that the ends of slices cut."""
    own, library = both
    monkeypatch.setattr(bpe, "SLICE", size)
    rng = random.Random(size)
    odd = ["a", "th", "ing", "'s", "'r", "e", "'", "é", "e\u0301", "\u0301", "Σ", "İ", "中", "9", "<|endoftext|>", "!!", "\u1112", "\u1161", "\u11ab", "한", "\U0001f600",
           "\u0958", "\u0f71", "\u0f72", "\u212b", " ", "ß"]
    for _ in range(1500):
        text = "".join(rng.choice(odd) for _ in range(rng.randint(0, 30)))
        own.known.clear()
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("unit", ["中文沒有空格", "x1", "lettersonly", "!=", "e\u0301'll"])
def test_long_texts_without_white_space_leave_in_pieces(both, unit):
    own, library = both
    text = unit * (2 * bpe.SLICE // len(unit) + 3)
    parts = list(own.encode(text))
    assert np.frombuffer(b"".join(parts), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(map(len, parts)) <= 4 * own.window * 4


def test_a_transducer_is_fed_in_pieces_of_any_size(both):
    own, _ = both
    raw = ("thein" * 900 + "aab" * 500).encode()
    whole = own.merge([*map(own.inner.__getitem__, raw[:-1]), own.final[raw[-1]]])
    for size in (1, 7, 1000, len(raw)):
        word, out = bpe.Transducer(own), []
        for k in range(0, len(raw), size):
            for stable in word.feed(raw[k:k + size]):
                out += stable
            assert len(word.held) <= own.window
        assert out + word.finish() == whole


def test_decoding_in_pieces(both):
    own, library = both
    text = "Über naïve 😀 words, and MORE of them; " * 20
    row = ids(own, text)
    for size in (1, 3, 1000):
        state, back = bpe.TokenText(own), bpe.ByteText(own)
        assert "".join(state.feed(row[k:k + size]) for k in range(0, len(row), size)) == library.decode(row, skip_special_tokens=False)
        read = "".join(back.feed(row[k:k + size]) for k in range(0, len(row), size)) + back.finish()
        assert re.sub(r"\s", "", read) == re.sub(r"\s", "", text.lower())


def test_token_edges(spark):
    file = bpe.load(spark, VOCABULARY)
    docs = frame(spark, EDGES)
    got = docs.select("doc_id", bpe.digests(F.col("text"), file, with_ids=True).alias("v"), bpe.encode(F.col("text"), file).alias("e")).select("*", bpe.decode(F.col("e"), file).alias("d"))
    rows = got.collect()
    assert [r.v.n_tokens for r in rows[:3]] == [0, 0, 0] and rows[3].v == rows[4].v and rows[3].v.n_tokens == 40_000
    assert all(r.v.ids == r.e for r in rows) and rows[0].d == ""
    assert docs.limit(0).select(bpe.encode(F.col("text"), file)).count() == 0


def test_chat_equals_check_sql(spark):
    assert compare(spark, connect(SF), queries.chat_format, checks.chat_format(), SF).startswith("ok")


def test_chat_round_trip_and_mask(spark):
    hard = ["\\", "\\h", "### a: b", "</turn>\n</also>", "<", "", None, "\\\\b###\n"]
    turns = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for t in hard for r in ("user", "user", "assistant", "a: ### r"))]
    turns += [(2, None, None, None), (2, 5, "assistant", "x"), (2, 5, "assistant", "x"), (None, 1, "assistant", "lost"), (3, 1, "user", "y" * 100_000)]
    frame_ = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = chat.format_conversations(frame_).select("*", chat.read_turns(F.col("formatted")).alias("read"))
    rows = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in rows[1].read] == [(r or "", t or "") for c, _, r, t in turns if c == 1]
    assert [(t.role, t.text) for t in rows[2].read] == [("", ""), ("assistant", "x"), ("assistant", "x")]
    for r in rows.values():
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [r.formatted[s.start:s.end] for s in r.loss_spans] == [s.text for s in r.segments if s.loss]
    assert rows[1].formatted.count(chat.END) == 24 and len(rows[None].loss_spans) == 1
    assert chat.summary(chat.format_conversations(frame_.limit(0))).count() == 0
