"""Near-duplicates, lines, decontamination, surrogates, credentials, archives and the pipeline."""

from __future__ import annotations

import gzip
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from satchel.llm import checks, credentials, decontaminate, lines, queries, setsketch, surrogates, warc
from satchel.llm.components import components
from tests.run_checks import compare, connect

SF = "/root/testdata/sf0.001"
LONG = "word " * 40_000
EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (4, LONG), (None, "no id here"), (None, None), (5, "é")]


def frame(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(60)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)] + [(7, 7), (5, 4), (4, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in {y for p in pairs if p[0] != p[1] for y in p}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_components(rows, percent):
    sets = {i: set(setsketch.shingles((t or "").encode()).tolist()) for i, t in rows}
    root = {i: i for i in sets}
    for _ in range(len(root)):
        before = dict(root)
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    root[i] = min(root[i], root[j])
        if before == root:
            return root


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = []
    for k in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 999)}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join(f"z{rng.randint(0, 10**6)}" for _ in range(60))) for k in range(20)] + [(200, "A b C"), (201, "a B c"), (202, "a b"), (203, rows[0][1].upper())]
    got = setsketch.near_duplicates(frame(spark, rows), 85).collect()
    want = brute_components(rows, 85)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (want[r.doc_id] == r.doc_id) for r in got) and len(set(want.values())) > 25


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    for share in (0.3, 0.85, 1.0):
        common = int(1000 * 2 * share / (1 + share))
        a, b = pool[:1000], pool[1000 - common:2000 - common]
        ra, rb = setsketch.registers(a), setsketch.registers(b)
        assert abs(setsketch.likely_similarity((ra > rb).sum(), (ra < rb).sum(), 1000, 1000)[0] - share) < 0.12
        assert (setsketch.registers(np.union1d(a, b)) == np.maximum(ra, rb)).all()
    assert setsketch.rows_of_band(0.85) == 8


def test_near_duplicate_edges(spark):
    got = setsketch.near_duplicates(frame(spark, [(*e, "x") for e in EDGES], "doc_id bigint, text string, root string"), 80).collect()
    assert len(got) == len(EDGES)
    assert all(r.n_shingles == 0 and r.kept and r.component_id == r.doc_id for r in got if r.doc_id in (1, 2, 3))
    assert all(r.n_shingles == 1 and r.kept for r in got if r.doc_id == 4)
    assert setsketch.near_duplicates(frame(spark, [])).count() == 0
    docs = frame(spark, [(1, "a b c d e f", 1), (2, "a b c d e f", 2), (None, "a b c d e f", 3)], "doc_id bigint, text string, rep int")
    assert [r.rep for r in setsketch.keep_one(docs).orderBy("rep").collect()] == [1, 3]


def brute_lines(rows, least=5):
    def key(x):
        k = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
        return re.sub("[A-Z]", lambda m: m[0].lower(), k)

    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if len(holders.get(key(x), ())) < least or i == max(holders[key(x)])]
        out[i] = (len(parts), len(parts) - len(kept), "\n".join(kept))
    return out


def line_rows(n=40):
    rng = random.Random(9)
    pool = [f"  Line {k} of the pool, long enough to count É" + "x" * k for k in range(12)] + ["short", "", "é" * 39, "É" * 41]
    return [(i, "\n".join(rng.choice(pool) if rng.random() < 0.8 else rng.choice(pool).upper() + " \t" for _ in range(rng.randint(0, 9)))) for i in range(n)]


def answers(docs, state):
    return {r.doc_id: (r.lines.n_lines, r.lines.n_dropped, r.lines.text) for r in lines.resolve(docs, state).collect()}


def test_lines_are_reversible(spark):
    rows = line_rows()
    first, second = frame(spark, rows[:25]), frame(spark, rows[25:])
    state = lines.begin(first, shards=2)
    assert answers(first, state) == brute_lines(rows[:25])
    grown = lines.insert(state, second)
    assert answers(frame(spark, rows), grown) == brute_lines(rows)
    back = lines.delete(grown, frame(spark, [(i,) for i, _ in rows[10:]], "doc_id bigint"))
    assert answers(frame(spark, rows[:10]), back) == brute_lines(rows[:10])
    assert {(r.shard, bytes(r.key), r.n_docs) for r in back.counts.collect()} == {
        (r.shard, bytes(r.key), r.n_docs) for r in lines.begin(frame(spark, rows[:10]), shards=2).counts.collect()}


def test_lines_without_broadcast(spark, monkeypatch):
    rows = line_rows()
    monkeypatch.setattr(lines, "MOST_BROADCAST", -1)
    docs = frame(spark, rows)
    assert answers(docs, lines.begin(docs)) == brute_lines(rows)


def test_cuckoo_filter():
    rng = np.random.default_rng(8)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    made = lines.build(keys)
    assert made.has(keys).all() and made.has(rng.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.01
    made.delete(keys[:2500])
    assert made.has(keys[2500:]).all() and made.has(keys[:2500]).mean() < 0.01
    assert lines.Cuckoo.load(made.dump()).has(keys[2500:]).all()


def test_line_edges_and_check_sql(spark):
    docs = frame(spark, [(*e, 1) for e in EDGES], "doc_id bigint, text string, lines int")
    out = lines.resolve(docs, lines.begin(docs)).collect()
    assert len(out) == len(EDGES) and {(r._lines.n_lines, r._lines.n_dropped, r._lines.text) for r in out if r.doc_id in (1, 2)} == {(1, 0, "")}
    assert [r.text for r in lines.without_repeats(docs).where("doc_id = 1").collect()] == [None]
    assert lines.without_repeats(docs.limit(0)).columns == docs.columns
    assert compare(spark, connect(SF), queries.line_dedup, checks.line_dedup(), SF).startswith("ok")


def brute_leaks(text, items):
    words, out = decontaminate.words_of((text or "").encode()), {}
    for i, t in items:
        w = decontaminate.words_of(t.encode())
        bag, span = Counter(decontaminate._shingles(w)), min(len(w), len(words))
        for s in range(len(words) - span + 1 if w and words else 0):
            close = decontaminate.similarity(Counter(decontaminate._shingles(words[s:s + span])), bag)
            if close >= 0.8 and close > out.get(i, (0, 0))[0]:
                out[i] = (close, s)
    return out


def test_leaks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    items = [(k, " ".join(f"w{rng.randint(0, 60)}" for _ in range(rng.choice((3, 6, 20, 30))))) for k in range(14)] + [(90, "a a a a a a a a"), (91, "One")]
    rows = []
    for k in range(150):
        words = []
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1].split()
            cut = rng.randint(0, 2)
            words += w[cut:] + [rng.choice(("x", "w1", "ONE")) for _ in range(rng.randint(0, 4))]
            if rng.random() < 0.3:
                words[rng.randrange(len(words))] = "y"
        rows.append((k, " ".join(words)))
    rows += [(200, None), (201, "")]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    benchmark = frame(spark, [*items, (92, None), (None, "w1")], "item_id bigint, text string")
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (200,))
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontaminate.leaks(frame(spark, rows), benchmark).collect()}
    assert got == {(i, k): v for i, t in rows for k, v in brute_leaks(t, items).items()} and len(got) > 60
    kept = {r.doc_id for r in decontaminate.without_leaks(frame(spark, [*rows, (None, "x")]), benchmark).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got} | {None}
    assert decontaminate.leaks(frame(spark, []), benchmark).count() == 0 and decontaminate.leaks(frame(spark, rows), benchmark.limit(0)).count() == 0


PRIVATE = [
    (1, "Mail Bob.Smith@Mail.example.com or bob.smith@mail.example.com, call +1 (777) 555-7427. Card 4111 1111 1111 1111 and 4111111111111111."),
    (2, "Mrs. Anna Smith met Mr. Karl Smith at 39.197.112.39. SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00. г-н Иван Петров"),
    (3, "again 39.197.112.39, then 39.197.112.38."), (4, "nothing 12 34."), *((i and i + 10, t) for i, t in EDGES)]


def luhn(number):
    digits = [int(c) for c in number[::-1]]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0


def test_surrogates_keep_type_and_identity(spark):
    docs = spark.createDataFrame([(*r, "kept") for r in PRIVATE], "doc_id bigint, text string, entities string")
    rows = {r.doc_id: r for r in surrogates.replace(docs, "k").collect()}
    one, two, three = rows[1].text, rows[2].text, rows[3].text
    assert not re.search("(?i)bob|smith|4111|7427|39\\.197|6789|3704|Иван|Anna", one + two + three)
    mails = re.findall(r"\S+@\S+?\.com", one)
    assert mails[0].lower() == mails[1] and mails[0] != mails[1] and "+1 (" in one
    cards = re.findall(r"(?:\d{4} ?){4}", one)
    assert cards[0].replace(" ", "").strip() == cards[1].strip(" .") and luhn(cards[1].strip(" ."))
    ip = re.findall(r"\d+\.\d+\.\d+\.\d+", two + " " + three)
    assert ip[0] == ip[1] != ip[2] and all(0 <= int(x) < 256 for x in ".".join(ip).split("."))
    names = re.search(r"Mrs\. (\w+) (\w+) met Mr\. (\w+) (\w+)", two)
    assert names[2] == names[4] and names[1] in surrogates.GIVEN["f"] and names[3] in surrogates.GIVEN["m"]
    assert re.search(r"г-н [А-Я][а-я]+ [А-Я][а-я]+$", two)
    assert rows[4].text == "nothing 12 34." and rows[11].text is None and rows[12].text == "" and rows[14].text == LONG and rows[4].entities == "kept"
    assert rows[2]._entities.n_person == 3 and surrogates.replace(docs.limit(0), "k").count() == 0
    assert surrogates.replace(docs, "other").where("doc_id = 1").first().text != one


def test_clashing_surrogates_get_further_attempts(spark):
    docs = frame(spark, [(k, f"at {k % 10}.{k // 10 % 10}.1.{k // 100}") for k in range(100, 900)])
    later = surrogates.attempts(surrogates.entities(docs), "k")
    assert later.count() > 0
    out = [r.text for r in surrogates.replace(docs, "k").collect()]
    assert len(set(out)) == docs.select("text").distinct().count()
    assert not set(out) & {r.text for r in docs.collect()}


def test_phone_surrogates_are_compared_as_printed(spark):
    docs = frame(spark, [(1, "+15551234567"), (2, "+1 555 123 4567"), (3, "+1 (555) 123-4567"), (4, "+4930123456"), (5, "+49 30 123456"),
                         *((100 + k, f"+1 {k // 100:02} {k % 100:02}") for k in range(0, 10_000, 16))])
    out = {r.doc_id: r.text for r in surrogates.replace(docs, "k").collect()}
    assert len({re.sub(r"\D", "", out[k]) for k in (1, 2, 3)}) == 1 and out[1].startswith("+1") and out[2].startswith("+1 ") and "+1 (" in out[3]
    assert re.sub(r"\D", "", out[4]) == re.sub(r"\D", "", out[5]) and out[4].startswith("+49")
    short = [t for k, t in out.items() if k >= 100]
    assert len(set(short)) == len(short) and not set(short) & {r.text for r in docs.collect()}


def test_full_spaces_get_wider_surrogates(spark):
    forms = [f"{a}.{b}.{c}.{d}" for a in range(1, 10) for b in range(1, 10) for c in range(1, 10) for d in range(1, 10)]
    forms += [f"{a}@{b}.co" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"] + ["_@-.co"] + [f"+351 {k:02}" for k in range(100)]
    out = [r.text for r in surrogates.replace(frame(spark, list(enumerate(forms))), "k").collect()]
    assert len(set(out)) == len(forms) and not set(out) & set(forms)
    assert sum(bool(re.fullmatch(r"(\d{1,3}\.){3}\d{1,3}", x)) and all(int(p) < 256 for p in x.split(".")) for x in out) == 6561
    assert sum(bool(re.fullmatch(r"[a-z_]+@[a-z-]\.co", x)) for x in out) == 677 and sum(bool(re.fullmatch(r"\+351 \d{2,}", x)) for x in out) == 100


def test_persons_of_one_name_agree(spark):
    given = [f"{a}{b}{c}o" for a in "BDFGK" for b in "aeiou" for c in "lmnr"]
    docs = frame(spark, [(1, "Mr. John Smith came. Later Mr. Smith left, and Smith's friend John said: John Smith, SMITH; but smiths smith."), (2, "Dr. Anna Smith"), (3, "Mrs. Anna Smith"),
                         (4, "Smith alone"), (None, "Mr. Boro Smith’s"), *((100 + k, f"Mr {x} Smith") for k, x in enumerate(given)), (5, "Ms Zola Jones, mail Jones@x.example.com Jones")])
    rows = surrogates.replace(docs, "k").collect()
    out = {r.doc_id: r.text for r in rows}
    john, smith = re.match(r"Mr\. (\S+) (\S+) came", out[1]).groups()
    assert out[1] == f"Mr. {john} {smith} came. Later Mr. {smith} left, and {smith}'s friend {john} said: {john} {smith}, {smith}; but smiths smith."
    assert out[2].split()[1:] == out[3].split()[1:] and out[2].split()[1].split("-")[0] in surrogates.GIVEN["f"] and out[3].endswith(smith)
    assert out[4] == "Smith alone" and next(r for r in rows if r.doc_id == 1).entities.n_person == 6
    persons = [out[100 + k].split() for k in range(len(given))]
    assert {p[2] for p in persons} == {smith} and len({p[1] for p in persons}) == len(given) and all(p[1].split("-")[0] in surrogates.GIVEN["m"] for p in persons)
    assert out[None].split()[1:] == [out[100 + given.index("Boro")].split()[1], smith + "’s"]
    assert "Jones" not in out[5] and out[5].split()[2].rstrip(",") == out[5].split()[-1]


def test_surrogate_query_is_native(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text")
    for plan in (surrogates.replace(docs, "k"), queries.secret_scan(spark, SF), queries.chat_format(spark, SF)):
        assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())


def test_credentials_equal_check_sql(spark, tmp_path):
    assert compare(spark, connect(SF), queries.secret_scan, checks.secret_scan(), SF).startswith("ok")
    secret = "Ab3" * 8
    rows = [(1, "secret=token = abcdefgh 'API-key' apikey:'qwerty12'", "a"), (2, f"{secret} and {secret}", "a"), (3, f"x {secret}é", None), (4, "password=example99", "b"),
            (5, None, None), (6, "", "a"), (7, "0123456789abcdef0123456789 AKIA" + "B" * 30 + " " + "é" * 9 + "passwd = \"secret/+=._-\"", "c"), (8, "y " * 30_000, "c"), (8, "y " * 30_000, "c")]
    docs = spark.createDataFrame([(*r, "en", 0) for r in rows], "doc_id bigint, text string, source string, lang string, row int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = connect(SF)
    con.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(spark, con, queries.secret_scan, checks.secret_scan(), str(tmp_path)) == f"ok ({len(rows)})"
    got = {r.doc_id: r for r in queries.secret_scan(spark, str(tmp_path)).collect()}
    assert got[2].n_shared == 2 and got[4].n_example == 1 and got[1].n_live == 1 and got[5].spans == ""
    assert credentials.scan(docs.limit(0), F.col("source"), F.col("lang")).count() == 0


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "u", "same"), (2, "u", "same"), (3, None, ""), (4, "u\r\nv", None), (5, "u", "é" * 100_000), (6, "u", "same"), (6, "u", "same"), (None, "u", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, last string")
    got = warc.read_pages(warc.archived(spark, warc.page_records(pages))).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert [by[k].record_type for k in (1, 2, 3, 4, 5, 6)] == ["revisit", "revisit", "revisit", "response", "response", "response"]
    assert by[1].refers_to == by[None].refers_to == 6 and by[3].refers_to == 4 and by[5].payload_bytes == 200_000
    assert all(r.payload_digest == warc.digest((dict((p, h or "") for p, _, h in rows)[r.page_id]).encode()) for r in got)
    assert warc.archived(spark, warc.page_records(pages.limit(0))).count() == 0
    assert compare(spark, connect(SF), queries.warc_archives, checks.warc(), SF).startswith("ok")
    assert warc.page_records(pages, least_bytes=5).where("record_type = 'revisit'").count() == 0


def test_reader_survives_damage():
    row = {"record_id": "urn:page:1", "record_type": "response", "uri": "u", "payload": b"hello" * 50, "payload_bytes": 250, "payload_digest": None, "refers_to": None}
    one = warc.member(row)
    raw = gzip.decompress(one)

    def packed(data):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        return c.compress(data) + c.flush()

    wrong = packed(raw.replace(b"hello", b"jello", 1))
    short = packed(raw[:-9])
    broken = bytearray(one)
    broken[len(one) // 2] ^= 0xFF
    for size in (1, 7, 1 << 16):
        data = one + wrong + short + bytes(broken) + one + one[:40]
        got = list(warc.records(data[k:k + size] for k in range(0, len(data), size)))
        assert got[0][3] == b"hello" * 50 and got[0][7] is None
        assert "digest" in got[1][7] and got[2][7] == "length differs" and got[-1][7] == "damaged member"
        assert any(r[7] is None for r in got[3:-1])
    big = packed(raw[:raw.index(b"Content-Length: ")] + b"no length\r\n\r\n")
    assert list(warc.records([big]))[0][7] == "no length"


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, kept, SF)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        before, kept = kept, spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.count() <= before.count()
        if name == "line_dedup":
            want = brute_lines([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {i: (w[2], len(w[2])) for i, w in want.items()}
        if name == "near_dedup":
            want = brute_components([(r.doc_id, r.text) for r in before.collect()], 80)
            assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in before.collect() if not brute_leaks(r.text, items)}
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in kept.collect()} and all(len(r.ids) == r.n_tokens for r in last)


def test_filters_decide_by_row(spark):
    one, two, other = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "nothing of the kind at all here")
    docs = spark.createDataFrame([(3, one, 1), (5, one, 2), (5, two, 3), (6, two, 4), (5, two, 5), (7, other, 6), (7, other, 7), (None, "x", 8), (8, None, 9), (9, "", 10), (9, "", 11)],
                                 "doc_id bigint, text string, row int")
    got = sorted(r.row for r in setsketch.keep_one(docs).collect())
    assert [k for k in got if k not in (3, 5, 6, 7)] == [1, 8, 9, 10, 11] and len({3, 5} & set(got)) == len({6, 7} & set(got)) == 1
    bench = spark.createDataFrame([(1, one)], "item_id bigint, text string")
    docs = spark.createDataFrame([(3, one, 1), (3, two, 2), (None, f"so {one} it", 3), (None, two, 4), (None, None, 5)], "doc_id bigint, text string, row int")
    assert sorted(r.row for r in decontaminate.without_leaks(docs, bench).collect()) == [2, 4, 5]


def test_pipeline_on_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame([(*e, "en", None, 1) for e in EDGES], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for part in (docs, docs.limit(0)):
        for _, function in corpus_pipeline.STAGES:
            assert function(spark, part, SF).count() <= part.count()


@pytest.mark.parametrize("name", sorted(checks.statements()))
def test_check_sql_has_a_query(name):
    assert name in queries.registry()
