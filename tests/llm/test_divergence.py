"""The divergence audit against a dense brute force in Python integers."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from satchel.llm import checks, divergence, queries
from tests.run_checks import compare, connect

SF = "/root/testdata/sf0.001"
SCHEMA = "lang string, source string, text string"


def brute(rows, least=10, top=10):
    docs = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for _, _, t in docs]
    df, n = Counter(), Counter()
    for (lang, source, _), w in zip(docs, words):
        df.update((lang, t) for t in set(w))
        n.update((lang, source, t) for t in w)
    groups = sorted({d[:2] for d in docs})
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for x, t in df if x == lang and df[x, t] >= least]
        sources = [s for x, s in groups if x == lang]
        counts = {s: {t: n[lang, s, t] for t in kept} for s in sources}
        counts[None] = {t: sum(counts[s][t] for s in sources) for t in kept}

        def p(s, t):
            return 1 + 10**9 * (counts[s][t] + 2) // (sum(counts[s].values()) + 2 * len(kept))

        def f(s, o, t):
            return (p(s, t) - p(o, t)) ** 2 // (p(s, t) + p(o, t))

        for s in sources:
            pairs = [(sum(f(s, o, t) for t in kept), o) for o in sources if o != s]
            terms = [(f(s, None, t), t) for t in kept if counts[s][t] and p(s, t) > p(None, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return Counter(out)


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return Counter(tuple(r) for r in divergence.audit(df, **more).collect())


def test_audit_equals_brute_force(spark):
    rng = random.Random(13)
    pool = ["the", "The", "of", "été", "ÉTÉ", "x-ray", "a1b2", "naïve", "zß", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = []
    for k in range(220):
        source = rng.choice(["a", "a", "a", "b", "c", None, "", "ü"])
        rows.append((rng.choice(["en", "en", "de", None]), source, " ".join(rng.choices(pool, k=rng.randint(0, 25)))))
    hot = ("en", "a", "the hot text of every crawl " * 3)
    rows += [hot] * 120 + [("en", "b", hot[2])] * 7 + [("fr", "only", "un deux")] * 3
    rows += [("it", "x", None), ("it", "y", ""), ("it", "y", "1 2 3 ..."), (None, None, None)]
    want = brute(rows)
    assert got(spark, rows) == want
    assert {r[0] for r in want if r[4] == 0 and r[2] == "pair"} >= {"it"}  # no kept term: value 0
    assert got(spark, rows, least_docs=40, top=2) == brute(rows, 40, 2)


def test_edges(spark):
    assert got(spark, []) == Counter()
    assert got(spark, [(None, None, None)]) == Counter()
    long = ("alpha beta " * 30_000 + "end") + "x" * 3_000_000
    rows = [("en", "a", long)] * 10 + [("en", "b", "alpha")]
    assert got(spark, rows) == brute(rows)
    extra = spark.createDataFrame([("en", "s", "t", 1, "h")] * 3, "lang string, source string, text string, n int, h string")
    assert divergence.audit(extra, least_docs=1).count() == 0
    other = spark.createDataFrame([("en", s, "t u", 1, "h") for s in "ab"], "lang string, source string, text string, v int, cells string")
    assert Counter(tuple(r) for r in divergence.audit(other, least_docs=1).collect()) == brute([("en", s, "t u") for s in "ab"], 1)


def test_terms_of_cuts_at_terms():
    raw = "Über alles, x1y\x00Z é—ß end".encode()
    whole = [w for x in divergence.terms_of(raw) for w in x]
    for piece in range(1, 12):
        assert [w for x in divergence.terms_of(raw, piece) for w in x] == whole
    assert whole == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+".encode().replace(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]", rb"[a-z\x80-\xff]"), raw.lower())


def test_copies_are_split_once(spark):
    rows = [("en", s, "same text") for s in "aabbbc"] + [("de", "a", "same text")]
    found = {(r.lang, r.text): sorted((s.source, s.n) for s in r.sources) for r in divergence.distinct_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {("en", "same text"): [("a", 2), ("b", 3), ("c", 1)], ("de", "same text"): [("a", 1)]}


def test_query_equals_sql(spark):
    con = connect(SF)
    assert compare(spark, con, queries.source_divergence, checks.source_divergence(), SF).startswith("ok")
