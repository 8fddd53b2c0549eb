"""The quick look that spares texts the long pattern never hides a match."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from satchel.llm import surrogates


def made(rng: random.Random) -> str:
    """A string that some pattern may match, often of its shortest form, at the end of a text or not."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    up = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
    sep = lambda: rng.choice(["", " ", ".", "-"])
    any_ = lambda n: "".join(rng.choice("ABCXYZ" if rng.random() < 0.7 else "0189") for _ in range(n))
    titles = [t for table in (surrogates.TITLES, surrogates.CYRILLIC_TITLES) for names in table.values() for t in names.split("|")]
    return rng.choice([
        lambda: f"{rng.choice('aЖé9')}@{rng.choice('bß')}.c",
        lambda: up(2) + d(2) + "".join(rng.choice(["", " "]) + any_(4) for _ in range(rng.randint(3, 7))),
        lambda: ".".join(str(rng.choice([0, 7, 45, 199, 255])) for _ in range(4)),
        lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: rng.choice(["", "+" + d(rng.randint(1, 3)) + sep()]) + f"({d(rng.randint(2, 4))}){sep()}{d(rng.randint(3, 4))}{sep()}{d(rng.randint(3, 4))}",
        lambda: "+" + d(rng.randint(1, 3)) + "".join(sep() + d(rng.randint(2, 4)) for _ in range(rng.randint(2, 4))),
        lambda: f"{d(3)}.{d(3)}-{d(4)}",
        lambda: "".join(d(1) + rng.choice(["", "", " ", "-"]) for _ in range(rng.randint(12, 18))) + d(1),
        lambda: f"{rng.choice(titles)}{rng.choice(['', '.'])} {rng.choice(['Ada', 'Ōe', 'Иван', 'Žď'])}{rng.choice(['', ' Lee'])}",
    ])()


def test_every_match_has_a_hint(spark):
    rng = random.Random(8)
    texts = [rng.choice(["", "x ", "call "]) + made(rng) + rng.choice(["", "", ".", " and more"]) for _ in range(6000)]
    texts += ["call +12233", "+12233", "IBAN MT84MALTAAAABBBBCCCC", "(12)3456789", "Dr. Ōe"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_count("t", F.lit(surrogates.ANY)).alias("n"))
    assert df.where("n > 0").count() > 4000
    lost = df.where((F.col("n") > 0) & ~(F.contains("t", F.lit("@")) | F.col("t").rlike(surrogates.HINT)))
    assert lost.collect() == []


def test_short_phones_and_lettered_ibans_are_replaced(spark):
    rows = [(1, "call +12233"), (2, "IBAN MT84MALTAAAABBBBCCCC")]
    got = {r.doc_id: r.text for r in surrogates.replace(spark.createDataFrame(rows, "doc_id bigint, text string"), "k").collect()}
    assert "+12233" not in got[1] and got[1].startswith("call +1") and "MALTAAAABBBBCCCC" not in got[2] and got[2].startswith("IBAN ")
