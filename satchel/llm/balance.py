"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards.

Documents are linked by values they share (equal texts, say; a document may have several).
The law is ``rows``: with n documents and k shards, shard s holds n div k documents, and one
more if s < n mod k, in every state from the first to the last.

The graph is kept small.  Documents with the same links are interchangeable, so the state is
``(bunch, shard, m)``: m documents of a bunch lie in a shard.  A bunch has at most as many rows
as there are shards, whatever its size; documents without a partner take no part and later fill
the shards up.  The first state deals the linked documents out in turn, regardless of links.  Then,
round by round, all by joins and sums:

1. Each link counts its members in every shard and names as its homes the fewest of these
   shards that can hold it, the fullest first: one, or as many as a link larger than a shard needs.
2. A row outside the homes of its links proposes to move to the home with the most neighbours.
3. Quotas: what two shards want to send each other is exchanged; what goes further in one direction
   fills room, or the place of bunches that lie whole in the target, share their links with no
   other and so may go the other way.  Moves are granted by gain; the last one may be granted in part.

Rounds alternate between homes by shard size and homes by present room, and the ties are
drawn anew.  They end when no link is cut that need not be, when two rounds in a row have not
brought more neighbours together, or after ``rounds``, which bounds the time but not the law.

Null links are no links; a null or empty text is the empty text.  Rows that repeat an
id are documents of their own.  Fewer documents than shards leave shards empty; no
documents, no rows.  Names of given columns may be any: the results are called ``shard`` and
``slot``, with underscores before the name where a given column has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from satchel.llm.common import fresh
from satchel.plans.running import ordinals, running_total
from satchel.plans.session import stage

SHARDS, ROUNDS = 40, 12


def text_link(text: Column) -> Column:
    """The link of a document to all with the same text."""
    return F.array(F.md5(F.coalesce(text, F.lit(""))))


def _whole(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint") if isinstance(b, int) else b)


def _at(numbers: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x).cast("bigint") for x in numbers)), shard + 1)


def _start(bunches: DataFrame, shards: int) -> DataFrame:
    """The linked documents dealt out in turn, in the order of their bunch's hash."""
    placed = running_total(bunches.select("bunch", "n"), ["bunch"], F.col("n"), "o")
    turns = placed.select("bunch", "n", "o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("n", F.lit(shards)) - 1)).alias("j"))
    return turns.select("bunch", ((F.col("o") + F.col("j")) % shards).cast("int").alias("shard"), _whole(F.col("n") - F.col("j") + shards - 1, shards).alias("m"))


def _homes(state: DataFrame, links: DataFrame, room: list[int], cap: int, turn: int) -> DataFrame:
    """``link, entries, homes, spread``: members by shard; the shards that shall hold the link; how many they need be."""
    counts = state.join(links, "bunch").groupBy("link", "shard").agg(F.sum("m").alias("n"))
    tie = F.xxhash64("link", "shard", F.lit(turn))
    lists = counts.groupBy("link").agg(F.sum("n").alias("total"), F.collect_list(F.struct("shard", "n", tie.alias("tie"))).alias("found"))
    total = F.col("total")

    def holds(e: Column) -> Column:
        return F.least(total, F.lit(cap) if turn % 2 == 0 else e["n"] + _at(room, e["shard"]))

    ranked = F.sort_array(F.transform("found", lambda e: F.struct((-holds(e)).alias("less"), (-e["n"]).alias("n"), e["tie"].alias("tie"), e["shard"].alias("shard"))))
    begin = F.struct(F.lit(0).cast("bigint").alias("held"), F.array().cast("array<int>").alias("homes"))
    chosen = F.aggregate(ranked, begin, lambda a, e: F.struct(
        (a["held"] - e["less"]).alias("held"), F.when(a["held"] < total, F.concat(a["homes"], F.array(e["shard"]))).otherwise(a["homes"]).alias("homes")))
    return lists.select("link", F.map_from_entries(F.transform("found", lambda e: F.struct(e["shard"], e["n"]))).alias("here"), chosen["homes"].alias("homes"),
                        (F.size("found") > _whole(total + cap - 1, cap)).alias("cut"),
                        F.aggregate("found", F.lit(0).cast("decimal(38,0)"), lambda a, e: (a + e["n"].cast("decimal(19,0)") * e["n"]).cast("decimal(38,0)")).alias("together"))


def _proposals(state: DataFrame, links: DataFrame, info: DataFrame, turn: int) -> DataFrame:
    """``bunch, shard, m, target, worth``: rows that have more neighbours in a home of one of their
    links; with a null target those whose links are theirs alone, and which may be anywhere."""
    known = state.join(links, "bunch").join(info.select("link", "here", "homes"), "link")
    drawn = F.element_at("homes", (F.pmod(F.xxhash64("bunch", "shard", F.lit(turn)), F.size("homes")) + 1).cast("int"))
    goal = F.when(F.array_contains("homes", F.col("shard")), F.col("shard")).otherwise(drawn)
    rows = known.withColumn("goal", goal).groupBy("bunch", "shard", "m").agg(F.collect_list("here").alias("here"), F.collect_set("goal").alias("goals"))
    shard, m, none = F.col("shard"), F.col("m"), F.lit(0).cast("bigint")

    def neighbours(c: Column) -> Column:
        return F.aggregate("here", none, lambda a, h: a + F.coalesce(h[c], none) - F.when(c == shard, m).otherwise(none))

    best = F.array_max(F.transform("goals", lambda c: F.struct(neighbours(c).alias("near"), c.alias("shard"))))
    alone = F.forall("here", lambda h: (F.size(h) == 1) & (h[shard] == m))
    found = rows.select("bunch", "shard", "m", best.alias("best"), neighbours(shard).alias("now"), alone.alias("alone"))
    moves = (F.col("best.shard") != shard) & (F.col("best.near") > F.col("now"))
    return found.where(moves | F.col("alone")).select(
        "bunch", "shard", "m", F.when(moves, F.col("best.shard")).alias("target"), (F.col("now") - F.col("best.near")).alias("worth"))


def _quotas(proposals: DataFrame, room: list[int], turn: int) -> DataFrame:
    """``shard, target, quota, left``: exchanges first, the rest as far as the target has room."""
    wanted = proposals.groupBy("shard", "target").agg(F.sum("m").alias("d"))
    back = wanted.select(F.col("target").alias("shard"), F.col("shard").alias("target"), F.col("d").alias("e"))
    both = wanted.join(back, ["shard", "target"], "left").withColumn("swap", F.least("d", F.coalesce("e", F.lit(0))))
    rest = F.col("d") - F.col("swap")
    # At most one row for each two shards.
    order = Window.partitionBy("target").orderBy(F.xxhash64("shard", F.lit(turn)), "shard").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(rest).over(order), F.lit(0))
    both = both.withColumn("quota", F.col("swap") + F.greatest(F.lit(0), F.least(rest, _at(room, F.col("target")) - before)))
    return both.select("shard", "target", "quota", (F.col("d") - F.col("quota")).alias("left"))


def _give_way(offers: DataFrame, quotas: DataFrame) -> DataFrame:
    """``bunch, shard, target, moves``: rows that may be anywhere, sent from full shards to those
    that still want to send there, never more than these want."""
    order = Window.partitionBy("target").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    gaps = quotas.where("left > 0").withColumn("start", F.coalesce(F.sum("left").over(order), F.lit(0)))
    gaps = gaps.groupBy(F.col("target").alias("shard")).agg(F.collect_list(F.struct("start", "left", F.col("shard").alias("to"))).alias("gaps"))
    offers = offers.join(gaps.select("shard"), "shard", "left_semi")
    queued = running_total(offers, ["m", "bunch"], F.col("m"), "before", ["shard"]).join(gaps, "shard")
    fits = F.filter("gaps", lambda g: (g["start"] <= F.col("before")) & (F.col("before") + F.col("m") <= g["start"] + g["left"]))
    return queued.withColumn("fits", fits).where(F.size("fits") > 0).select("bunch", "shard", F.get("fits", 0)["to"].alias("target"), F.col("m").alias("moves"))


def _moved(state: DataFrame, proposals: DataFrame, room: list[int], turn: int) -> DataFrame:
    wanting = proposals.where("target IS NOT NULL")
    quotas = stage(_quotas(wanting, room, turn), "quotas")
    gone_by = _give_way(proposals.where("target IS NULL").select("bunch", "shard", "m"), quotas)
    more = gone_by.groupBy(F.col("target").alias("shard"), F.col("shard").alias("target")).agg(F.sum("moves").alias("more"))
    quotas = quotas.join(more, ["shard", "target"], "left").withColumn("quota", F.col("quota") + F.coalesce("more", F.lit(0)))
    queued = running_total(wanting, ["worth", "bunch"], F.col("m"), "before", ["shard", "target"])
    granted = queued.join(quotas, ["shard", "target"]).withColumn("moves", F.least("m", F.col("quota") - F.col("before"))).where("moves > 0")
    granted = granted.select("bunch", "shard", "target", "moves").union(gone_by)
    gone = granted.select("bunch", "shard", (-F.col("moves")).alias("m"))
    come = granted.select("bunch", F.col("target").alias("shard"), F.col("moves").alias("m"))
    return state.union(gone).union(come).groupBy("bunch", "shard").agg(F.sum("m").alias("m")).where("m > 0")


def _loads(state: DataFrame, shards: int) -> list[int]:
    """Linked documents of each shard: one number a shard."""
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("m").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def propagate(bunches: DataFrame, links: DataFrame, caps: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``bunch, shard, m`` for ``bunches(bunch, n)`` joined by ``links(bunch, link)``, within ``caps``."""
    cap = max(caps)
    state = stage(_start(bunches, len(caps)), "labels")
    best, most, since = state, None, 0
    for turn in range(rounds + 1):
        room = [c - n for c, n in zip(caps, _loads(state, len(caps)))]
        info = stage(_homes(state, links, room, cap, turn), "homes")
        sums = info.agg(F.sum("together").alias("together"), F.count_if("cut").alias("cut")).first()
        since = 0 if most is None or (sums["together"] or 0) > most else since + 1
        if not since:
            best, most = state, sums["together"] or 0
        if not sums["cut"] or since == 2 or turn == rounds:
            break
        state = stage(_moved(state, stage(_proposals(state, links, info, turn), "proposals"), room, turn), "labels")
    return best


def assign(docs: DataFrame, links: Column, key: str, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """All columns of ``docs``, with ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``links`` is an array of strings, ``key`` the column that orders documents of a bunch
    among themselves.  Pass narrow rows: ids and numbers, not texts.
    """
    kept = F.array_sort(F.array_distinct(F.filter(F.coalesce(links, F.array().cast("array<string>")), lambda x: x.isNotNull())))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    base = docs.select(row.alias("row"), F.col(f"`{key}`").alias("key"), kept.alias("links"))
    base = stage(base.withColumn("bunch", F.when(F.size("links") == 1, F.element_at("links", 1)).otherwise(F.md5(F.to_json("links")))), "documents")

    total = base.count()
    caps = [total // shards + (s < total % shards) for s in range(shards)]
    bunches = base.where(F.size("links") > 0).groupBy("bunch").agg(F.count(F.lit(1)).alias("n"), F.any_value("links").alias("links"))
    spread = bunches.select("bunch", "n", F.explode("links").alias("link"))
    shared = spread.groupBy("link").agg(F.sum("n").alias("n")).where("n > 1").select("link")
    linked = stage(spread.join(shared, "link"), "links")
    state = propagate(linked.select("bunch", "n").distinct(), linked.select("bunch", "link"), caps, rounds)

    # Where the documents of a bunch go, by their number in it: at most one entry for each shard.
    inside = Window.partitionBy("bunch").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = running_total(state, ["bunch"], F.col("m"), "slot", ["shard"]).withColumn("start", F.coalesce(F.sum("m").over(inside), F.lit(0)))
    places = first.groupBy("bunch").agg(F.sort_array(F.collect_list(F.struct("start", "shard", "slot"))).alias("places"))
    loads = _loads(state, shards)
    # All others fill the shards up: one list for all of them.
    free, at = [], 0
    for s, (c, n) in enumerate(zip(caps, loads)):
        free.append(F.struct(F.lit(at).cast("bigint").alias("start"), F.lit(s).alias("shard"), F.lit(n).cast("bigint").alias("slot")))
        at += c - n
    joined = base.select("row", "key", "bunch").join(places, "bunch", "left")
    joined = joined.select("row", "key", F.xxhash64("row").alias("x"), F.when(F.col("places").isNotNull(), F.concat(F.lit("+"), "bunch")).otherwise("").alias("unit"), "places")
    counted = ordinals(joined, ["key", "x"], "ord", ["unit"])
    nth = F.col("ord") - 1
    # Shards without room begin where the next one does: the last that begins at or before is the one.
    place = F.element_at(F.filter(F.coalesce("places", F.array(*free)), lambda p: p["start"] <= nth), -1)
    placed = counted.select("row", place.alias("place"), nth.alias("nth"))
    return placed.select(*(F.col(f"row.`{c}`") for c in docs.columns), F.col("place.shard").alias(fresh("shard", docs)),
                         (F.col("place.slot") + F.col("nth") - F.col("place.start")).alias(fresh("slot", docs)))
