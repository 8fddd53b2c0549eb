"""Very long bodies, scanned region by region on all cores.

A body is cut only where no automatic rule can match across: after a line feed that is followed by
a character other than white space, ``:`` and ``=``, where the text before does not end (white space
aside) with ``:`` or ``=``, and outside of private-key blocks, open ones included.  Every rule stays within a
line but for white space around the operator of an assignment, and key blocks; so the spans of
regions, moved by the lengths of the regions before, are the spans of the whole, and spans that are in
each other's way lie in one region.

A text without such a place is one region.  User patterns may look at anything, so bodies are
scanned whole for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from satchel.operators import sensitive as V
from satchel.plans.settings import RunSettings

#: Bodies of more characters are cut into regions of about this many.
LONG_CHARS, REGION_CHARS = 4 << 20, 256 << 10

_BEGIN = re.compile(r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----")
_END = re.compile(r"-----END (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----")
_CUT = re.compile(r"\n(?=[^\s:=])", re.A)
# What a rule's \s matches.
_BLANK = " \t\n\x0b\x0c\r"


def key_blocks(text: str) -> list[tuple[int, int]]:
    """Private-key blocks from their first line to the end of their last; to the end of the text if that is missing."""
    found, at = [], 0
    while begin := _BEGIN.search(text, at):
        end = _END.search(text, begin.end())
        found.append((begin.start(), end.end() if end else len(text)))
        if not end:
            break
        at = end.end()
    return found


def _operator_before(text: str, at: int) -> bool:
    """The last character before ``at`` that is not white space belongs to an assignment."""
    while at > 0 and text[at - 1] in _BLANK:
        at -= 1
    return at > 0 and text[at - 1] in ":="


def cuts(text: str, region: int = REGION_CHARS) -> list[int]:
    """Where regions begin, 0 first: the first safe place after each ``region`` characters."""
    found, blocks, k, at = [0], key_blocks(text), 0, 0
    while at + region < len(text):
        at += region
        for m in _CUT.finditer(text, at - 1):
            place = m.end()
            while k < len(blocks) and blocks[k][1] <= place:
                k += 1
            if k < len(blocks) and blocks[k][0] < place < blocks[k][1]:
                continue
            if not _operator_before(text, place):
                break
        else:
            return found
        found.append(place)
        at = place
    return found


def _regions(region: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                places = [*cuts(text, region), len(text)]
                for k, (start, end) in enumerate(zip(places, places[1:])):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key], pa.string()), pa.array([k], pa.int32()), pa.array([start], pa.int32()), pa.array([text[start:end]], pa.string())],
                        names=["key", "region", "offset", "text"])

    return cut


def regions(texts: DataFrame, region: int = REGION_CHARS) -> DataFrame:
    """``key, region, offset, text`` for ``texts(key, text)``, dealt out to all tasks."""
    found = texts.mapInArrow(_regions(region), "key string, region int, offset int, text string")
    return found.repartition(4 * texts.sparkSession.sparkContext.defaultParallelism, "key", "region")


def scan(files: DataFrame, settings: RunSettings = RunSettings(), text: str = "content", long: int = LONG_CHARS, region: int = REGION_CHARS) -> DataFrame:
    """``sensitive.scan`` with the bodies of more than ``long`` characters cut into regions.

    ``files`` is read twice and has to be a table, not a computation.
    """
    if settings.scan_mode == "Off" or settings.hide_patterns:
        return V.scan(files, settings, text)
    lengthy = F.coalesce(F.length(text) > long, F.lit(False))
    short = V.scan(files.where(~lengthy), settings, text)
    # Equal texts have equal spans.
    keyed = files.where(lengthy).withColumn("__key", F.sha2(text, 256))
    parts = regions(keyed.select(F.col("__key").alias("key"), F.col(text).alias("text")).dropDuplicates(["key"]), region)
    spans = V.scan(parts, replace(settings), "text")
    moved = F.transform("findings", lambda s: s.withField("start", s["start"] + F.col("offset")))
    # Regions without findings are no rows.
    told = spans.select("key", "region", moved.alias("f")).withColumn("f", F.explode_outer(F.array("f"))).where(F.size("f") > 0)
    whole = told.groupBy(F.col("key").alias("__key")).agg(F.sort_array(F.collect_list(F.struct("region", "f"))).alias("parts"))
    whole = whole.select("__key", F.flatten(F.transform("parts", lambda p: p["f"])).alias("findings"))
    found = keyed.join(whole, "__key", "left").drop("__key")
    empty = F.array().cast(short.schema["findings"].dataType)
    return short.unionByName(found.withColumn("findings", F.coalesce("findings", empty)))
