"""Several writes into one folder of archives."""

from __future__ import annotations

import threading
from pathlib import Path

import pytest

from satchel.llm import warc


def records(spark, ids):
    return warc.page_records(spark.createDataFrame([(i, f"u{i}", f"page {i}") for i in ids], "page_id bigint, url string, html string"))


def pages(spark, folder):
    return sorted(r.page_id for r in warc.read_pages(spark.read.format("warc").load(folder)).collect())


@pytest.fixture
def folder(spark, tmp_path):
    spark.dataSource.register(warc.WarcSource)
    return str(tmp_path / "w")


def test_appending_keeps_what_was_there(spark, folder):
    for ids in ([1, 2], [3, 4], [], [5]):
        records(spark, ids).write.format("warc").mode("append").save(folder)
    assert pages(spark, folder) == [1, 2, 3, 4, 5]


def test_overwriting_replaces(spark, folder):
    records(spark, range(40)).repartition(4).write.format("warc").mode("append").save(folder)
    records(spark, [7]).coalesce(1).write.format("warc").mode("overwrite").save(folder)
    assert pages(spark, folder) == [7] and len(list(Path(folder).glob("*.warc.gz"))) == 1


def test_two_writers_at_once(spark, folder):
    jobs = [threading.Thread(target=lambda k=k: records(spark, range(10 * k, 10 * k + 10)).repartition(3).write.format("warc").mode("append").save(folder)) for k in range(3)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert pages(spark, folder) == list(range(30))


def test_archives_of_others_are_read_and_kept(spark, folder):
    records(spark, [1]).write.format("warc").mode("append").save(folder)
    row = {"record_id": "urn:page:9", "record_type": "response", "uri": "u", "payload": b"x", "payload_bytes": 1, "payload_digest": None, "refers_to": None}
    Path(folder, "crawl-00.warc.gz").write_bytes(warc.member(row))
    assert pages(spark, folder) == [1, 9]
    with pytest.raises(Exception, match="archives of others"):
        records(spark, [2]).write.format("warc").mode("overwrite").save(folder)
    records(spark, [2]).write.format("warc").mode("append").save(folder)
    assert pages(spark, folder) == [1, 2, 9]


def test_an_unfinished_write_is_not_read(spark, folder):
    records(spark, [1]).write.format("warc").mode("append").save(folder)
    dead = warc.WarcWriter(folder, False)
    name = dead.own.name(0, 0, 0, ".warc.gz")
    Path(folder, name).write_bytes(next(Path(folder).glob("*.warc.gz")).read_bytes())
    records(spark, [2]).write.format("warc").mode("append").save(folder)
    assert pages(spark, folder) == [1, 2] and Path(folder, name).exists()
