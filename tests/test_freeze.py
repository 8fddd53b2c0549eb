"""A stopped review holds finished batches only."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from satchel.sources import tree
from satchel.streaming import progressive as G

SCHEMA = "corpus string, path string, is_dir boolean, size bigint, content binary, error string"


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    for k in range(45):
        (root / f"{k:02d}.txt").write_text(str(k))
    return root


def test_a_query_that_ends_in_mid_batch_shows_finished_batches(spark, folder, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = tree.read_stream(spark, str(folder), str(tmp_path / "frontier"), batch_files=10)

    def save(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == 2:
            raise RuntimeError("ended")

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", state).start()
    with pytest.raises(Exception, match="ended"):
        query.processAllAvailable()
    frozen = G.freeze(query, out, state, SCHEMA)
    assert G.committed_batches(spark, state) == [0, 1]
    assert sorted(r.path for r in frozen.collect()) == [f"{k:02d}.txt" for k in range(20)]
    # Going on repeats the unfinished batch, and nothing is lost or twice.
    again = G.start(stream, out, state)
    again.processAllAvailable()
    assert sorted(r.path for r in G.freeze(again, out, state, SCHEMA).collect()) == [f"{k:02d}.txt" for k in range(45)]
    assert frozen.count() == 20


def test_nothing_finished_is_an_empty_table(spark, tmp_path):
    assert G.read_batches(spark, str(tmp_path / "none"), str(tmp_path / "state"), SCHEMA).count() == 0


def test_complete_mode_reads_the_newest(spark, folder, tmp_path):
    stream = tree.read_stream(spark, str(folder), str(tmp_path / "frontier"), batch_files=10)
    counts = stream.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = G.start(counts, out, state, "complete")
    query.processAllAvailable()
    assert [r.n for r in G.freeze(query, out, state, counts.schema, newest=True).collect()] == [45]
