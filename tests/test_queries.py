from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.run_checks import compare, connect

SF = "/root/testdata/sf0.001"
# Every query is checked at sf0.01 by tests/run_checks.py; these few guard the wiring.
NAMES = ["contribution_rollup", "sensitive_findings", "size_budget", "pruned_tree", "snapshot_changes", "structure_tree",
         "stream_findings", "layout_classic", "review_sample"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_check_sql(spark, name):
    assert compare(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF).startswith("ok")


def test_every_check_has_a_query_and_entry_runs(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
