from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tests.run_checks import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from satchel.plans.session import ship_package

    s = session()
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def corpus(spark):
    """Build a corpus of files from ``{path: bytes}``."""

    def build(files: dict[str, bytes], name: str = "root"):
        rows = [(name, p, bytearray(c)) for p, c in files.items()]
        return spark.createDataFrame(rows, "corpus string, path string, content binary").coalesce(1)

    return build
