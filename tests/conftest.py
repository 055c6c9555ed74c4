from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from landprice.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = local_session(
        8,
        4,
        spark__checkpoint__dir=str(base / "checkpoints"),
        spark__sql__warehouse__dir=str(base / "warehouse"),
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("LANDPRICE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture
def table(spark, request):
    """A fresh table name in the default database."""
    name = f"sales_{abs(hash(request.node.nodeid)) % 10**9}"
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")
