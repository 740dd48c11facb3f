import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from codeloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def graph(spark):
    """Build (nodes, edges) from names and edge tuples; ids are the places of the names, from 1."""
    def build(names, edges, kinds=None):
        kinds = kinds or {}
        ids = {n: i for i, n in enumerate(names, 1)}
        nodes = spark.createDataFrame(
            [(ids[n], kinds.get(n, "function"), n, f"mod.{n}", "x.py") for n in names],
            "id BIGINT, kind STRING, name STRING, qualified_name STRING, file_path STRING")
        rows = spark.createDataFrame(
            [(ids.get(a, 900), ids.get(b, 901), k) for a, b, k in edges] or [], "source_id BIGINT, target_id BIGINT, kind STRING")
        return nodes, rows
    return build
