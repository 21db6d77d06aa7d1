import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "3")
    builder = builder.config("spark.ui.enabled", "false")
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tidemark-tests-"))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture
def log(spark):
    """Arrival log from ``(arrival, event)`` pairs in ms; ids count from 0."""

    def make(pairs, start_id=0):
        rows = [(a, start_id + i, e, f"c{start_id + i}") for i, (a, e) in enumerate(pairs)]
        return spark.createDataFrame(rows, "arrival_ts BIGINT, log_id BIGINT, event_ts BIGINT, content STRING")

    return make
