import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shapelog.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(cores=8, shuffle_partitions=4, app_name="tests")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Make a line table from a list of texts."""
    from shapelog.sources.logs import lines_of

    def make(texts, source="log"):
        rows = list(enumerate(texts))
        return lines_of(spark.createDataFrame(rows, "n bigint, line string"), source, "n", "line")

    return make
