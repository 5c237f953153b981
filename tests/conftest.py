import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dealflux.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", shuffle=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from dealflux.sources.adapters import Tables

    return Tables(spark, DATA)


@pytest.fixture
def make(spark):
    """DataFrame from rows and a schema text."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
