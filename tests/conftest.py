import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from webplan.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate one Column and return the Python value."""

    def run(column):
        return spark.range(1).select(column.alias("v")).collect()[0]["v"]

    return run
