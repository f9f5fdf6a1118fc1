import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tablemill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TABLEMILL_TEST_CPUS", "8"), "tests")
    yield session
    session.stop()


@pytest.fixture()
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)
