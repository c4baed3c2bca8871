import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from run_checks import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session(int(os.environ.get("TEST_CPUS", 4)))
    yield spark
    spark.stop()
