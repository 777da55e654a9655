import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from panelwise.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_spark("local[4]", app="tests", shuffle_partitions=4)
