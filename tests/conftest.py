import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))
sys.path.insert(0, HERE)


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import get_spark

    s = get_spark("local[4]", app="tidemark-tests", partitions=8)
    yield s
    s.stop()
