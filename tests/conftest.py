import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from convolens.session import build_session

    s = build_session("local[4]", partitions=4, memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


def rows(df):
    """All rows as tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
