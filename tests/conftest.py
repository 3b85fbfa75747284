import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = os.environ.get("WIRECORPUS_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from wirecorpus.session import local_session

    session = local_session("tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip(f"no test data at {DATA}")
    return DATA
