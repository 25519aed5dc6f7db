import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF = os.environ.get("PARLEY_TEST_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from parley.session import local_session
    s = local_session(cores="*", shuffle_partitions=8, app="parley-tests")
    yield s


@pytest.fixture(scope="session")
def sf_dir():
    return SF
