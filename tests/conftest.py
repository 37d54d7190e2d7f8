import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from folioscope.session import session

    return session(4, "3g", spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def small() -> str:
    return SMALL
