import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from kestrel.session import build_session
    s = build_session("local[4]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def duck001():
    from oracle import duck
    return duck(SF001)


@pytest.fixture(scope="session")
def entry():
    import __spark_entry__ as E
    return E
