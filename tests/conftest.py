import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ.setdefault("QUERNSTONE_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from quernstone.session import local_session

    session = local_session(4, partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
