import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lumenflow.session import local_session, ship_package  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return ship_package(local_session(cores=4, partitions=4, name="tests"))


@pytest.fixture(scope="session")
def data():
    return DATA
