import os

import pytest

from burstline.session import local_session

DATA = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "4g", **{"spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def folder():
    if not os.path.isdir(DATA):
        pytest.skip("no test data here")
    return DATA
