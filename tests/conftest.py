import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from souk.session import get_session

    s = get_session("local[4]", partitions=8, app="souk-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from souk.sources.seed import seed_tables

    return seed_tables(spark)


@pytest.fixture(scope="session")
def fx(spark):
    from souk.sources.fixtures import Fixture

    return Fixture(spark, SF_SMALL)
