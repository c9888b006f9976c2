import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sievra.session import local_session, ship_package

    session = local_session("tests", 8, **{"spark.sql.shuffle.partitions": "4"})
    ship_package(session)
    yield session
    session.stop()
