import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pagewright.session import local_session, reach

    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    reach(session)
    yield session
    session.stop()
