import sys
from pathlib import Path

import pytest

here = Path(__file__).resolve().parent
sys.path[:0] = [str(here), str(here.parent)]


@pytest.fixture(scope="session")
def spark():
    from quire.session import local_session

    session = local_session(4, 4)
    session.sparkContext.setLogLevel("ERROR")
    return session
