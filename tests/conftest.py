import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))


@pytest.fixture(scope="session")
def spark():
    from textscreen.session import build_session

    session = build_session("tests", 8, 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
