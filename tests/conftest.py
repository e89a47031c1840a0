import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from morphoquarry.session import build_session, ship

    session = build_session("tests", cores=4, memory="4g")
    ship(session)
    yield session
    session.stop()
