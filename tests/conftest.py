import pytest

from platenlog.plans.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", "tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
