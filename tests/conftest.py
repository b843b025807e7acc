import pytest

from recordloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "recordloom-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
