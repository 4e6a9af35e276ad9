import pytest

from filigrane.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
