import pytest

from quillstone.session import get_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session(8, 4)
    yield session
    session.stop()
