import pytest

from tests.session import make_session


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()
