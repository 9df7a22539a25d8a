import pytest

from tessella.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, memory="4g")
    ship(session)
    yield session
