import pytest

from tests.compare import duck, session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session(8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def con():
    return duck(SF)
