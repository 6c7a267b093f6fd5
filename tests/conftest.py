import pytest

from driftgate.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("driftgate-tests", cores=8, partitions=8)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
