import pytest

from docloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session("docloom-tests", cores=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
