import pytest

from dockflow.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[8]", 8, memory="6g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
