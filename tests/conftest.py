import pytest

from tidegate.session import get_spark

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
