import pytest

from tests.oracle import session


@pytest.fixture(scope="session")
def spark():
    spark = session()
    yield spark
    spark.stop()
