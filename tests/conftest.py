import pytest

from stratamill.session import local_session


@pytest.fixture(scope="session")
def spark():
    spark = local_session(4, 4, "tests")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
