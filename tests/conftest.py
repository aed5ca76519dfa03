import pytest

from quipwright.session import get_session


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", cores=4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
