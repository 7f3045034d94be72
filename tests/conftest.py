import pytest

from tessera.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    ship(session)
    yield session
    session.stop()
