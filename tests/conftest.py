import pytest

from filigree.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session(
        "tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{folder}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
