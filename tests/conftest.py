import pytest

from lumenspar.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "4g", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
