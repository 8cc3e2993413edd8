import pytest

from platewise.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.driver.bindAddress": "127.0.0.1",
            "spark.driver.host": "127.0.0.1",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
