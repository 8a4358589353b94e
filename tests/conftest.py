import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from provenant.session import HOT_ROWS_CONF, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "provenant-tests", **{"spark.sql.shuffle.partitions": "4"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def split_keys(spark):
    """Make every key of more than four rows a hot one."""
    spark.conf.set(HOT_ROWS_CONF, "4")
    yield
    spark.conf.unset(HOT_ROWS_CONF)
