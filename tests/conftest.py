import datetime as dt

import pytest
from pyspark.sql import SparkSession

from gavel.operators.ordered import HOT_ROWS_CONF
from gavel.operators.throttle import FOLD_ROWS_CONF
from gavel.session import prepare

EPOCH = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(ms: int) -> dt.datetime:
    """Instant ``ms`` milliseconds after the tests' epoch."""
    return EPOCH + dt.timedelta(milliseconds=int(ms))


def millis(ts: dt.datetime) -> int:
    if ts.tzinfo is None:
        ts = ts.replace(tzinfo=dt.timezone.utc)
    return (ts - EPOCH) // dt.timedelta(milliseconds=1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os
    import time

    os.environ["TZ"] = "UTC"
    time.tzset()
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
               .config("spark.ui.enabled", "false")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
               .getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield prepare(session)
    session.stop()


@pytest.fixture(params=["whole", "cut"])
def hot(request, spark):
    """Run a test with histories left whole and with hot keys cut into pieces."""
    if request.param == "cut":
        spark.conf.set(HOT_ROWS_CONF, "15")
    yield request.param
    spark.conf.unset(HOT_ROWS_CONF)


@pytest.fixture(params=["fold", "jump"])
def throttle_path(request, spark):
    """Run a test with small keys folded and with every key treated as large."""
    if request.param == "jump":
        spark.conf.set(FOLD_ROWS_CONF, "3")
    yield request.param
    spark.conf.unset(FOLD_ROWS_CONF)
