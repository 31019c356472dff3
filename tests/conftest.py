import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cohortline.session import build_session, ensure_checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", "tests", spark__sql__shuffle__partitions="4", spark__driver__memory="6g", spark__ui__enabled="false"
    )
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session, tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    yield session
    session.stop()


@pytest.fixture(params=["20000", "7"])
def both_forms(spark, request):
    """Run a test with the usual slices and with slices of a few rows."""
    key = "spark.cohortline.slices.rows"
    spark.conf.set(key, request.param)
    yield request.param
    spark.conf.unset(key)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")
