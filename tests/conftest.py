import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    wh = tempfile.mkdtemp(prefix="tw-warehouse-")
    s = (SparkSession.builder.master("local[4]").appName("tablewright-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.warehouse.dir", wh)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from tablewright.session import scratch_dir
    scratch_dir(s)  # registers a checkpoint dir only when the session has none
    yield s


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="tw-test-")
