import os
import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    top = tempfile.mkdtemp(prefix="tests-")
    conf = {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": f"file://{top}/shared", "spark.sql.warehouse.dir": f"{top}/warehouse", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    found = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
