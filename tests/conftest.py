import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + ":" + os.environ.get("PYTHONPATH", "")
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", f"{root}/warehouse").config("spark.local.dir", f"{root}/local")
        .config("spark.driver.memory", "6g").getOrCreate()
    )
    s.sparkContext.setCheckpointDir(f"{root}/checkpoint")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
