import datetime as dt
import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SUNDAY = dt.date(2020, 1, 5)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")
        .config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture
def weekly(spark):
    """weekly({"a": [1, 2, ...]}, start=...) -> demand table with names item_id, date, demand."""

    def make(series, start=SUNDAY, extra=None):
        rows = [(k, start + dt.timedelta(weeks=i), float(v), *(extra[k] if extra else ())) for k, vs in series.items() for i, v in enumerate(vs)]
        more = "".join(f", g{i} string" for i in range(len(next(iter(extra.values()))) if extra else 0))
        return spark.createDataFrame(rows, f"item_id string, date date, demand double{more}")

    return make
