from __future__ import annotations

import os
import sys
import tempfile
from datetime import date, datetime

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    ckpt = tempfile.mkdtemp(prefix="ledgerlens-test-ckpt-")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("ledgerlens-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", ckpt)
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)


def d(s: str) -> date:
    return date.fromisoformat(s)


SF_SMALL = "/root/testdata/sf0.001"
