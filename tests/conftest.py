from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from voxtally.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="voxtally-tests-")
    session = local_session("8", shuffle_partitions=8, app_name="tests", checkpoint_dir=folder)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column expression on one value (or on named values)."""
    from pyspark.sql import functions as F

    def evaluate(expression, *texts, name="t"):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, {name} string")
        rows = df.select("i", expression(F.col(name)).alias("v")).orderBy("i").collect()
        out = [r.v for r in rows]
        return out[0] if len(out) == 1 else out

    return evaluate
