from __future__ import annotations

import pytest

from faultline.session import session

# started before collection: column expressions in test tables need a running session
SPARK = session("local[8]", 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
SPARK.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SPARK


@pytest.fixture
def values(spark):
    """Evaluates a column expression over a list of values."""
    def run(items, expression, dtype="string"):
        df = spark.createDataFrame(list(enumerate(items)), f"i int, x {dtype}")
        return [r.v for r in df.select("i", expression.alias("v")).orderBy("i").collect()]
    return run
