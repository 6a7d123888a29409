import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from textlode.plans.session import get_session

    session = get_session(
        "tests",
        "local[*]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Value of a column expression over one text."""
    from pyspark.sql import functions as F

    def evaluate(expression, text):
        frame = spark.createDataFrame([(text,)], "text string")
        return frame.select(expression(F.col("text")).alias("v")).head()["v"]

    return evaluate


@pytest.fixture(scope="session")
def corpus(spark):
    def make(texts):
        rows = list(texts.items()) if isinstance(texts, dict) else list(enumerate(texts))
        key = "string" if rows and isinstance(rows[0][0], str) else "long"
        return spark.createDataFrame(rows, f"doc_id {key}, text string")

    return make


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
