import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leafwork.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "leafwork-tests", "local[4]", spark_sql_shuffle_partitions="4", spark_driver_memory="6g"
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate one column expression over a list of inputs."""

    def evaluate(build, inputs, ddl="STRING"):
        from pyspark.sql import functions as F

        rows = [(i, value) for i, value in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"i INT, v {ddl}")
        found = df.select("i", build(F.col("v")).alias("x")).collect()
        return [row["x"] for row in sorted(found, key=lambda r: r["i"])]

    return evaluate
