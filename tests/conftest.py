import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Values of SQL expressions over rows of strings."""

    def run(expression, rows, columns):
        schema = ", ".join(f"{c} string" for c in columns)
        numbered = [(i, *row) for i, row in enumerate(rows)]
        table = spark.createDataFrame(numbered, f"n int, {schema}")
        return [r[0] for r in table.orderBy("n").selectExpr(f"{expression} AS x").collect()]

    return run
