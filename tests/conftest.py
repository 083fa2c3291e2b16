import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("scour-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make(spark):
    """A table from rows, with the row number in front as `row_id`."""

    def build(schema: str, rows):
        rows = [row if isinstance(row, tuple) else (row,) for row in rows]
        numbered = [(i, *row) for i, row in enumerate(rows)]
        return spark.createDataFrame(numbered, f"row_id bigint, {schema}").coalesce(2)

    return build


def column(df, name, order="row_id"):
    return [row[name] for row in df.orderBy(order).select(name).collect()]


def rows(df, *names):
    return sorted(
        (tuple(row) for row in df.select(*(names or df.columns)).collect()), key=repr
    )
