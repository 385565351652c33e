import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codepairs.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("codepairs-tests", "local[4]", 2)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named values."""

    def value(expr, schema, *row):
        return spark.createDataFrame([row], schema).select(expr.alias("x")).first()["x"]

    return value


@pytest.fixture
def partitions(spark):
    """Runs a function under several numbers of shuffle partitions."""

    def run(fn, counts=(1, 7)):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        try:
            results = []
            for n in counts:
                spark.conf.set("spark.sql.shuffle.partitions", str(n))
                results.append(fn())
            return results
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    return run
