import pytest


@pytest.fixture
def table(spark):
    """A small table from rows and a schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
