import pytest


@pytest.fixture
def table(spark):
    """Rows -> documents-like table with extra columns of clashing names."""

    def make(rows, parts=3, schema="doc_id long, text string"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema)
        return df.repartition(parts).withColumns({c: F.lit("x") for c in ("key", "m", "spans", "n", "row", "id", "piece")})

    return make
