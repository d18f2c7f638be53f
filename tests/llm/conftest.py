import pytest
from oddities import CLASH, odd_rows


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASH)).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
