import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])
# rows every operator must take: null and empty texts, white space only, repeated
# rows, ties, a null id, a long text, bytes of all kinds
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one two three"), (4, "one two three"), (5, "one two three"),
       (None, "no id here"), (6, "word " * 30_000), (7, "Ünïcödé 文字 \x00 \U0001F600 á"), (8, "a")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in ODD], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
