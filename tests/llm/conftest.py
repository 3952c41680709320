import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType()), T.StructField("bin", T.IntegerType()), T.StructField("block", T.StringType())])


@pytest.fixture()
def docs_of(spark):
    """Documents with extra columns whose names clash with those that operators use inside."""

    def make(rows, parts=3):
        return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(parts)

    return make


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
