import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("row", T.StringType()),
                       T.StructField("score", T.StringType()), T.StructField("shard", T.IntegerType())])


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, langs=None):
        return spark.createDataFrame([(i, t, (langs or {}).get(i), "x", None, 3) for i, t in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def documents():
    import pyarrow.parquet as pq
    return pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pandas()
