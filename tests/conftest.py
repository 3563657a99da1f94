import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from postlens.session import DEFAULT_CONF
    b = SparkSession.builder.master("local[*]").appName("postlens-tests") \
        .config("spark.sql.shuffle.partitions", "8")
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="postlens-test-ckpt-"))
    yield s


def one(spark, col, value, schema="s string"):
    """evaluate a column expression over a one-row frame with column ``s``"""
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]
