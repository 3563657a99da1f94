import pytest
from pyspark.sql import functions as F

CLASH = ["n", "th", "size", "score", "a", "row", "w", "label", "target", "bucket", "comp", "copies", "_text", "trusted"]


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from texts, with extra columns whose names operators use themselves."""
    def make(texts, ids=None, sources=None, clash=True):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, (sources or ["s"] * len(texts))[k]) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        df = df.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
        return df.withColumns({c: F.lit(f"extra {c}") for c in CLASH}) if clash else df
    return make


@pytest.fixture(scope="session")
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    return make


def prose(seed, n, vocabulary=3000):
    import random
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
