import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from rows (doc_id, text), with columns of other kinds around them."""

    def make(rows):
        base = spark.createDataFrame(rows, "doc_id long, text string")
        return base.select(
            F.lit("x").alias("score"), "doc_id", F.lit("en").alias("lang"), "text", F.array(F.lit(1)).alias("n_words"),
            F.struct(F.lit(1).alias("a")).alias("key"), F.lit(0.5).alias("block"),
        )

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Texts that any operator must take: null, empty, blanks, one word, other scripts, long, repeated."""
    return [
        None, "", " \t\n", "word", "日本語 テスト 文 一 二 三", "é à ñ", "a" * 20000, "ab cd " * 4000,
        "same words in this row of some length to be seen twice or so by all of them here",
        "same words in this row of some length to be seen twice or so by all of them here",
    ]
