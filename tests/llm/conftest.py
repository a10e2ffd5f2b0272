import pytest

#: Odd rows that every operator has to take: nulls, empty and blank texts, repeated rows, a long text, clashing extra columns.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 63),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, "  \n \t", "fr", "b", 5),
    (5, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 63),
    (5, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 63),
    (None, "a row without an id password=abcdef123456789 in it", "en", "a", 50),
    (7, "word " * 20000, "en", "a", 100000),
    (8, "ünïcödé ﬁ ½ 你好 🙂 \u0085 x", "de", "c", 20),
    (9, "one", "en", "a", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with the odd rows and extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA)
    return df.withColumn("score", F.lit("clash")).withColumn("spans", F.lit(1)).withColumn("chunk", F.lit("x")).withColumn("leaks", F.lit(0)).withColumn("ids", F.lit(0)).withColumn("bucket", F.lit(0)).withColumn("key", F.lit(0))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
