import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns whose names clash."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(20000))
    rows = [
        (1, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 1),
        (2, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 2),
        (2, "One two three four five six seven eight nine ten eleven twelve.", "en", "a", 2),
        (3, None, "en", "b", None),
        (4, "", None, "b", 0),
        (5, long, "de", None, 5),
        (6, "one TWO three, four five six seven eight nine ten", "de", None, 6),
        (7, "!!! 123\n\n\t 　é", None, "c", 7),
        (None, "no id here", "en", "c", 8),
        (8, "x\x00y \U0001f600 zß", "en", "c", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("key", "size", "h", "c", "d", "t", "bag", "part", "source_size", "host", "n", "label", "c0", "_id", "slot", "items", "spans"):
        import pyspark.sql.functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest table of documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
