import pytest
from pyspark.sql import types as T

EDGE_TEXTS = [
    None, "", "   \n\t ", "one", "a b c d", "the same five words here", "the same five words here",
    "x" * 5000, "Ünï cödé ☃ 日本 text\twith\x0btabs\r\nand lines\n\nand more lines", "\n\n\n", "<|endoftext|> <s> ▁ </s>",
]


def documents(spark, texts, first=0, extra=True):
    """Rows of the documents schema, with extra columns whose names clash
    with those that operators make."""
    rows = [(first + i, t, "en", "s", len(t or ""), i, "k", 1.5) for i, t in enumerate(texts)]
    fields = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
              ("n_chars", T.LongType()), ("n", T.IntegerType()), ("key", T.StringType()), ("chunk", T.DoubleType())]
    df = spark.createDataFrame(rows, T.StructType([T.StructField(n, t) for n, t in fields]))
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="session")
def edge(spark):
    return documents(spark, EDGE_TEXTS)


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def null_rows(spark):
    """Every column NULL, twice, beside one ordinary row."""
    return documents(spark, ["some ordinary words in one line"]).union(
        spark.createDataFrame([(None,) * 8] * 2, documents(spark, []).schema))
