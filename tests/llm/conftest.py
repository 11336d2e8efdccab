import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("_row", T.LongType()), T.StructField("size", T.StringType())])


@pytest.fixture()
def docs(spark):
    """A frame of documents from (doc_id, text, lang, source); two columns more have names that operators use inside."""
    return lambda rows, parts=3: spark.createDataFrame([(i, t, l, s, len(t or ""), 5, "x") for i, t, l, s in rows], SCHEMA).repartition(parts)


@pytest.fixture()
def odd(docs):
    """Nulls in every column, an empty, a blank and a long text, equal texts and a repeated row."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(9000))
    return docs([(1, "a b  c", "en", "s1"), (2, "a b c", "en", "s1"), (3, None, None, None), (4, "", "de", "s2"), (5, " \n", "fr", None), (6, long, "en", "s1"), (7, long + " end", "en", "s3"), (8, "a\tb c", None, "s2"), (None, "a b c", "en", "s1"), (9, "same row", "en", "s4"), (9, "same row", "en", "s4"), (10, "éü ß 中文 ok", "de", "S1")])
