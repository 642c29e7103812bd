import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use inside or return.
    *[T.StructField(name, T.StringType()) for name in ("size", "label", "fp", "host", "kept", "key", "copies", "p", "ids",
                                                       "text_key", "n", "words", "spans", "block", "part", "held_out")]])


def words(count, seed):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(count))


@pytest.fixture(scope="session")
def odd_rows():
    """Missing values in every column, empty and long texts, ties and repeated rows."""
    body = words(120, 1)
    texts = [
        (1, body, "en", "a"), (2, body, "en", "a"), (3, body.replace(" ", "\t\n "), "fr", "b"), (4, None, "en", "b"),
        (5, "", "en", "b"), (6, " \t\n\x0b\x0c\r", None, "c"), (7, words(60000, 2), "en", "a"), (8, body + " more", "en", None),
        (None, body, "en", "a"), (None, words(80, 3), None, None), (9, words(90, 4), "de", "é"), (9, words(90, 4), "de", "é"),
        (10, "one two three", "es", "b"), (11, "one two three\none two three\none two three four", "es", "b"),
        (12, "Ünï çödé     \U0001F600 text\x1f\x1c here  twice  " + words(55, 5), "fr", "\U0001F600"),
        (13, "don't  stop \n\n\n  now <|endoftext|> we'll see" + "  " * 9, "en", "￿"), (9, words(70, 6), "de", "é")]
    return [(*row, None if row[1] is None else len(row[1]), *[f"x{i}"] * 16) for i, row in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def all_missing(spark):
    return spark.createDataFrame([(None,) * len(SCHEMA)] * 3, SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def rows(documents):
    return [(r.doc_id, r.text, r.lang, r.source) for r in documents.collect()]
