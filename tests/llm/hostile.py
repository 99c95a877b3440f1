"""A small table of awkward documents that every operator must take."""

from pyspark.sql import Row
from pyspark.sql import types as T

LONG = "Lorem ipsum dolor sit amet " * 3000 + "\n" + "x" * 5000
PASSAGE = " ".join(f"word{i}" for i in range(120))

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in ("_id", "_hash", "row", "fp", "seed", "_score", "score", "found", "kept", "spans", "text_hash", "id", "hash")],
])


def hostile(spark, rows=None):
    texts = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a"),   # repeated row
        (2, "the quick brown fox jumps over the lazy dog again and again", "en", "b"),   # tie with 1
        (3, None, "en", "a"), (4, "", "fr", None), (5, " \t\n ", None, "b"), (6, LONG, "en", "a"), (7, LONG, "en", "c"),
        (None, "no id here but some words to read", "en", "a"), (None, None, None, None),
        (8, PASSAGE + "\nand a tail of its own", "en", "b"), (9, "a head of its own\n" + PASSAGE, "en", "b"),
        (10, "été naïve façade œuvre \U0001f600 ñandú", "fr", "c"), (11, "12345 67890 ---", "en", "c"), (2, "same id, another text", "en", "b"),
    ] if rows is None else rows
    extra = ("x",) * (len(SCHEMA) - 5)
    return spark.createDataFrame([Row(*(t[0], t[1], t[2], t[3], None if t[1] is None else len(t[1]), *extra)) for t in texts], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
