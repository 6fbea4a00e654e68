"""Edge-case tables shared by the tests of the training-data operators."""

from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that the operators use inside; a table may have them too.
CLASHING = ("_row", "_size", "_turn", "_score", "_gone", "_doc", "key", "rep", "s", "ids", "decoded", "score", "size", "rate")

SENTENCE = "the quick brown fox jumps over the lazy dog while seven other animals look on from behind the old garden wall"


def edge_rows():
    """NULLs in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
    return [
        (1, SENTENCE, "en", "a", 5),
        (2, SENTENCE, "en", "b", 5),
        (2, SENTENCE, "en", "b", 5),
        (3, None, "en", "a", None),
        (4, "", "en", None, 0),
        (5, " \t\n\r\x0b\x0c ", None, "b", 7),
        (None, "a text without an id, but with some words in it", "en", "c", 1),
        (None, None, None, None, None),
        (6, long, "en", "a", len(long)),
        (7, "zwei Wörter", "de", None, 11),
        (8, "12345 !!! 67890", "de", "c", 15),
        (9, "漢字 𝕏 é   ▁   x", "de", "c", 9),
        (8, "another text under a repeated id", "de", "c", 32),
    ]


def rows_of(df):
    return [tuple(r) for r in df.collect()]
