"""Small tables that every operator must survive, with columns whose names clash with inner ones."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("run", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("hit", T.StringType()),
        T.StructField("_id", T.StringType()),
        T.StructField("part", T.StringType()),
        T.StructField("length", T.StringType()),
    ]
)


def table(spark, rows):
    """A documents table of (doc_id, text) rows with clashing extra columns."""
    wide = [(i, t, "r", None, 7, None, "x", "p", "l") for i, t in rows]
    return spark.createDataFrame(wide, SCHEMA)


LONG = " ".join(f"word{i % 997} and{i % 31}" for i in range(60_000))

ODD = [
    (1, "the same text"),
    (2, "the  same\n\ttext"),
    (2, "the  same\n\ttext"),
    (3, None),
    (4, ""),
    (None, "the same text"),
    (None, None),
    (5, "The same text"),
    (6, " "),
    (7, LONG),
    (8, LONG),
    (9, "ünïcödé 東京 \U0001f600 <|endoftext|> x y"),
]
