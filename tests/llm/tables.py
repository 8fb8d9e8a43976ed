"""A small table of documents with everything that is odd."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators give to columns of their own.
        *[T.StructField(c, T.StringType()) for c in ("kept", "size", "content", "digest", "__row", "__gone", "a.b", "held_out", "f0", "slot", "plain")],
    ]
)
EXTRA = ("k", "s", "c", "d", "r", "g", "x", "h", "f", "t", "p")
LONG = " ".join(f"word{i % 997} and{i % 31}" for i in range(60_000))


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


def odd_rows():
    return [
        row(1, "one two three four five six seven eight nine ten eleven"),
        row(2, "one  two\tthree four five six seven eight nine ten eleven"),
        row(3, None),
        row(4, ""),
        row(5, "  \n\t "),
        row(None, "one two three four five six seven eight nine ten eleven"),
        row(7, "x", None, None),
        row(8, LONG, "en", "b"),
        row(9, LONG, None, "b"),
        row(10, "Ünïcödé „quotes“ 漢字 😀 don't 123", "de", "c"),
        row(10, "Ünïcödé „quotes“ 漢字 😀 don't 123", "de", "c"),
        row(11, "#$%& |||| <<>> ****", "en", None),
        row(None, None, None, None),
        row(12, "no" * 40_000, "en", "b"),
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
