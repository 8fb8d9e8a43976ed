"""Column statistics: the mean of integer columns, and how often each byte occurs in text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean(column: str | Column) -> Column:
    """The mean as a double; 0.0 for no rows."""
    return F.coalesce(F.avg(column), F.lit(0.0))


def byte_histogram(df: DataFrame, column: str) -> DataFrame:
    """byte (0 to 255) and how often it occurs in the UTF-8 of the column; bytes that never occur are left out.

    Partial aggregation leaves at most 256 rows of each task to be shuffled.
    """
    hexed = F.hex(F.encode(F.col(column), "UTF-8"))
    pairs = F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1))
    each = df.select(F.explode(pairs).alias("pair"))
    counted = each.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.conv("pair", 16, 10).cast("int").alias("byte"), "n")


def describe(df: DataFrame) -> dict[str, float | dict[str, int]]:
    """By column: the mean of an integer column, or the byte counts of a text column (at most 256)."""
    kinds = dict(df.dtypes)
    numbers = [c for c, t in kinds.items() if t == "bigint"]
    out: dict[str, float | dict[str, int]] = {}
    if numbers:
        out |= df.agg(*[mean(F.col(f"`{c}`")).alias(c) for c in numbers]).first().asDict()
    for c, t in kinds.items():
        if t == "string":
            out[c] = {chr(r["byte"]): r["n"] for r in byte_histogram(df, c).collect()}
    return {c: out[c] for c in kinds if c in out}
