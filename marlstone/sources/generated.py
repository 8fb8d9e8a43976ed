"""Generated rows: a small table of two integer and two text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sample_rows(spark: SparkSession, n: int = 1000) -> DataFrame:
    """col_int_1 (1 and -1 by turns), col_int_2 (2, 4, 6...), col_vchar_1 and col_vchar_2 (constant)."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 2 == 0, 1).otherwise(-1).cast("bigint").alias("col_int_1"),
        (2 * (i + 1)).cast("bigint").alias("col_int_2"),
        F.lit("Hello").alias("col_vchar_1"),
        F.lit("There").alias("col_vchar_2"),
    )
