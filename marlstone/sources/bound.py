"""Parquet tables of any types bound as tables of INT64 and VARCHAR columns."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.types import ColumnDef, Kind


def _bound(field: T.StructField, whole: Collection[str]) -> tuple[Kind, Column] | None:
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Kind.INT64, col.cast("bigint")
    if isinstance(field.dataType, T.StringType):
        return Kind.VARCHAR, col
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return Kind.INT64, (col if field.name in whole else F.round(col * 100)).cast("bigint")
    return None


class BoundTables:
    """The Parquet tables of a folder; columns of other types are left out. Casts are plain, so filters still reach the scan.

    Doubles of the columns named in ``whole`` hold whole numbers; others become hundredths.
    """

    def __init__(self, spark: SparkSession, folder: str, whole: Collection[str] = ()):
        self.spark, self.folder, self.whole, self._read = spark, folder, whole, {}

    def _table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def columns_of(self, table: str) -> list[ColumnDef] | None:
        return [(f.name, found[0]) for f in self._table(table).schema if (found := _bound(f, self.whole))]

    def scan(self, table: str) -> DataFrame:
        df = self._table(table)
        return df.select(*[found[1].alias(f.name) for f in df.schema if (found := _bound(f, self.whole))])
