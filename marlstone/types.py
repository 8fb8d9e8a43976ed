"""Types of the query language, and their Spark counterparts."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class Kind(Enum):
    """INT64 and VARCHAR can be stored; BOOL exists within expressions alone."""

    INT64 = "INT64"
    VARCHAR = "VARCHAR"
    BOOL = "BOOL"


STORED = (Kind.INT64, Kind.VARCHAR)
SPARK = {Kind.INT64: T.LongType(), Kind.VARCHAR: T.StringType(), Kind.BOOL: T.BooleanType()}
INT64_MIN, INT64_MAX = -(2**63), 2**63 - 1

#: A column of a table: its name and kind.
ColumnDef = tuple[str, Kind]


def struct_of(columns: list[ColumnDef]) -> T.StructType:
    return T.StructType([T.StructField(name, SPARK[kind], True) for name, kind in columns])
