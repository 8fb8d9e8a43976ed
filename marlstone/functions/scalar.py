"""The scalar functions: case is that of ASCII letters, and lengths are in bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SCALAR: dict[str, Callable[..., Column]] = {
    "UPPER": lambda a: F.translate(a, UPPER.lower(), UPPER),
    "LOWER": lambda a: F.translate(a, UPPER, UPPER.lower()),
    "STRLEN": lambda a: F.octet_length(a).cast("bigint"),
    "CONCAT": lambda a, b: F.concat(a, b),
}
