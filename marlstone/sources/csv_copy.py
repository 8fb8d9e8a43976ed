"""Bulk loads of CSV files into a table's columns.

Fields are read as text with a column for records that don't fit, all of which is read, so no pruning hides a
bad record; then lengths are checked and integers parsed, and one bad field fails the load.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.plans.compile import _fail, _fail_with, wrapping_integers
from marlstone.problems import Errors, Problem, ProblemsError
from marlstone.types import ColumnDef, Kind

BAD = "__bad_record"
#: Digits of an integer in bases other than ten, by prefix.
RADIX = {"0x": (16, "[0-9a-fA-F]"), "0o": (8, "[0-7]"), "0b": (2, "[01]")}


def mapping(columns: Sequence[ColumnDef], destinations: Sequence[str] | None, scatter: bool = False) -> list[int]:
    """For each column of the table the number of the CSV field that fills it.

    ``destinations`` names a column for each field. Column i takes the field whose number is the place of
    destinations[i] in the table; ``scatter`` is the inverse: field i goes to column destinations[i].
    """
    names = [n for n, _ in columns]
    if destinations is None:
        return list(range(len(names)))
    error = Errors.DESTINATION_COLUMN
    if len(destinations) != len(names):
        raise ProblemsError(Problem(error, f"{len(destinations)} for {len(names)} columns"))
    if twice := next((n for i, n in enumerate(destinations) if n in destinations[:i]), None):
        raise ProblemsError(Problem(error, f"{twice} is given twice"))
    if unknown := next((n for n in destinations if n not in names), None):
        raise ProblemsError(Problem(error, f"{unknown} is not a column"))
    places = [names.index(n) for n in destinations]
    return [places.index(i) for i in range(len(names))] if scatter else places


def parse_int64(value: Column) -> Column:
    """The integer of a text: decimal, or 0x, 0o, 0b or 0u and digits, with underscores between digits; else the query fails."""
    plain = F.regexp_replace(value, "(?<=[0-9a-fA-F])_+", "")
    sign = F.when(plain.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
    digits = F.regexp_replace(plain, "^[-+]", "")
    decimal = F.when(plain.rlike("^[-+]?(0[uU])?[0-9]+$"), F.regexp_replace(plain, "0[uU]", "").try_cast("bigint"))
    out = decimal
    for prefix, (base, one) in RADIX.items():
        fits = F.lower(digits).startswith(prefix) & digits.rlike(f"^..{one}+$")
        body = F.regexp_replace(F.substring(digits, F.lit(3), F.length(digits)), "^0+(?=.)", "")
        number = F.conv(body, base, 10).try_cast("decimal(20,0)")
        # Digits of 64 bits are taken as they are, so the upper half stands for negative numbers.
        wrapped = F.when(number >= F.lit(Decimal(2**63)), number - F.lit(Decimal(2**64))).otherwise(number).cast("bigint")
        most = {16: 16, 8: 22, 2: 64}[base]
        out = F.coalesce(out, F.when(fits & (F.length(body) <= most), sign * wrapped))
    told = F.concat(F.lit(f'{{"error": "{Errors.INT64}", "context": '), F.to_json(F.array(value)), F.lit("}"))
    # to_json quotes the text; its brackets go.
    told = F.regexp_replace(F.regexp_replace(told, '"context": \\[', '"context": '), "\\]\\}$", "}")
    return F.coalesce(out, _fail(told).cast("bigint"))


def read_rows(spark: SparkSession, path: str, columns: Sequence[ColumnDef], has_header: bool = False, destinations: Sequence[str] | None = None, scatter: bool = False, multi_line: bool = True) -> DataFrame:
    """The file's records as rows of the table's columns.

    Without destinations a record must have as many fields as the table has columns; with them it may have
    more. Blanks around bare fields go, quoted ones stay; an empty field is an empty text. Quoted fields may have
    line breaks, for which one task reads the whole file; without ``multi_line`` they may not, and a large file is
    split among tasks.
    """
    places = mapping(columns, destinations, scatter)
    width = len(columns)
    schema = T.StructType([T.StructField(f"f{i}", T.StringType()) for i in range(width)] + [T.StructField(BAD, T.StringType())])
    raw = spark.read.schema(schema).options(
        mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, multiLine=multi_line, escape='"', header=has_header, enforceSchema=True,
        ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, encoding="UTF-8",
    ).csv(path)
    with wrapping_integers(spark):
        # A record of another length is kept in BAD as it stands; its fields are those between commas outside quotes.
        bad = F.col(BAD).isNotNull()
        if destinations is not None:
            bare = F.regexp_replace(F.col(BAD), '"(?:[^"]|"")*"', "")
            bad = bad & (F.size(F.split(bare, ",")) < width)
        problem = _fail_with(Problem(Errors.CSV, f"a record has other than {width} fields")).cast("string")
        out = []
        for (name, kind), at in zip(columns, places):
            text = F.when(bad, problem).otherwise(F.coalesce(F.col(f"f{at}"), F.lit("")))
            out.append((text if kind is Kind.VARCHAR else parse_int64(text)).alias(name))
        return raw.select(*out)
