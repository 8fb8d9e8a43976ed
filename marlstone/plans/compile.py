"""Compilation of analysed expressions to Spark columns.

Integers wrap around, a division by zero fails the query, and both sides of AND and OR are always evaluated. So
columns are built with ANSI mode off, which they keep; divisions carry a guard; and a condition with something
that can fail is preceded by a check of everything in it, operands first, whatever AND and OR would skip.
Conditions that cannot fail are left bare, so Catalyst can push them to the scan.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.scalar import SCALAR
from marlstone.plans.ast import ORDERING, Binary, ColumnRef, Expression, Function, Literal, Unary
from marlstone.problems import MARK, Errors, Problem
from marlstone.types import Kind

ANSI = "spark.sql.ansi.enabled"
_PLANNING = threading.RLock()


@contextmanager
def wrapping_integers(spark: SparkSession) -> Iterator[None]:
    """ANSI mode is off for columns that are built inside; they keep it, and the session gets its setting back.

    Threads that build such columns wait for each other, so none restores another's setting.
    """
    with _PLANNING:
        before = spark.conf.get(ANSI)
        spark.conf.set(ANSI, "false")
        try:
            yield
        finally:
            spark.conf.set(ANSI, before)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _fail(problem: Column) -> Column:
    return F.raise_error(F.concat(F.lit(MARK), problem))


def _fail_with(problem: Problem) -> Column:
    return _fail(F.lit(json.dumps(problem.to_json())))


def _division_by_zero(left: Column, right: Column) -> Column:
    context = F.concat(left.cast("string"), F.lit(" / "), right.cast("string"))
    return _fail(F.concat(F.lit(f'{{"error": "{Errors.DIVISION}", "context": "'), context, F.lit('"}')))


_OPERATORS = {
    "ADD": lambda a, b: a + b,
    "SUBTRACT": lambda a, b: a - b,
    "MULTIPLY": lambda a, b: a * b,
    "AND": lambda a, b: a & b,
    "OR": lambda a, b: a | b,
    "EQUAL": lambda a, b: a == b,
    "NOT_EQUAL": lambda a, b: a != b,
    "LESS_THAN": lambda a, b: a < b,
    "LESS_EQUAL": lambda a, b: a <= b,
    "GREATER_THAN": lambda a, b: a > b,
    "GREATER_EQUAL": lambda a, b: a >= b,
}


def _quotient(a: Column, b: Column) -> Column:
    return F.when(b == 0, _division_by_zero(a, b).cast("bigint")).otherwise(F.call_function("div", a, b))


def _divides(e: Expression) -> bool:
    match e:
        case Function(_, arguments):
            return any(map(_divides, arguments))
        case Unary(_, operand):
            return _divides(operand)
        case Binary(operator, left, right):
            return operator == "DIVIDE" or _divides(left) or _divides(right)
    return False


class Compiler:
    """strict: comparisons by order are of integers alone, and of other kinds fail once a row is evaluated."""

    def __init__(self, kind_of, strict: bool = True):
        self.kind_of, self.strict = kind_of, strict

    def value(self, e: Expression) -> Column:
        match e:
            case Literal(value):
                return F.lit(value) if isinstance(value, (bool, str)) else F.lit(value).cast("bigint")
            case ColumnRef(_, column):
                return F.col(quoted(column))
            case Function(name, arguments):
                return SCALAR[name](*[self.value(a) for a in arguments])
            case Unary("NOT", operand):
                return ~self.value(operand)
            case Unary(_, operand):
                return -self.value(operand)
            case Binary("DIVIDE", left, right):
                return self._bound(left, right, _quotient)
            case Binary(operator, left, right):
                return _OPERATORS[operator](self.value(left), self.value(right))
        raise TypeError(f"not an expression: {e!r}")

    def _bound(self, left: Expression, right: Expression, use: Callable[[Column, Column], Column]) -> Column:
        """``use`` of both values, which it names several times; where one divides, both are evaluated once and named.

        So the columns of nested divisions grow with their depth and not as a power of it. Others stay as they are,
        within generated code.
        """
        a, b = self.value(left), self.value(right)
        if not (_divides(left) or _divides(right)):
            return use(a, b)
        return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: use(x["a"], x["b"]))[0]

    def checks(self, e: Expression) -> list[Column]:
        """Columns that are true, or fail where evaluating ``e`` fails, operands first."""
        match e:
            case Function(_, arguments):
                return [c for a in arguments for c in self.checks(a)]
            case Unary(_, operand):
                return self.checks(operand)
            case Binary(operator, left, right):
                out = self.checks(left) + self.checks(right)
                if operator == "DIVIDE":
                    out.append(self._bound(left, right, lambda a, b: F.when(b == 0, _division_by_zero(a, b).cast("boolean")).otherwise(F.lit(True))))
                elif operator in ORDERING and self.strict and self.kind_of(left) is not Kind.INT64:
                    out.append(_fail_with(Problem(Errors.UNIMPLEMENTED, f"{operator} of {self.kind_of(left).value}")).cast("boolean"))
                return out
        return []

    def condition(self, e: Expression) -> Column:
        """The condition as a filter, with its checks before it."""
        checks = self.checks(e)
        if not checks:
            return self.value(e)
        # A chain of CASE keeps the order; a conjunction could be split up and reordered.
        out = self.value(e)
        for check in reversed(checks):
            out = F.when(check, out).otherwise(_fail(F.lit('{"error": "Unreachable"}')).cast("boolean"))
        return out
