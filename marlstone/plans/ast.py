"""Query trees and their JSON.

An expression is one of five forms, told apart by their fields. Decoding is strict: a field that is missing, of the
wrong type, or (in column references, clauses and requests) unknown is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any, Union

from marlstone.problems import DecodeError
from marlstone.types import INT64_MAX, INT64_MIN

FUNCTIONS = ("STRLEN", "CONCAT", "UPPER", "LOWER")
ARITHMETIC = ("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE")
LOGIC = ("AND", "OR")
EQUALITY = ("EQUAL", "NOT_EQUAL")
ORDERING = ("LESS_THAN", "LESS_EQUAL", "GREATER_THAN", "GREATER_EQUAL")
BINARY = ARITHMETIC + LOGIC + EQUALITY + ORDERING
UNARY = ("NOT", "MINUS")


@dataclass(frozen=True)
class ColumnRef:
    table: str
    column: str


@dataclass(frozen=True)
class Literal:
    value: int | str | bool


@dataclass(frozen=True)
class Function:
    name: str
    arguments: tuple["Expression", ...]


@dataclass(frozen=True)
class Binary:
    operator: str
    left: "Expression"
    right: "Expression"


@dataclass(frozen=True)
class Unary:
    operator: str
    operand: "Expression"


Expression = Union[ColumnRef, Literal, Function, Binary, Unary]


@dataclass(frozen=True)
class OrderBy:
    column_index: int
    ascending: bool


@dataclass(frozen=True)
class SelectQuery:
    columns: tuple[Expression, ...]
    where: Expression | None = None
    order_by: tuple[OrderBy, ...] | None = None
    limit: int | None = None


@dataclass(frozen=True)
class CopyQuery:
    source_filepath: str
    destination_table_name: str
    destination_columns: tuple[str, ...] | None = None
    has_header: bool = field(default=False)


def fields(json: Any, required: Mapping[str, Callable], optional: Mapping[str, Callable] = {}) -> dict:
    """The decoded fields of an object that has all required ones and none but the optional ones besides."""
    if not isinstance(json, dict):
        raise DecodeError(f"an object is wanted, not {json!r}")
    if missing := [k for k in required if k not in json]:
        raise DecodeError(f"fields are missing: {', '.join(missing)}")
    if extra := [k for k in json if k not in required and k not in optional]:
        raise DecodeError(f"fields are unknown: {', '.join(extra)}")
    return {k: (required.get(k) or optional[k])(v) for k, v in json.items()}


def text(json: Any) -> str:
    if not isinstance(json, str):
        raise DecodeError(f"a string is wanted, not {json!r}")
    return json


def boolean(json: Any) -> bool:
    if not isinstance(json, bool):
        raise DecodeError(f"a boolean is wanted, not {json!r}")
    return json


def integer(json: Any) -> int:
    if isinstance(json, bool) or not isinstance(json, int) or not INT64_MIN <= json <= INT64_MAX:
        raise DecodeError(f"a 64-bit integer is wanted, not {json!r}")
    return json


def items(decode: Callable) -> Callable[[Any], tuple]:
    def all_of(json: Any) -> tuple:
        if not isinstance(json, list):
            raise DecodeError(f"an array is wanted, not {json!r}")
        return tuple(decode(x) for x in json)

    return all_of


def _one_of(names: tuple[str, ...], what: str) -> Callable[[Any], str]:
    def named(json: Any) -> str:
        if json not in names or not isinstance(json, str):
            raise DecodeError(f"{json!r} is no {what}")
        return json

    return named


def expression(json: Any) -> Expression:
    """Literals are integers, strings and booleans; objects are the other four forms."""
    if isinstance(json, (bool, str)):
        return Literal(json)
    if isinstance(json, int):
        return Literal(integer(json))
    if not isinstance(json, dict):
        raise DecodeError(f"a literal is a string, an integer or a boolean, not {json!r}")
    if "functionName" in json and "arguments" in json:
        return Function(_one_of(FUNCTIONS, "function name")(json["functionName"]), items(expression)(json["arguments"]))
    if "operator" in json and "leftOperand" in json and "rightOperand" in json and json["operator"] in BINARY:
        return Binary(json["operator"], expression(json["leftOperand"]), expression(json["rightOperand"]))
    if "operator" in json and "operand" in json:
        return Unary(_one_of(UNARY, "unary operator")(json["operator"]), expression(json["operand"]))
    if "operator" in json:
        raise DecodeError(f"{json['operator']!r} is no operator, or lacks operands")
    found = fields(json, {"tableName": text, "columnName": text})
    return ColumnRef(found["tableName"], found["columnName"])


def _order(json: Any) -> OrderBy:
    found = fields(json, {"columnIndex": integer, "ascending": boolean})
    return OrderBy(found["columnIndex"], found["ascending"])


def _limit(json: Any) -> int:
    return fields(json, {"limit": integer})["limit"]


def select_query(json: Any) -> SelectQuery:
    found = fields(json, {"columnClauses": items(expression)}, {"whereClause": expression, "orderByClause": items(_order), "limitClause": _limit})
    return SelectQuery(found["columnClauses"], found.get("whereClause"), found.get("orderByClause"), found.get("limitClause"))


def copy_query(json: Any) -> CopyQuery:
    found = fields(json, {"sourceFilepath": text, "destinationTableName": text}, {"destinationColumns": items(text), "doesCsvContainHeader": boolean})
    return CopyQuery(found["sourceFilepath"], found["destinationTableName"], found.get("destinationColumns"), found.get("doesCsvContainHeader", False))


def query_definition(json: Any) -> SelectQuery | CopyQuery:
    """A selection, or else a copy."""
    return select_query(json) if isinstance(json, dict) and "columnClauses" in json else copy_query(json)


def expression_json(e: Expression) -> Any:
    match e:
        case Literal(value):
            return value
        case ColumnRef(table, column):
            return {"tableName": table, "columnName": column}
        case Function(name, arguments):
            return {"functionName": name, "arguments": [expression_json(a) for a in arguments]}
        case Binary(operator, left, right):
            return {"operator": operator, "leftOperand": expression_json(left), "rightOperand": expression_json(right)}
        case Unary(operator, operand):
            return {"operator": operator, "operand": expression_json(operand)}


def definition_json(query: SelectQuery | CopyQuery) -> dict:
    if isinstance(query, CopyQuery):
        out = {"sourceFilepath": query.source_filepath, "destinationTableName": query.destination_table_name}
        if query.destination_columns is not None:
            out["destinationColumns"] = list(query.destination_columns)
        return out | {"doesCsvContainHeader": query.has_header}
    out = {"columnClauses": [expression_json(e) for e in query.columns]}
    if query.where is not None:
        out["whereClause"] = expression_json(query.where)
    if query.order_by is not None:
        out["orderByClause"] = [{"columnIndex": o.column_index, "ascending": o.ascending} for o in query.order_by]
    if query.limit is not None:
        out["limitClause"] = {"limit": query.limit}
    return out
