"""Registered queries of the engine, as JSON query definitions over the bound tables, and their SQL in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import engine_queries
from marlstone.operators.select import Planner
from marlstone.operators.stats import byte_histogram, mean
from marlstone.plans.ast import select_query
from marlstone.sources.bound import BoundTables
from marlstone.sources.generated import sample_rows


def col(table: str, column: str) -> dict:
    return {"tableName": table, "columnName": column}


def op(operator: str, left: object, right: object) -> dict:
    return {"operator": operator, "leftOperand": left, "rightOperand": right}


def un(operator: str, operand: object) -> dict:
    return {"operator": operator, "operand": operand}


def fn(name: str, *arguments: object) -> dict:
    return {"functionName": name, "arguments": list(arguments)}


def select(*columns: object, where: object = None, order: list[tuple[int, bool]] | None = None, limit: int | None = None) -> dict:
    out: dict = {"columnClauses": list(columns)}
    if where is not None:
        out["whereClause"] = where
    if order is not None:
        out["orderByClause"] = [{"columnIndex": i, "ascending": up} for i, up in order]
    if limit is not None:
        out["limitClause"] = {"limit": limit}
    return out


_ORDER_KEY, _CUSTOMER_OF = col("orders", "o_orderkey"), col("orders", "o_custkey")
_CUSTOMER, _NAME, _SEGMENT = col("customer", "c_custkey"), col("customer", "c_name"), col("customer", "c_mktsegment")
_PART, _LINE_ORDER = col("lineitem", "l_partkey"), col("lineitem", "l_orderkey")
_DOC, _TEXT = col("documents", "doc_id"), col("documents", "text")
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Doubles of the test tables that hold whole numbers.
WHOLE = frozenset({"l_quantity"})

#: name: (query definition, DuckDB SQL)
SELECTIONS: dict[str, tuple[dict, str]] = {
    "scan_full": (
        select(col("region", "r_regionkey"), col("region", "r_name")),
        "SELECT r_regionkey::BIGINT c0, r_name c1 FROM region",
    ),
    "scan_pruned": (
        select(_LINE_ORDER, col("lineitem", "l_returnflag")),
        "SELECT l_orderkey c0, l_returnflag c1 FROM lineitem",
    ),
    "select_literal": (select(1, "x"), "SELECT 1::BIGINT c0, 'x' c1"),
    "project_exprs": (
        select(_ORDER_KEY, op("ADD", op("MULTIPLY", _CUSTOMER_OF, 2), 1), fn("CONCAT", col("orders", "o_orderstatus"), col("orders", "o_orderpriority"))),
        "SELECT o_orderkey c0, o_custkey*2+1 c1, concat(o_orderstatus,o_orderpriority) c2 FROM orders",
    ),
    "filter_lt": (
        select(1, _NAME, where=op("LESS_THAN", _CUSTOMER, 100), order=[(0, True)]),
        "SELECT 1::BIGINT c0, c_name c1 FROM customer WHERE c_custkey < 100",
    ),
    "cmp_range": (
        select(_ORDER_KEY, where=op("AND", op("AND", op("GREATER_EQUAL", _ORDER_KEY, 100), op("LESS_EQUAL", _ORDER_KEY, 200)), op("GREATER_THAN", _CUSTOMER_OF, 5))),
        "SELECT o_orderkey c0 FROM orders WHERE o_orderkey>=100 AND o_orderkey<=200 AND o_custkey>5",
    ),
    "eq_varchar": (
        select(_CUSTOMER, where=op("EQUAL", _SEGMENT, "FURNITURE")),
        "SELECT c_custkey c0 FROM customer WHERE c_mktsegment='FURNITURE'",
    ),
    "neq": (
        select(_CUSTOMER, where=op("NOT_EQUAL", _SEGMENT, "FURNITURE")),
        "SELECT c_custkey c0 FROM customer WHERE c_mktsegment<>'FURNITURE'",
    ),
    "eq_bool": (
        select(_ORDER_KEY, where=op("EQUAL", op("LESS_THAN", _CUSTOMER_OF, 500), op("LESS_THAN", _ORDER_KEY, 5000))),
        "SELECT o_orderkey c0 FROM orders WHERE (o_custkey<500)=(o_orderkey<5000)",
    ),
    "and_or": (
        select(_ORDER_KEY, where=op("OR", op("LESS_THAN", _CUSTOMER_OF, 10), op("AND", op("GREATER_THAN", _ORDER_KEY, 100), op("GREATER_THAN", _CUSTOMER_OF, 1000)))),
        "SELECT o_orderkey c0 FROM orders WHERE o_custkey<10 OR (o_orderkey>100 AND o_custkey>1000)",
    ),
    "not_pred": (
        select(_ORDER_KEY, where=un("NOT", op("LESS_THAN", _CUSTOMER_OF, 10))),
        "SELECT o_orderkey c0 FROM orders WHERE NOT (o_custkey<10)",
    ),
    "neg": (select(un("MINUS", _CUSTOMER_OF)), "SELECT -o_custkey c0 FROM orders"),
    "arith": (
        select(op("SUBTRACT", _ORDER_KEY, _CUSTOMER_OF), op("MULTIPLY", _ORDER_KEY, _CUSTOMER_OF)),
        "SELECT o_orderkey-o_custkey c0, o_orderkey*o_custkey c1 FROM orders",
    ),
    "div_trunc": (
        select(_ORDER_KEY, op("DIVIDE", op("SUBTRACT", _CUSTOMER_OF, _ORDER_KEY), 7)),
        "SELECT o_orderkey c0, (o_custkey-o_orderkey)//7 c1 FROM orders",
    ),
    "div_filtered": (
        select(_LINE_ORDER, op("DIVIDE", _LINE_ORDER, _PART), where=op("NOT_EQUAL", _PART, 0)),
        "SELECT l_orderkey c0, l_orderkey//l_partkey c1 FROM lineitem WHERE l_partkey<>0",
    ),
    "div_where": (
        select(_ORDER_KEY, where=op("GREATER_THAN", op("DIVIDE", _ORDER_KEY, op("ADD", op("MULTIPLY", _CUSTOMER_OF, _CUSTOMER_OF), 1)), 1)),
        "SELECT o_orderkey c0 FROM orders WHERE o_orderkey//(o_custkey*o_custkey+1) > 1",
    ),
    "upper": (select(_DOC, fn("UPPER", _TEXT)), f"SELECT doc_id c0, translate(text,'{_LOWER}','{_UPPER}') c1 FROM documents"),
    "lower": (select(_DOC, fn("LOWER", _TEXT)), f"SELECT doc_id c0, translate(text,'{_UPPER}','{_LOWER}') c1 FROM documents"),
    "strlen": (select(_DOC, fn("STRLEN", _TEXT)), "SELECT doc_id c0, strlen(text) c1 FROM documents"),
    "concat": (
        select(_CUSTOMER, fn("CONCAT", _NAME, fn("CONCAT", " ", _SEGMENT))),
        "SELECT c_custkey c0, concat(c_name, concat(' ', c_mktsegment)) c1 FROM customer",
    ),
    "order_multi": (
        select(_SEGMENT, _CUSTOMER, order=[(0, False), (1, True)], limit=25),
        "SELECT c_mktsegment c0, c_custkey c1 FROM customer ORDER BY c0 DESC, c1 ASC LIMIT 25",
    ),
    "order_varchar": (select(_NAME, order=[(0, False)], limit=10), "SELECT c_name c0 FROM customer ORDER BY c0 DESC LIMIT 10"),
    "order_full": (
        select(_CUSTOMER_OF, _ORDER_KEY, order=[(0, True), (1, False)]),
        "SELECT o_custkey c0, o_orderkey c1 FROM orders ORDER BY c0, c1 DESC",
    ),
    "topk": (
        select(_ORDER_KEY, _CUSTOMER_OF, order=[(1, False), (0, True)], limit=10),
        "SELECT o_orderkey c0, o_custkey c1 FROM orders ORDER BY c1 DESC, c0 ASC LIMIT 10",
    ),
    "limit_only": (select(col("nation", "n_nationkey"), limit=100), "SELECT n_nationkey::BIGINT c0 FROM nation LIMIT 100"),
    "limit_cuts": (
        select("x", where=op("GREATER_EQUAL", col("nation", "n_nationkey"), 0), limit=7),
        "SELECT 'x' c0 FROM nation WHERE n_nationkey >= 0 LIMIT 7",
    ),
    "div_nested": (
        select(_ORDER_KEY, op("DIVIDE", op("DIVIDE", op("DIVIDE", op("MULTIPLY", _ORDER_KEY, 1000), op("ADD", _CUSTOMER_OF, 1)), 3), op("ADD", op("DIVIDE", _ORDER_KEY, 100), 1))),
        "SELECT o_orderkey c0, (((o_orderkey*1000)//(o_custkey+1))//3)//((o_orderkey//100)+1) c1 FROM orders",
    ),
    "full_name": (
        select(_CUSTOMER, fn("CONCAT", fn("UPPER", _SEGMENT), fn("CONCAT", " ", _NAME)), where=op("EQUAL", _SEGMENT, "FURNITURE"), order=[(1, False), (0, True)]),
        f"SELECT c_custkey c0, concat(translate(c_mktsegment,'{_LOWER}','{_UPPER}'), concat(' ', c_name)) c1 FROM customer WHERE c_mktsegment='FURNITURE' ORDER BY c1 DESC, c0 ASC",
    ),
    "cse_repeat": (
        select(op("MULTIPLY", op("ADD", _ORDER_KEY, _CUSTOMER_OF), 2), op("MULTIPLY", op("ADD", _CUSTOMER_OF, _ORDER_KEY), 3)),
        "SELECT (o_orderkey+o_custkey)*2 c0, (o_custkey+o_orderkey)*3 c1 FROM orders",
    ),
}


def selection(definition: dict) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Planner(spark, BoundTables(spark, sf_dir, WHOLE)).plan(select_query(definition))

    return run


def cli_gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(spark).toDF("c0", "c1", "c2", "c3")


def stats_int_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return BoundTables(spark, sf_dir, WHOLE).scan("orders").agg(mean("o_custkey").alias("c0"))


def stats_char_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = byte_histogram(BoundTables(spark, sf_dir, WHOLE).scan("customer"), "c_mktsegment")
    return counted.select(F.chr("byte").alias("c0"), F.col("n").alias("c1"))


OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    **engine_queries.QUERIES,
    "cli_gen": (cli_gen, "SELECT (CASE WHEN i%2=0 THEN 1 ELSE -1 END)::BIGINT c0, (2*(i+1))::BIGINT c1, 'Hello' c2, 'There' c3 FROM range(1000) t(i)"),
    "stats_int_avg": (stats_int_avg, "SELECT avg(o_custkey) c0 FROM orders"),
    "stats_char_hist": (stats_char_hist, "SELECT ch c0, count(*) c1 FROM (SELECT unnest(string_split(c_mktsegment,'')) ch FROM customer) GROUP BY ch"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: selection(definition) for name, (definition, _) in SELECTIONS.items()} | {name: run for name, (run, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in SELECTIONS.items()} | {name: sql for name, (_, sql) in OTHERS.items()}
