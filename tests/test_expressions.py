"""Expressions: types, failures, and a comparison with a small interpreter on random trees."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from marlstone.operators.select import Planner
from marlstone.plans.analyze import analyze
from marlstone.plans.ast import definition_json, expression, expression_json, query_definition, select_query
from marlstone.problems import DecodeError, ProblemsError, found_in
from marlstone.queries import col, fn, op, select, un
from marlstone.types import INT64_MAX, INT64_MIN, Kind

ROWS = [(0, 5, "Zażółć Ab", "x"), (1, 0, "ß", "é"), (2, INT64_MAX, "", "B"), (3, INT64_MIN, "abc", "abc"), (4, -7, "Abc", "abd")]
A, B, S, R = (col("t", c) for c in ("a", "b", "s", "r"))


class Tables:
    def __init__(self, spark, rows=ROWS):
        self.spark, self.rows = spark, rows

    def columns_of(self, table):
        return [("a", Kind.INT64), ("b", Kind.INT64), ("s", Kind.VARCHAR), ("r", Kind.VARCHAR), ("a `b", Kind.INT64)] if table in ("t", "u") else None

    def scan(self, table):
        return self.spark.createDataFrame([(*r, 1) for r in self.rows], "a long, b long, s string, r string, `a ``b` long")


def run(spark, definition, rows=ROWS, strict=True):
    return [tuple(r) for r in Planner(spark, Tables(spark, rows), strict).plan(select_query(definition)).collect()]


def errors(spark, definition, rows=ROWS):
    with pytest.raises(Exception) as caught:
        run(spark, definition, rows)
    return [(p.error, p.context) for p in found_in(caught.value)]


def test_integers_wrap_around_and_the_session_keeps_its_mode(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    assert run(spark, select(op("ADD", B, 1), un("MINUS", B), op("MULTIPLY", B, 2), where=op("EQUAL", A, 2))) == [(INT64_MIN, -INT64_MAX, -2)]
    assert run(spark, select(op("DIVIDE", B, -1), un("MINUS", B), where=op("EQUAL", A, 3))) == [(INT64_MIN, INT64_MIN)]
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_division_truncates_and_by_zero_fails(spark):
    assert run(spark, select(op("DIVIDE", B, 2), where=op("EQUAL", A, 4))) == [(-3,)]
    assert errors(spark, select(op("DIVIDE", A, B))) == [("Division by zero", "1 / 0")]
    assert len(run(spark, select(op("DIVIDE", A, B), where=op("NOT_EQUAL", B, 0)))) == 4


def test_both_sides_of_and_and_or_are_evaluated(spark):
    large = op("GREATER_THAN", op("DIVIDE", A, B), 1)
    for where in (op("AND", op("NOT_EQUAL", B, 0), large), op("AND", large, op("NOT_EQUAL", B, 0)), op("OR", op("EQUAL", B, 0), large)):
        assert errors(spark, select(A, where=where)) == [("Division by zero", "1 / 0")]
    inner = op("EQUAL", op("DIVIDE", 1, op("DIVIDE", A, B)), 0)
    assert errors(spark, select(A, where=inner), [(1, 0, "", "")]) == [("Division by zero", "1 / 0")]
    assert errors(spark, select(A, where=inner), [(0, 5, "", "")]) == [("Division by zero", "1 / 0")]


def test_order_of_texts_is_unimplemented_once_a_row_is_evaluated(spark):
    query = select(A, where=op("OR", op("LESS_THAN", S, R), op("EQUAL", A, A)))
    assert errors(spark, query)[0][0] == "Unimplemented"
    assert len(run(spark, query, strict=False)) == 5
    assert errors(spark, select(A, where=op("LESS_THAN", op("EQUAL", A, 1), True)))[0][0] == "Unimplemented"


def test_order_of_texts_passes_without_rows(spark):
    df = Planner(spark, Tables(spark)).plan(select_query(select(A, where=op("LESS_THAN", S, R)))).limit(0)
    assert df.collect() == []


def test_functions_are_of_bytes_and_ascii(spark):
    assert run(spark, select(fn("UPPER", S), fn("LOWER", S), fn("STRLEN", S), fn("CONCAT", S, R), where=op("LESS_EQUAL", A, 1))) == [
        ("ZAżółć AB", "zażółć ab", 13, "Zażółć Abx"),
        ("ß", "ß", 2, "ßé"),
    ]


def test_texts_are_ordered_by_bytes(spark):
    assert [r[0] for r in run(spark, select(R, order=[(0, True)]))] == ["B", "abc", "abd", "x", "é"]


def test_boolean_columns_fail_after_the_analysis(spark):
    assert errors(spark, select(op("EQUAL", A, B)))[0][0].startswith("Unexpected error")
    assert errors(spark, select(op("EQUAL", A, S)))[0][0] == "Types don't match"


def test_names_are_quoted(spark):
    assert run(spark, select(col("t", "a `b"), limit=1)) == [(1,)]


def test_all_problems_are_reported(spark):
    query = select(op("ADD", S, True), fn("CONCAT", "x"), fn("STRLEN", op("AND", 1, col("t", "no"))), col("no", "a"), where=A, order=[(9, True), (8, True)], limit=-1)
    with pytest.raises(ProblemsError) as caught:
        analyze(select_query(query), Tables(spark))
    assert [(p.error, p.context) for p in caught.value.problems] == [
        ("Invalid arguments", "ADD takes (INT64, INT64), not (VARCHAR, BOOL)"),
        ("Invalid number of arguments", "CONCAT takes 2, not 1"),
        ("Column not found", "t.no"),
        ("Table not found", "no"),
        ("Invalid where clause type", "INT64, not BOOL"),
        ("Invalid order by clause", "number 0 names column 9 of 4"),
        ("Invalid limit clause", "-1 is negative"),
    ]


def test_one_table_and_no_from(spark):
    with pytest.raises(ProblemsError) as caught:
        analyze(select_query(select(A, col("u", "a"))), Tables(spark))
    assert [p.error for p in caught.value.problems] == ["Multiple tables"]
    assert run(spark, select(1, where=op("GREATER_THAN", A, 2))) == [(1,), (1,)]
    assert run(spark, select(1, "x")) == [(1, "x")]


@pytest.mark.parametrize(
    "json",
    [1.5, None, [], {}, {"tableName": "t"}, {"tableName": "t", "columnName": "a", "more": 1}, 2**63, {"operator": "NOPE", "operand": 1}, {"functionName": "NOPE", "arguments": []}, {"operator": "ADD", "leftOperand": 1}],
)
def test_bad_expressions(json):
    with pytest.raises(DecodeError):
        expression(json)


@pytest.mark.parametrize("json", [{}, {"columnClauses": [], "more": 1}, {"columnClauses": [], "limitClause": {"limit": True}}, {"sourceFilepath": "x"}, {"columnClauses": [], "orderByClause": [{"columnIndex": 0}]}])
def test_bad_definitions(json):
    with pytest.raises(DecodeError):
        query_definition(json)


def test_definitions_round_trip():
    for json in (select(A, fn("UPPER", S), un("NOT", True), where=op("EQUAL", A, 1), order=[(0, False)], limit=3), {"sourceFilepath": "a.csv", "destinationTableName": "t", "destinationColumns": ["a"], "doesCsvContainHeader": True}):
        assert definition_json(query_definition(json)) == json
    assert expression_json(expression(True)) is True


class Fails(Exception):
    pass


def wrapped(n):
    return (n + 2**63) % 2**64 - 2**63


def interpret(e, row):
    """The value of an expression's JSON; Fails as the query does."""
    if not isinstance(e, dict):
        return e
    if "columnName" in e:
        return row[e["columnName"]]
    if "functionName" in e:
        x = [interpret(a, row) for a in e["arguments"]]
        return {"UPPER": lambda: "".join(c.upper() if c.isascii() else c for c in x[0]), "STRLEN": lambda: len(x[0].encode()), "CONCAT": lambda: x[0] + x[1]}[e["functionName"]]()
    if "operand" in e:
        x = interpret(e["operand"], row)
        return (not x) if e["operator"] == "NOT" else wrapped(-x)
    l, r, o = interpret(e["leftOperand"], row), interpret(e["rightOperand"], row), e["operator"]
    if o == "DIVIDE":
        if r == 0:
            raise Fails
        return wrapped(abs(l) // abs(r) * (1 if (l < 0) == (r < 0) else -1))
    return {
        "ADD": lambda: wrapped(l + r), "SUBTRACT": lambda: wrapped(l - r), "MULTIPLY": lambda: wrapped(l * r), "AND": lambda: l and r, "OR": lambda: l or r,
        "EQUAL": lambda: l == r, "NOT_EQUAL": lambda: l != r, "LESS_THAN": lambda: l < r, "GREATER_EQUAL": lambda: l >= r,
    }[o]()


texts = st.recursive(st.sampled_from(["", "aß", S, R]), lambda x: st.one_of(st.builds(lambda a: fn("UPPER", a), x), st.builds(lambda a, b: fn("CONCAT", a, b), x, x)), max_leaves=3)
numbers = st.recursive(
    st.one_of(st.sampled_from([0, 1, -1, INT64_MAX, INT64_MIN, A, B]), st.builds(lambda s: fn("STRLEN", s), texts)),
    lambda x: st.one_of(st.builds(lambda a: un("MINUS", a), x), st.builds(op, st.sampled_from(["ADD", "SUBTRACT", "MULTIPLY", "DIVIDE"]), x, x)),
    max_leaves=5,
)
conditions = st.recursive(
    st.one_of(st.booleans(), st.builds(op, st.sampled_from(["EQUAL", "LESS_THAN", "GREATER_EQUAL"]), numbers, numbers), st.builds(op, st.just("NOT_EQUAL"), texts, texts)),
    lambda x: st.one_of(st.builds(lambda a: un("NOT", a), x), st.builds(op, st.sampled_from(["AND", "OR", "EQUAL"]), x, x)),
    max_leaves=4,
)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow], derandomize=True)
@given(numbers, texts, conditions)
def test_random_expressions(spark, number, string, condition):
    rows = [dict(zip(("a", "b", "s", "r"), r)) for r in ROWS]
    query = select(number, string, A, where=op("AND", condition, op("EQUAL", A, A)))
    try:
        kept = [r for r, ok in [(r, interpret(condition, r)) for r in rows] if ok]
        wanted = sorted((interpret(number, r), interpret(string, r), r["a"]) for r in kept)
    except Fails:
        assert errors(spark, query)[0][0] == "Division by zero"
        return
    assert sorted(run(spark, query)) == wanted
