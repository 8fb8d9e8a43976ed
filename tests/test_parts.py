"""Chunks, checksums, statistics, generated rows and integer parsing."""

import os

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions.checksum import block_order, checksum, plain
from marlstone.operators.stats import describe
from marlstone.plans.ast import Binary, ColumnRef, Literal
from marlstone.plans.compile import Compiler, wrapping_integers
from marlstone.problems import found_in
from marlstone.sources.blocks import blocks, checksums
from marlstone.sources.csv_copy import mapping, parse_int64, read_rows
from marlstone.sources.generated import sample_rows
from marlstone.streaming.chunks import chunks, groups, json_stream
from marlstone.types import INT64_MAX, INT64_MIN, Kind


@given(st.lists(st.integers(0, 10)), st.integers(0, 12))
def test_groups(weights, most):
    found = list(groups(weights, lambda w: w, most))
    assert [w for g in found for w in g] == weights
    assert all(g and (sum(g) <= most or len(g) == 1) for g in found)
    assert all(sum(a) + b[0] > most for a, b in zip(found, found[1:]))


def test_chunks_weigh_bytes():
    assert [c["rowCount"] for c in chunks([(1, "ab"), (2, "é"), (3, "")], most=20)] == [2, 1]
    assert list(json_stream([])) == ["[", "]"]
    assert "".join(json_stream([{"rowCount": 1, "columns": [[1]]}] * 2)) == '[{"rowCount": 1, "columns": [[1]]},{"rowCount": 1, "columns": [[1]]}]'


def test_checksum_of_blocks(spark, tmp_path):
    (tmp_path / "digits").write_bytes(b"11112" + b"22233" + b"33444" + b"4")
    (tmp_path / "empty").write_bytes(b"")
    found = {(os.path.basename(r["path"]), r["order"]): (r["crc64"], r["blocks"]) for r in checksums(spark, str(tmp_path), 5).collect()}
    assert found == {
        ("digits", "sequential"): ("9499028d4cbdfa6d", 4),
        ("digits", "alternating"): ("364b15c66eeb496f", 4),
    }
    assert [bytes(r["data"]) for r in blocks(spark, str(tmp_path / "digits"), 5).orderBy("block").collect()] == [b"11112", b"22233", b"33444", b"4\0\0\0\0"]
    assert list(block_order(5, True)) == [0, 4, 1, 3, 2]
    with pytest.raises(ValueError):
        checksums(spark, str(tmp_path), 0)


@given(st.binary(max_size=300), st.integers(0, 2**64 - 1))
def test_checksum_is_the_plain_one(data, crc):
    assert checksum(data, crc) == plain(data, crc)


def test_describe(spark):
    assert describe(sample_rows(spark)) == {"col_int_1": 0.0, "col_int_2": 1001.0, "col_vchar_1": {"H": 1000, "e": 1000, "l": 2000, "o": 1000}, "col_vchar_2": {"T": 1000, "h": 1000, "e": 2000, "r": 1000}}
    assert describe(sample_rows(spark, 0)) == {"col_int_1": 0.0, "col_int_2": 0.0, "col_vchar_1": {}, "col_vchar_2": {}}
    assert describe(spark.createDataFrame([("é",)], "s string")) == {"s": {"Ã": 1, "©": 1}}


@pytest.mark.parametrize(
    "text, value",
    [("12", 12), ("-5", -5), ("+5", 5), ("1_000", 1000), ("0x1F", 31), ("-0x10", -16), ("0b101", 5), ("0o17", 15), ("0u7", 7), (str(INT64_MAX), INT64_MAX), (str(INT64_MIN), INT64_MIN), ("0xffffffffffffffff", -1), ("007", 7)],
)
def test_parse_int64(spark, text, value):
    assert spark.createDataFrame([(text,)], "s string").select(parse_int64(F.col("s"))).first()[0] == value


@pytest.mark.parametrize("text", ["", "x", "1.5", "9223372036854775808", "0x", "_1", "0b2", "1 2", '"'])
def test_parse_int64_fails(spark, text):
    with pytest.raises(Exception) as caught:
        spark.createDataFrame([(text,)], "s string").select(parse_int64(F.col("s"))).collect()
    problem = found_in(caught.value)[0]
    assert (problem.error, problem.context) == ("Failed to parse INT64", text)


def test_mapping_is_a_gather():
    columns = [(c, Kind.INT64) for c in "abc"]
    assert mapping(columns, None) == [0, 1, 2]
    assert mapping(columns, ["b", "c", "a"]) == [1, 2, 0]
    assert mapping(columns, ["b", "c", "a"], scatter=True) == [2, 0, 1]


def test_nested_divisions_stay_small(spark):
    """Twelve divisions in each other, on both sides, are planned as a chain and not as a tree of copies."""
    table = spark.createDataFrame([(10**18,)], "a long")
    expression, wanted = ColumnRef("t", "a"), 10**18
    for i in range(12):
        expression, wanted = Binary("DIVIDE", expression, Binary("ADD", Binary("DIVIDE", Literal(7), Literal(i + 2)), Literal(2))), wanted // (7 // (i + 2) + 2)
    compiler = Compiler(lambda e: Kind.INT64)
    with wrapping_integers(spark):
        df = table.where(compiler.condition(Binary("GREATER_THAN", expression, Literal(0)))).select(compiler.value(expression).alias("c0"))
    assert len(df._jdf.queryExecution().analyzed().toString()) < 100_000
    assert df.first()[0] == wanted
    zero = Binary("DIVIDE", Literal(1), Binary("DIVIDE", ColumnRef("t", "a"), Literal(2**62)))
    with wrapping_integers(spark):
        failing = table.select(compiler.value(zero))
    with pytest.raises(Exception) as error:
        failing.collect()
    assert found_in(error.value)[0].error == "Division by zero" and found_in(error.value)[0].context == "1 / 0"


def test_split_files_have_one_record_a_line(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"x, y"\n2,\n')
    (tmp_path / "b.csv").write_text('k,v\n1,"x\ny"\n')
    columns = [("k", Kind.INT64), ("v", Kind.VARCHAR)]
    assert sorted(map(tuple, read_rows(spark, str(tmp_path / "a.csv"), columns, has_header=True, multi_line=False).collect())) == [(1, "x, y"), (2, "")]
    assert read_rows(spark, str(tmp_path / "b.csv"), columns, has_header=True).collect()[0]["v"] == "x\ny"
    with pytest.raises(Exception):
        read_rows(spark, str(tmp_path / "b.csv"), columns, has_header=True, multi_line=False).collect()
