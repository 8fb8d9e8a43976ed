"""Exact deduplication: rules, digests that clash, and brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from tables import empty, odd, odd_rows

from marlstone.llm.exact_dedup import drop_copies, exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    groups = {}
    for r, n in zip(rows, norm):
        groups.setdefault(n, []).append(r[0])
    out = []
    for r, n in zip(rows, norm):
        ids = [i for i in groups[n] if i is not None]
        keep = min(ids) if ids else None
        out.append((r[0], keep, len(groups[n]), r[0] == keep, hashlib.sha256(n.encode()).hexdigest()))
    return out


def key(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 0), lambda c: F.substring(F.unhex(F.sha2(c, 256)), 1, 1)])
def test_odd_rows(spark, digest):
    found = exact_dedup(odd(spark).repartition(5), **({} if digest is None else {"digest": digest}))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert key(tuple(r) for r in found.collect()) == key(brute(odd_rows()))


def test_one_large_group(spark):
    rows = [(i, "same text" if i % 3 else f"other {i % 50}") for i in range(3000)]
    found = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), salts=3)
    assert key(tuple(r) for r in found.collect()) == key(brute(rows))


def test_empty(spark):
    assert exact_dedup(empty(spark)).collect() == []
    assert drop_copies(empty(spark)).collect() == []


def test_rows_that_stay(spark):
    docs = odd(spark)
    kept = drop_copies(docs)
    assert kept.schema == docs.schema
    # Rows that repeat an id and its text are one.
    wanted = {(b[0], b[4]): r for r, b in zip(odd_rows(), brute(odd_rows())) if b[3]}
    assert key(tuple(r) for r in kept.collect()) == key(wanted.values()) and len(wanted) == len({b[4] for b in brute(odd_rows())})


def test_repeated_rows(spark):
    """One row stays of rows that repeat an id or have none, the same one in whatever order they come."""
    rows = [(i % 3 or None, "a  b" if i % 2 else "a b", i) for i in range(60)] + [(None, "c", i) for i in range(50)] + [(7, "d", 1)] * 40
    table = spark.createDataFrame(rows, "doc_id long, text string, row long")
    kept = [sorted(map(repr, map(tuple, drop_copies(table.repartition(n)).collect()))) for n in (1, 5)]
    assert kept[0] == kept[1] and len(kept[0]) == 3
    found = [tuple(r) for r in drop_copies(table).collect()]
    assert {(r[0], re.sub(" +", " ", r[1])) for r in found} == {(1, "a b"), (None, "c"), (7, "d")} and set(found) <= set(rows)


def test_an_id_given_to_two_texts(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b")]
    assert sorted(tuple(r) for r in drop_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [(1, "a"), (2, "b")]
