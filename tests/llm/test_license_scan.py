"""Licence scan: canonical forms, whole texts, notices, and the SQL."""

import re

import duckdb
from tables import empty, odd, odd_rows

from marlstone.llm import license_scan as q
from marlstone.llm.shared import documents

SF = "/root/testdata/sf0.01"
MIT = q.LICENSES["MIT"]
TEXTS = {
    1: MIT,
    2: "Copyright (c) 2020 Some One\n  © Others\nAll rights reserved.\n" + MIT.upper().replace(" ", "\n"),
    3: MIT.replace("License", "Licence").replace("sublicense", "sub-licence").replace("HOLDERS", "OWNERS"),
    4: MIT + " more",
    5: "Prose.\n  licensed under THE MIT licence!\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.",
    6: "Licensed under the MIT License. But not as a line.",
    7: "Permission",
    8: None,
    9: q.LICENSES["0BSD"],
}


def test_whole_texts_and_notices(spark):
    found = {r["doc_id"]: tuple(r)[1:] for r in q.scan_licenses(spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")).collect()}
    assert found == {
        1: ("MIT", "", 0),
        2: ("MIT", "", 0),
        3: ("MIT", "", 0),
        4: (None, "", 0),
        5: (None, "CC-BY-NC-4.0,MIT", 3),
        6: (None, "", 0),
        7: (None, "", 0),
        8: (None, "", 0),
        9: ("0BSD", "", 0),
    }


def disguised(text):
    """The same licence with another holder, case, layout, punctuation and spelling."""
    out = "Copyright (c) 1999, 2024 Jo Doe\n" + re.sub(r"\bLICENSE(S|D)?\b", r"LICENCE\1", text.upper()).replace("ACKNOWLEDGMENT", "ACKNOWLEDGEMENT")
    return "\n\n".join("  " + p.replace("\n", " \n\t").replace('"', "“").replace(";", " ;") for p in out.split("\n\n"))


def test_every_known_licence(spark):
    rows, wanted = [], {}
    for name, text in q.LICENSES.items():
        for form in q.forms(name, text):
            for found in (form, disguised(form)):
                rows.append((len(rows), found))
                wanted[rows[-1][0]] = q.digests(q.LICENSES)[q.digest(form)]
            # A changed sentence makes another text of it.
            words = form.split()
            rows.append((len(rows), " ".join([*words[:40], "never", *words[40:]])))
            wanted[rows[-1][0]] = None
    got = {r["doc_id"]: r["license_id"] for r in q.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == wanted and {v for v in wanted.values() if v} == set(q.LICENSES)


def test_every_notice(spark):
    rows = [(i, f"Some prose.\n// {n}\nMore.") for i, n in enumerate(q.NOTICES)]
    got = {r["doc_id"]: (r["notice_ids"], r["n_notices"]) for r in q.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (name, 1) for i, name in enumerate(q.NOTICES.values())}


def test_markers_are_in_every_form():
    marks = q.markers(q.LICENSES)
    assert marks and all(set(marks) & set(q.canonical(f).split()) for n, t in q.LICENSES.items() for f in q.forms(n, t))
    assert q.markers({"x": "licence"}) == []


def test_known_texts_differ():
    assert len({q.digest(t) for t in q.LICENSES.values()}) == len(q.LICENSES)
    assert q.canonical("  The LICENCE—holder’s\n(c) 2020 me\nfoo ") == "the license holder s foo"


def test_odd_rows(spark):
    found = q.scan_licenses(odd(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in odd_rows())
    assert {tuple(r)[1:] for r in found} == {(None, "", 0)}
    assert q.scan_licenses(empty(spark)).collect() == []


def test_documents_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    found = q.scan_licenses(documents(spark, SF))
    wanted = con.execute(q.duckdb_sql()).fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))
    assert found.where("n_notices > 0").count() > 10
