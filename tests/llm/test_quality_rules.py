"""Quality rules: statistics and estimates against brute force, verdicts against labels."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import empty, odd, odd_rows

from marlstone.llm import quality_rules as q
from marlstone.llm.shared import documents, labels

SF = "/root/testdata/sf0.01"


def statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def failed(s):
    return s[0] < 10 or 100 * s[4] > 20 * s[0]


def brute_estimates(z, rules):
    """The same estimate of one group's vectors with numpy."""
    p, n = z.shape[1], len(z)
    floor = np.diag([(s.tolerance * q.UNIT) ** 2 for s in rules.statistics])

    def median(v):
        return np.sort(v)[(len(v) + 1) // 2 - 1]

    cells = np.floor(z / q.CELL)
    med = np.array([median(c) for c in cells.T])
    mad = np.array([median(np.abs(c - m)) for c, m in zip(cells.T, med)])
    off = (z - (med + 0.5) * q.CELL) ** 2 / ((1.4826 * q.CELL * mad) ** 2 + np.diag(floor))
    fits = []
    for d2 in (off.sum(1), off.max(1)):
        for step in range(rules.steps + 1):
            bucket = np.floor(16 * np.log2(1 + d2)).astype(int)
            order = np.sort(bucket)
            most = next(b for b in np.unique(bucket) if (bucket <= b).sum() >= rules.support * n)
            near = z[bucket <= most]
            centre = near.mean(0)
            cov = (near.T @ near / len(near) - np.outer(centre, centre)) * q.consistency(rules.support, p) + floor
            d2 = np.einsum("ij,jk,ik->i", z - centre, np.linalg.inv(cov), z - centre)
        fits.append((np.linalg.slogdet(cov)[1], d2))
    d2 = min(fits, key=lambda f: f[0])[1]
    near = z[d2 <= q.chi2_quantile(rules.reweight, p)]
    centre = near.mean(0)
    cov = (near.T @ near / len(near) - np.outer(centre, centre)) * q.consistency(rules.reweight, p) + floor
    return np.einsum("ij,jk,ik->i", z - centre, np.linalg.inv(cov), z - centre)


def test_odd_rows(spark):
    found = {}
    for r in q.quality_rules(odd(spark)).collect():
        found.setdefault(r["doc_id"], []).append(tuple(r)[1:7] + (r["kept"],))
    for r in odd_rows():
        s = statistics(r[1])
        assert (*s, failed(s), not failed(s)) in found[r[0]]
    assert sum(map(len, found.values())) == len(odd_rows())


def test_empty(spark):
    assert q.quality_rules(empty(spark)).collect() == []
    assert q.drop_low_quality(empty(spark)).collect() == []


def test_repeated_windows(spark):
    texts = ["a b c d e a b c d e", "a a a a a a", "a a a a a", "a b c d e f a b c d e g b c d e f", "x " * 3 + "a b c d e " * 2]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "'en' lang", "'a' source")
    found = dict(q.text_statistics(rows).select("doc_id", "n_repeat_words").collect())
    assert [found[i] for i in range(len(texts))] == [statistics(t)[4] for t in texts]


def test_chi2():
    assert q.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)
    assert q.chi2_quantile(0.975, 2) == pytest.approx(7.3778, abs=1e-3)
    assert q.consistency(0.9999999, 5) == pytest.approx(1, abs=1e-4)


def test_against_brute_force(spark):
    rules = q.Rules(min_group=30)
    docs = documents(spark, SF).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 3 == 1, "y"))
    got = {r["doc_id"]: r for r in q.quality_rules(docs, rules).collect()}
    rows = docs.collect()
    stats = {r["doc_id"]: statistics(r["text"]) for r in rows}
    for i, s in stats.items():
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_symbols"], got[i]["n_dup_lines"], got[i]["n_repeat_words"]) == s
        assert got[i]["base_failed"] == failed(s)
    vectors = q.with_vectors(q.text_statistics(docs, rules), rules).where("NOT base_failed").toPandas()
    checked = 0
    for _, group in vectors.groupby(["lang", "source"], dropna=False):
        if len(group) < rules.min_group:
            assert all(got[i]["distance2"] is None and got[i]["kept"] for i in group.doc_id)
            continue
        wanted = brute_estimates(group[[f"z{i}" for i in range(5)]].to_numpy(dtype=float), rules)
        for i, d2 in zip(group.doc_id, wanted):
            assert got[i]["distance2"] == pytest.approx(d2, rel=1e-6, abs=1e-9)
            assert got[i]["kept"] == (d2 <= rules.cutoff)
            checked += 1
    assert checked > 500


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.1"
    docs = documents(spark, sf)
    verdict = q.quality_rules(docs).join(labels(spark, sf), "doc_id").where("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")), F.count("*"))
    found = {r[0]: (r[1], r[2]) for r in verdict.collect()}
    assert found[1][0] >= 0.999 and found[1][1] > 3000
    assert found[0][0] <= 0.05 and found[0][1] > 200


def test_stage_keeps_columns_and_agrees(spark):
    docs = documents(spark, SF).withColumn("extra.dot", F.lit(1))
    kept = q.drop_low_quality(docs)
    assert kept.columns == docs.columns
    wanted = {r["doc_id"] for r in q.quality_rules(docs).where("kept").collect()}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(wanted)
    assert q.drop_low_quality(odd(spark)).schema == odd(spark).schema


def test_small_groups_are_judged(spark):
    """Junk goes from sources and languages of a few rows as from large ones; of a small table all stays."""
    good = labels(spark, SF).where("quality = 1").select("doc_id")
    prose = documents(spark, SF).join(good, "doc_id").where("lang = 'en' AND n_chars BETWEEN 500 AND 3000").orderBy("doc_id").limit(60).collect()
    junk = " ".join("#$%&|<>*"[i % 7 :] + str(i) for i in range(100))
    rows = [(i, r["text"], "en", "large") for i, r in enumerate(prose)]
    small = [(1000, prose[0]["text"], "en", "small"), (1001, junk, "en", "small"), (1002, prose[1]["text"], None, "x"), (1003, junk, None, None)]
    schema = "doc_id long, text string, lang string, source string"
    found = {r["doc_id"]: r for r in q.quality_rules(spark.createDataFrame([*rows, *small], schema)).collect()}
    assert {i: found[i]["kept"] for i in range(1000, 1004)} == {1000: True, 1001: False, 1002: True, 1003: False}
    assert len(found) == 64 and all(r["distance2"] is not None for r in found.values() if not r["base_failed"])
    assert all(r["kept"] and r["distance2"] is None for r in q.quality_rules(spark.createDataFrame(small, schema)).collect())
