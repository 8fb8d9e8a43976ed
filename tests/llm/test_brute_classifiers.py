"""Statistics, scores and verdicts of the classifiers against plain Python, text by text."""

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tables import odd, odd_rows

from marlstone.llm import language_id, rule_quality, shared, toxicity
from marlstone.llm.shared import documents, labels

SF = "/root/testdata/sf0.001"
M32 = (1 << 32) - 1


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"]) for r in documents(spark, SF).collect()] + [(r[0], r[1]) for r in odd_rows()]


def words_of(text, digits):
    """Words of lower-cased UTF-8: a-z, digits or not, and all bytes from 0x80."""
    keep = rb"[a-z0-9\x80-\xff]+" if digits else rb"[a-z\x80-\xff]+"
    return re.findall(keep, (text or "").lower().encode())


def bucket(gram, bits):
    value = sum(b * pow(0x01000193, k, 1 << 32) for k, b in enumerate(gram)) & M32
    return ((value + len(gram) * 0x9E3779B1) * 2654435769 & M32) >> 32 - bits


def whole(word, bits):
    value = sum(b * pow(0x85EBCA6B, min(i, 63) + 1, 1 << 32) for i, b in enumerate(word)) & M32
    return ((value ^ 0x5BD1E995) * 2654435769 & M32) >> 32 - bits


def buckets(word, sizes, bits):
    padded = b" " + word + b" "
    return [bucket(padded[i : i + n], bits) for n in sizes for i in range(len(padded) - n + 1)]


def scripts(word):
    out = 0
    for c in word.decode():
        for first, last, name in language_id.SCRIPT_RANGES:
            if first <= ord(c) <= last:
                out |= 1 << sorted({s for *_, s in language_id.SCRIPT_RANGES}).index(name)
    return out


def language_scores(model, word):
    s = model.settings
    sums = sum((model.table[b].astype(float) for b in buckets(word, s.sizes, s.bits)), np.zeros(len(model.languages)))
    sums = np.maximum(sums - sums.max(), -s.word_most)
    fits = [scripts(word) & int(m) != 0 for m in model.scripts]
    return [-s.word_most if any(fits) and not fit else v for v, fit in zip(sums, fits)]


def best_path(scores, switch):
    value, back = list(scores[0]), []
    for row in scores[1:]:
        best = [max(range(len(row)), key=lambda j: (value[j] - switch * (j != k), j == k)) for k in range(len(row))]
        value = [value[j] - switch * (j != k) + row[k] for k, j in enumerate(best)]
        back.append(best)
    at = max(range(len(value)), key=lambda k: value[k])
    path = [at]
    for best in reversed(back):
        path.append(best[path[-1]])
    return path[::-1]


def test_language_scores_and_verdicts(spark, rows):
    docs = documents(spark, SF)
    model = language_id.trained(docs, language_id.Settings())
    found = {r["doc_id"]: r for r in language_id.identify_languages(docs).collect()}
    checked = 0
    for doc_id, text in rows[:120]:
        words = words_of(text, digits=False)
        if len(text or "") > 6000:
            continue
        got = language_id.score_words(model, [(text or "").lower().encode()])[0]
        scores = [language_scores(model, w) for w in words]
        assert got[:, 0].tolist() == [len(w.decode()) for w in words]
        np.testing.assert_allclose(got[:, 1:], np.array(scores).reshape(len(words), -1), atol=1e-4)
        if not words or not re.search(r"[^\W\d_]", text):
            assert found[doc_id]["lang_pred"] == "und"
            continue
        path = best_path(scores, model.settings.switch)
        letters = [sum(len(w.decode()) for w, p in zip(words, path) if p == k) for k in range(len(model.languages))]
        name = max(range(len(letters)), key=lambda k: letters[k])
        own = [sum(s[k] for s, p in zip(scores, path) if p == name) for k in range(len(letters))]
        sure = 1 / (1 + math.exp(max(-50, min(50, max(v for k, v in enumerate(own) if k != name) - own[name]))))
        assert found[doc_id]["lang_pred"] == model.languages[name]
        assert found[doc_id]["score"] == pytest.approx(letters[name] / sum(letters) * sure, abs=1e-3)
        checked += 1
    assert checked > 80


def test_letters_and_not_bytes_decide():
    """Ten Cyrillic letters weigh less than twelve Latin ones, though they are twenty bytes."""
    model = language_id.train(["привет мир это просто текст".encode() * 20, b"hello world this is plain text" * 20], ["ru", "en"])
    raw = "привет мир э this is plain text".encode()
    words = language_id.score_words(model, [raw])[0]
    path = language_id.viterbi(words[:, 1:], 1.0)
    assert words[:, 0].tolist() == [6, 3, 1, 4, 2, 5, 4] and language_id.judge(words, path, model)[0] == "en"


def test_statistics_of_quality(spark, rows):
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in rule_quality.text_statistics(table, ["doc_id"]).collect()}
    for i, (_, text) in enumerate(rows):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, chars, lines = max(1, len(words)), max(1, sum(map(len, words))), text.split("\n")
        wanted = {
            "words": math.log(1 + len(words)),
            "word_length": sum(map(len, words)) / n,
            "distinct_words": len(set(words)) / n,
            "repeats_next": sum(a == b for a, b in zip(words, words[1:])) / n,
            "symbols": len(re.findall(r"[#*$%&|<>]", text)) / chars,
            "capitals": len(re.findall("[A-Z]", text)) / chars,
            "digits": len(re.findall("[0-9]", text)) / chars,
            "marks": len(re.findall("[!?.,;:]", text)) / chars,
            "line_words": len(words) / len(lines),
            "distinct_lines": len(set(lines)) / len(lines),
        }
        assert {k: found[i][k] for k in wanted} == pytest.approx(wanted, rel=1e-12), i


def test_quality_scores(spark, rows):
    """The whole query: each score is that of the rules, one by one, over the statistics."""
    docs, marks = documents(spark, "/root/testdata/sf0.01"), labels(spark, "/root/testdata/sf0.01")
    model = rule_quality.train(*rule_quality.training_rows(docs, marks, rule_quality.Settings()))
    names = list(rule_quality.STATISTICS)
    stats = {r["doc_id"]: r for r in rule_quality.text_statistics(docs, ["doc_id"]).collect()}
    for r in rule_quality.score_quality(docs, marks).collect():
        margin = model.bias
        for rule, weight in zip(model.rules, model.weights):
            if all((stats[r["doc_id"]][names[c]] > t) == above for c, t, above in rule):
                margin += weight
        score = 1 / (1 + math.exp(-max(-30, min(30, margin))))
        assert r["score"] == pytest.approx(score, rel=1e-9) and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_toxicity_scores(spark, rows):
    docs, marks = documents(spark, SF), labels(spark, SF)
    model = toxicity.train(*toxicity.training_rows(docs, marks, toxicity.Settings()))
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, marks).collect()}
    s = model.settings
    for doc_id, text in rows[:120]:
        if len(text or "") > 6000:
            continue
        bags = [[float(model.table[b]) for b in [*buckets(w, s.sizes, s.bits), whole(w, s.bits)]] for w in words_of(text, digits=True)]
        windows = [bags[i : i + s.window] for i in range(max(1, len(bags) - s.window + 1))]
        worst = max(sum(sum(b) for b in w) / max(1, sum(len(b) for b in w)) for w in windows)
        score = 1 / (1 + math.exp(-max(-30, min(30, model.slope * worst + model.shift))))
        assert found[doc_id]["score"] == pytest.approx(score, abs=1e-4) and found[doc_id]["predicted"] == (found[doc_id]["score"] >= 0.5)


def test_odd_rows_have_defined_verdicts(spark):
    """Repeated rows agree, empty texts are alike, and other columns and the order of rows decide nothing."""
    some = spark.createDataFrame([(1, 1, 0), (8, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for query in (lambda t: language_id.identify_languages(t, with_spans=False), lambda t: rule_quality.score_quality(t, some), lambda t: toxicity.score_toxicity(t, some)):
        first, again = (sorted(map(repr, query(t).collect())) for t in (odd(spark), odd(spark).select("source", "text", "lang", "doc_id").orderBy(F.desc("text"))))
        assert first == again
        by_id = {}
        for r in query(odd(spark)).collect():
            by_id.setdefault(r["doc_id"], set()).add(tuple(r)[2:])
        assert len(by_id[10]) == 1 and by_id[3] == by_id[4] == by_id[5]


def test_samples_are_filtered_before_any_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = spark.range(100_000).selectExpr("id as doc_id", "if(id % 100 = 0, 'rare', 'hot') as lang")
        few = shared.few_by_hash(table, 50, "lang", 4)
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "xxhash64" in plan[plan.rindex("Exchange") :].split("Filter", 1)[1].split("\n")[0]
        assert dict(few.groupBy("lang").count().collect()) == {"hot": 50, "rare": 50}
        again = table.unionByName(table).repartition(5)
        assert shared.few_by_hash(again, 50, "lang", 4).groupBy("lang").count().where("count = 50").count() == 2
        with pytest.raises(ValueError):
            shared.few_by_hash(table.withColumn("lang", F.col("doc_id")), 50, "lang", 4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_toxicity_sample_is_bounded_by_whole_texts(spark):
    texts = {i: f"word{i} " * (200 if i % 7 == 0 else 3) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int")
    found, truth = toxicity.training_rows(docs, marks, toxicity.Settings(most_chars=2500))
    assert 0 < len(found) < 60 and set(t.decode() for t in found) <= set(texts.values())
    assert all(sum(len(t) for t, y in zip(found, truth) if y == k) <= 2500 for k in (0, 1))
