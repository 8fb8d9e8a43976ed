"""The pipeline, stage by stage, against brute force on a small table."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tables import empty, odd
from test_exact_dedup import brute as exact_brute
from test_near_dup import brute_similar
from test_quality_rules import brute_estimates, failed, statistics
from test_token_mix import brute_quotas, seeded, size

import corpus_pipeline
from marlstone.llm import byte_bpe, quality_rules, queries
from marlstone.llm.shared import documents, written

SF = "/root/testdata/sf0.001"


def table(spark):
    """Two sources of one language: groups large enough for estimates. Copies and near copies besides."""
    docs = documents(spark, "/root/testdata/sf0.01").where("lang = 'en'").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "x").otherwise("y"))
    copies = docs.where("doc_id % 9 = 0").withColumn("doc_id", F.col("doc_id") + 10_000)
    near = docs.where("doc_id % 11 = 0 AND n_chars > 1500").withColumn("doc_id", F.col("doc_id") + 20_000).withColumn("text", F.concat("text", F.lit(" added words")))
    return docs.unionByName(copies).unionByName(near)


def brute_quality(rows, spark):
    rules = quality_rules.Rules()
    stats = {r["doc_id"]: statistics(r["text"]) for r in rows}
    kept = [r for r in rows if not failed(stats[r["doc_id"]])]
    frame = spark.createDataFrame(kept, documents(spark, SF).schema)
    vectors = quality_rules.with_vectors(quality_rules.text_statistics(frame, rules), rules).toPandas()
    good = set()
    for _, group in vectors.groupby(["lang", "source"]):
        assert len(group) >= rules.min_group
        d2 = brute_estimates(group[[f"z{i}" for i in range(5)]].to_numpy(dtype=float), rules)
        good |= {i for i, d in zip(group.doc_id, d2) if d <= rules.cutoff}
    return [r for r in kept if r["doc_id"] in good]


def brute_near(rows):
    stay = set(brute_similar([(r["doc_id"], r["text"]) for r in rows]))
    return [r for r in rows if r["doc_id"] in stay]


def brute_mixed(rows, spark, block=64, shard_rows=512, seed=20):
    hashes = dict(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").select("doc_id", F.xxhash64("text")).collect())
    sizes, count, shards, out = {}, {}, {}, []
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
        count[r["source"]] = count.get(r["source"], 0) + 1
    for r in rows:
        n_shards = -(-count[r["source"]] // shard_rows)
        shards.setdefault((r["source"], seeded(seed, "shard", r["doc_id"], hashes[r["doc_id"]]) % n_shards), []).append(r)
    target, _, blocks, quotas = brute_quotas(sizes, {k: [size(r["text"]) for r in v] for k, v in shards.items()}, block, 3, 4096)
    for k, held in shards.items():
        share, left = Fraction(quotas[k], blocks[k]), Fraction(0)
        for r in sorted(held, key=lambda r: (-size(r["text"]), seeded(seed, "order", r["doc_id"], hashes[r["doc_id"]]))):
            n = size(r["text"])
            copies = min(3, max(0, math.floor(share + left / n + Fraction(1, 2))))
            left += (share - copies) * n
            out += [r] * copies
    for s in sizes:
        assert abs(sum(size(r["text"]) for r in out if r["source"] == s) - target[s]) <= 0.01 * target[s]
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_stages_against_brute_force(spark):
    docs = written(table(spark), "pipeline-test")[0]
    rows = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "exact_dedup", "near_dup", "token_mix", "byte_bpe"]
    for name, brute in (("quality_rules", lambda r: brute_quality(r, spark)), ("exact_dedup", lambda r: [x for x, b in zip(r, exact_brute([(y["doc_id"], y["text"]) for y in r])) if b[3]]), ("near_dup", brute_near), ("token_mix", lambda r: brute_mixed(r, spark))):
        out = written(stages[name](spark, docs, SF), f"test-{name}")[0]
        assert out.columns == docs.columns
        wanted = brute(rows)
        assert ids(out.collect()) == ids(wanted), name
        assert name == "token_mix" or len(wanted) < len(rows)
        docs, rows = out, out.collect()
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as file:
        enc = byte_bpe.encoding(file.read())
    tokens = stages["byte_bpe"](spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in tokens) == sorted((r["doc_id"], hashlib.sha256(np.asarray(enc.encode_ordinary(r["text"]), "<u4").tobytes()).hexdigest()) for r in rows)


def test_run_is_its_stages(spark):
    docs = documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"run-{name}")[0]
    assert sorted(map(repr, docs.collect())) == sorted(map(repr, queries.pipeline(spark, SF).collect()))
    assert corpus_pipeline.ORACLE_SQL is None


def test_odd_and_empty_tables(spark):
    for make in (odd, empty):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, SF), f"odd-{name}")[0]
            assert docs.schema == make(spark).schema
            # Each stage on the whole odd table too, not only on what the others leave.
            stage(spark, make(spark), SF).collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
