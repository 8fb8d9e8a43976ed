"""Mixing: targets, apportionment and selection against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from tables import empty, odd, odd_rows

from marlstone.llm import token_mix as m
from marlstone.llm.shared import documents

SF = "/root/testdata/sf0.01"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def order(sources):
    return sorted(sources, key=lambda s: (s is None, (s or "").encode("utf-32-be")))


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Fill by weight, cap, and share the excess anew until no source is above its cap."""
    names = order(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        heft = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / heft for s in names}
        above = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def brute_seats(votes, seats, most):
    won = {k: 0 for k in votes}
    for _ in range(seats):
        able = [k for k in votes if won[k] < most[k] and votes[k] > 0]
        if not able:
            break
        won[min(able, key=lambda k: ((2 * won[k] + 1) / votes[k], k))] += 1
    return won


def seeded(seed, what, *values):
    text = ":".join([f"{what}{seed}", *["null" if v is None else str(v) for v in values]])
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def brute_quotas(sizes, shards, block, most, fan_out):
    """sizes by source, and sizes of rows by shard (source, number): target by source; words, blocks and quota by shard."""
    target = brute_targets(sizes)
    words = {k: sum(v) for k, v in shards.items()}
    blocks = {k: max(int(w / block + 0.5), 1) if w else 0 for k, w in words.items()}
    names = order(sizes)
    own = {s: sum(b for k, b in blocks.items() if k[0] == s) for s in names}
    votes = {i: target[s] * own[s] / sizes[s] if sizes[s] else 0.0 for i, s in enumerate(names)}
    seats = brute_seats(votes, int(sum(votes.values()) + 0.5), {i: most * own[s] for i, s in enumerate(names)})
    quota = {}
    for i, s in enumerate(names):
        lots = {}
        for k, b in blocks.items():
            if k[0] == s:
                lots.setdefault(k[1] // fan_out, {})[k] = b
        heavy = {lot: sum(v.values()) for lot, v in lots.items()}
        for lot, n in brute_seats(heavy, seats[i], {lot: most * b for lot, b in heavy.items()}).items():
            quota |= brute_seats(lots[lot], n, {k: most * b for k, b in lots[lot].items()})
    return target, words, blocks, quota


def brute_mix(rows, block=64, shard_rows=512, fan_out=4096, seed=20, most=3):
    """rows: (id, source, size); taken by (id, source, size), in order."""
    sizes, count, alike, shards = {}, {}, {}, {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
        count[s] = count.get(s, 0) + 1
    number = {s: i + 1 for i, s in enumerate(order(sizes))}
    for r in rows:
        alike[r] = alike.get(r, -1) + 1
        part = alike[r] // shard_rows
        shards.setdefault((r[1], seeded(seed, "shard", r[0], part) % -(-count[r[1]] // shard_rows)), []).append((r, part))
    _, words, blocks, quotas = brute_quotas(sizes, {k: [r[2] for r, _ in v] for k, v in shards.items()}, block, most, fan_out)
    out = []
    for k, held in shards.items():
        lying = [r for r, _ in sorted(held, key=lambda x: (seeded(seed, "order", x[0][0]), x[0][0] is None, x[0][0] or 0, x[0][2], x[1]))]
        if not words[k]:
            out += [(*r, 0) for r in lying]
            continue
        whole, once = divmod(quotas[k], blocks[k])
        u, at, units = seeded(seed, "offset", number[k[0]], k[1]) % blocks[k], 0, 0
        # Word w covers the units from w * blocks on; block j those from j * words on.
        chosen = [((j + 1) * once + u) // blocks[k] - (j * once + u) // blocks[k] for j in range(blocks[k])]
        cut = [0]
        for w in range(words[k]):
            for unit in range(w * blocks[k], (w + 1) * blocks[k]):
                units += chosen[unit // words[k]]
            cut.append(units // blocks[k])
        for r in lying:
            out.append((*r, whole * r[2] + cut[at + r[2]] - cut[at]))
            at += r[2]
    return out


def key(rows):
    return sorted(map(repr, rows))


def test_against_brute_force(spark):
    docs = documents(spark, SF).where("doc_id < 260")
    # Rows without an id, and of one id, that are alike or not.
    again = docs.where("doc_id % 40 = 0").select(*[F.lit(None).cast("bigint").alias(c) if c == "doc_id" else c for c in docs.columns])
    docs = docs.unionByName(again).unionByName(again).unionByName(docs.where("doc_id % 50 = 0").crossJoin(spark.range(7).select()))
    rows = [(r["doc_id"], r["source"], size(r["text"])) for r in docs.collect()]
    for settings in ({}, {"block_words": 50, "shard_rows": 5, "fan_out": 3}, {"shard_rows": 2}):
        found = m.mix_sources(docs.repartition(3), **settings)
        got = [(r["doc_id"], r["source"], r["size"], r["taken"]) for r in found.collect()]
        assert key(got) == key(brute_mix(rows, settings.get("block_words", 64), settings.get("shard_rows", 512), settings.get("fan_out", 4096)))


def test_targets(spark):
    generator = random.Random(3)
    for case in range(6):
        sizes = {name: generator.choice([0, 1, 10, 1000, 10**6]) for name in ["a", "B", "ü", "漢", "z", None][: case + 1]}
        table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_rows long")
        found = {r["source"]: r["target"] for r in m.source_targets(table, (1, 2, 3), 3).collect()}
        for s, t in brute_targets(sizes).items():
            assert found[s] == pytest.approx(t, rel=1e-12)


def test_apportionment(spark):
    generator = random.Random(5)
    for case in range(8):
        votes = {i: generator.choice([0, 1, 1, 2, 7, 100, 1000]) for i in range(generator.randint(1, 12))}
        most = {i: 10**6 for i in votes}
        seats = generator.choice([0, 1, 5, 50, 500])
        table = spark.createDataFrame([(i, v, seats, most[i]) for i, v in votes.items()], "k long, votes long, seats long, most long")
        found = {r["k"]: r["won"] for r in m.sainte_lague(table, "votes", "seats", "most", [], ["k"]).collect()}
        assert found == brute_seats(votes, seats, most)


def test_capped_apportionment(spark):
    """The caps of the mix: seats of sources and shards in proportion to shares that stay below most times their blocks."""
    generator = random.Random(7)
    for _ in range(8):
        blocks = {i: generator.choice([0, 1, 2, 5, 30, 200]) for i in range(generator.randint(2, 14))}
        most = {i: 3 * b for i, b in blocks.items()}
        # Shares up to the cap itself, as of sources whose target is most times their size.
        votes = {i: b * generator.choice([0.1, 0.7, 1.0, 2.9, 3.0, 3.0]) for i, b in blocks.items()}
        seats = int(sum(votes.values()) + 0.5)
        table = spark.createDataFrame([(i, votes[i], seats, most[i]) for i in blocks], "k long, votes double, seats long, most long")
        found = {r["k"]: r["won"] for r in m.sainte_lague(table, "votes", "seats", "most", [], ["k"]).collect()}
        assert found == brute_seats(votes, seats, most) and all(found[i] <= most[i] for i in blocks)


def test_near_targets_and_reruns_agree(spark):
    docs = documents(spark, "/root/testdata/sf0.1")
    found = m.mix_sources(docs)
    first = {r["doc_id"]: (r["taken"], r["size"]) for r in found.collect()}
    again = {r["doc_id"]: (r["taken"], r["size"]) for r in m.mix_sources(docs.repartition(11)).collect()}
    assert first == again
    assert all(0 <= taken <= 3 * n for taken, n in first.values())
    for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.01)


def test_whole_documents_near_targets(spark):
    docs = documents(spark, "/root/testdata/sf0.1")
    mixed = m.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = dict(mixed.withColumn("n", m.word_count("text")).groupBy("source").agg(F.sum("n")).collect())
    for r in m.mix_sources(docs).select("source", "target").distinct().collect():
        assert got[r["source"]] == pytest.approx(r["target"], rel=0.005)
    texts = dict(docs.select("doc_id", "text").collect())
    copies = {}
    for r in mixed.collect():
        assert r["text"] == texts[r["doc_id"]]
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 3


def test_odd_rows(spark):
    found = m.mix_sources(odd(spark)).collect()
    assert len(found) == len(odd_rows())
    sizes = {}
    for r in odd_rows():
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    target = brute_targets(sizes)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
    mixed = m.mixed_documents(odd(spark))
    assert mixed.schema == odd(spark).schema and mixed.count() > 0


def test_empty(spark):
    assert m.mix_sources(empty(spark)).collect() == []
    assert m.mixed_documents(empty(spark)).collect() == []
    nothing = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r)[2:] for r in m.mix_sources(nothing).collect()) == [(0, 0, 0.0, 0)] * 2
