"""Near-duplicates: SimHash by multi-index hashing, and exact similarity of shingle sets.

A fingerprint has 64 bits; two fingerprints link when they differ in at most ``max_bits``. Texts with equal
fingerprints are one node. Fingerprints are cut into segments. Each node lies in a table under each of its
segments, and probes it with the small Hamming ball around each segment; complete distances are verified in the
join. With three segments and at most four bits, linked fingerprints differ by at most one bit in some segment, with
two by at most two bits, so the search is exact. A slot with very many entries, such as texts from one template may
share, is divided by the bits outside its segment: these are cut into one piece more than bits may differ, so linked
fingerprints agree in one of the pieces, and only nodes that share a piece are compared.

No group is expanded into all its pairs. Every slot of the table has a leader, its smallest fingerprint. First
each probe is tried against the leader it meets: at most one row for each. The components of these links are
merged, and a second join, of probes and all entries, returns only links between different ones. Components
come from alternating large-star and small-star steps over written tables. All is distributed; nothing of the
corpus reaches the driver but counts, slots that are divided (of these there are few) and filters of bounded size: other
tables are shuffled, and none is broadcast for its size in a file or by an estimate, which leaves out that rows are exploded.

The pipeline links texts by the Jaccard similarity of their sets of shingles. The first candidates are the links of
fingerprints, found as above; each is verified by the two whole sets, and no estimate is the last word. Fingerprints
of similar texts may differ in more bits, so what SimHash leaves apart is then searched exactly: texts of different
parts that share a band of minima of random functions of the shingles are candidates too, verified in the same way.
Here a slot is a band, and its leader the node whose bands are the fullest, as the original of many copies is. Texts
with equal sets are one node.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from marlstone.llm.shared import Scratch, quoted, remove, shuffled, whole_row, written
from marlstone.shipping import ship

#: Shingles whose bits are counted at once.
BLOCK = 1 << 13
#: Each byte of white space as a space.
_SPACES = bytes(32 if 9 <= b <= 13 else b for b in range(256))


@dataclass(frozen=True)
class SimHash:
    """What a fingerprint is, and when two of them link."""

    shingle: int = 4
    max_bits: int = 4
    #: None: three up to so many distinct fingerprints, two beyond, where slots of 21 bits would hold many. The links
    #: are the same ones: three need 34 probes a fingerprint, two need 530.
    segments: int | None = None
    three_segments_upto: int = 1 << 26
    #: Entries of a slot beyond which it is divided by pieces of the other bits. The links are the same ones.
    hot_slot: int = 4096
    seed: int = 42


@dataclass(frozen=True)
class Similar:
    """Two sets of shingles link when at least ``share`` (a numerator and a denominator) of their union is in both.

    A pair of similarity J shares one of the bands but with probability (1 - J ** rows) ** bands: 5 in a million at
    0.8, less above. Sets differ in at most (1 - share) / (1 + share) of the sum of their sizes, and their parities in
    no more bits than that: ``parities`` bits, each the parity of the shingles that fall to it, are compared in the
    join. For large sets the bound is what so many differences give by chance, and ``sigmas`` deviations above it.
    """

    shingle: int = 5
    share: tuple[int, int] = (4, 5)
    bands: int = 40
    rows: int = 6
    parities: int = 1024
    sigmas: float = 6.0
    #: Bits of the filter that tells which sets verification needs; an eighth of them is broadcast, in bytes.
    filter_bits: int = 24
    seed: int = 42
    #: The fingerprints whose links are the first candidates.
    simhash: SimHash = SimHash()

    @property
    def sketch(self) -> list[str]:
        """Columns with the size of the set and with the parities, 64 to a column."""
        return ["size", *[f"s{k}" for k in range(self.parities // 64)]]


#: What the pipeline links: five-word shingles and a similarity of 0.8 or more.
SIMILAR = Similar()


def _shingle_hashes(text: str | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, repeats included, in blocks; nothing without words.

    A-Z become lower case; words are runs without ASCII white space; a text of fewer words is one shingle.
    """
    joined = (text or "").encode("utf-8", "surrogatepass").lower().translate(_SPACES)
    if b"  " in joined:
        joined = re.sub(b" +", b" ", joined)
    joined = joined.strip(b" ")
    if not joined:
        return
    gaps = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    width = min(shingle, len(gaps) + 1)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(joined)]])[width - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(ends), BLOCK):
        cuts = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist())
        yield np.array([digest(joined[a:b], seed) for a, b in cuts], dtype="<u8")


def fingerprint(text: str | None, rule: SimHash = SimHash()) -> int:
    """Majority of each bit over the hashes of all word shingles, repeats included; zero without words."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for hashes in _shingle_hashes(text, rule.shingle, rule.seed):
        n += len(hashes)
        ones += np.unpackbits(hashes[:, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, rule: SimHash = SimHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and f0, the fingerprint as a signed 64-bit number, of every row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(text.as_py(), rule) for text in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "f0"])

    ship(docs.sparkSession)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, f0 bigint")


def minima(shingles: np.ndarray, rule: Similar) -> np.ndarray:
    """The least value of each of the rule's random functions over a set of shingles."""
    random = np.random.default_rng(rule.seed)
    factors, shifts = random.integers(0, 1 << 64, (2, rule.bands * rule.rows), dtype=np.uint64)
    factors, least = (factors | np.uint64(1))[:, None], np.full(rule.bands * rule.rows, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1 << 9):
        np.minimum(least, (factors * shingles[None, at : at + (1 << 9)] + shifts[:, None]).min(axis=1), out=least)
    return least


def shingle_sets(docs: DataFrame, rule: Similar = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f0 (a hash of the whole set), print (the text's fingerprint), slots (its bands), the sketch's columns, shingles (the set) of every row."""
    rows, sketch = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), rule.sketch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _few_rows(whole)):
            n, sets = batch.num_rows, []
            prints = np.array([fingerprint(text.as_py(), rule.simhash) for text in batch.column(1)], dtype=np.uint64)
            node, slots, bits = np.zeros(n, "<u8"), np.zeros((n, rule.bands), "<u8"), np.zeros((len(sketch), n), "<u8")
            for i, text in enumerate(batch.column(1)):
                sets.append(np.unique(np.concatenate([np.zeros(0, "<u8"), *_shingle_hashes(text.as_py(), rule.shingle, rule.seed)])))
                least = minima(sets[-1], rule)
                node[i] = xxhash.xxh64_intdigest(sets[-1].tobytes(), rule.seed)
                slots[i] = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(rule.bands, rule.rows))]
                odd = np.bincount((sets[-1] % np.uint64(rule.parities)).astype(np.int64), minlength=rule.parities) & 1
                bits[0, i], bits[1:, i] = len(sets[-1]), np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * rule.bands), pa.array(slots.ravel().view(np.int64)))
            ends, flat = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), np.concatenate([np.zeros(0, "<u8"), *sets])
            columns = [batch.column(0), pa.array(node.view(np.int64)), pa.array(prints.view(np.int64)), bands, *[pa.array(b.view(np.int64)) for b in bits], pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "f0", "print", "slots", *sketch, "shingles"])

    ship(docs.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, f0 bigint, print bigint, slots array<bigint>, " + "".join(f"{c} bigint, " for c in sketch) + "shingles array<bigint>")


def _few_rows(batch: pa.RecordBatch, most: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in parts, so that few sets are in memory at once."""
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


@dataclass(frozen=True)
class _Segment:
    number: int
    shift: int
    width: int

    def of(self, word: Column) -> Column:
        return F.shiftrightunsigned(word, self.shift).bitwiseAND(F.lit((1 << self.width) - 1))


def _segments(n: int) -> list[_Segment]:
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    return [_Segment(i, sum(widths[:i]), widths[i]) for i in range(n)]


def _entries(nodes: DataFrame, cut: list[_Segment]) -> DataFrame:
    """Each node once under each of its segments; slot holds the segment's number and bits."""
    return nodes.select("*", F.explode(F.array(*[s.of(F.col("f0")) + F.lit(s.number << 40) for s in cut])).alias("slot"))


def _ball(own: Column, segment: _Segment, radius: int) -> Column:
    """Slots of the ball about one segment that are not above the segment's own."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(segment.width), r)]
    around = F.transform(F.lit(masks).cast("array<bigint>"), lambda mask: own.bitwiseXOR(mask))
    return F.transform(F.filter(around, lambda y: y <= own), lambda y: y + F.lit(segment.number << 40))


def _probes(nodes: DataFrame, cut: list[_Segment], radius: int) -> DataFrame:
    """Each node under every slot of its balls that is not above its own: two slots meet from one side only."""
    return nodes.select("*", F.explode(F.concat(*[_ball(s.of(F.col("f0")), s, radius) for s in cut])).alias("slot"))


def hot_slots(nodes: DataFrame, cut: list[_Segment], most: int) -> DataFrame:
    """Slots of more than ``most`` entries of nodes(f0), as hot."""
    return _entries(nodes, cut).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col("slot").alias("hot"))


def _pieces(segment: _Segment, n: int) -> Column:
    """The bits of f0 outside the segment, cut into n pieces; each holds its number, from 1, and its bits."""
    beyond, rest = (segment.shift + segment.width) % 64, 64 - segment.width
    # Turned so that the segment's bits are the highest.
    turned = F.shiftrightunsigned("f0", beyond).bitwiseOR(F.shiftleft("f0", 64 - beyond)) if beyond else F.col("f0")
    ends = [rest * k // n for k in range(n + 1)]
    cut = [F.shiftrightunsigned(turned, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(ends, ends[1:])]
    return F.array(*[piece + F.lit((k + 1) << 40) for k, piece in enumerate(cut)])


def _divided(rows: DataFrame, hot: DataFrame, cut: list[_Segment], n: int) -> DataFrame:
    """rows(f0, slot, ...) with piece: 0, but in a slot of hot(hot) each of the n pieces of the other bits.

    Where two words differ in fewer than n bits outside a segment, one of these pieces is the same.
    """
    pieces = F.array(F.lit(0).cast("bigint"))
    for segment in cut:
        pieces = F.when(F.col("hot").isNotNull() & (F.shiftright("slot", 40) == segment.number), _pieces(segment, n)).otherwise(pieces)
    return rows.join(hot, F.col("slot") == F.col("hot"), "left").withColumn("piece", F.explode(pieces)).drop("hot")


def _distance(left: list[Column], right: list[Column]) -> Column:
    return sum((F.bit_count(a.bitwiseXOR(b)) for a, b in zip(left, right)), F.lit(0))


def _link(a: str, b: str) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def leader_links(nodes: DataFrame, rule: SimHash, cut: list[_Segment]) -> DataFrame:
    """Links (a, b) of nodes(f0, part) to leaders of the slots they probe; of a node's leaders two are enough."""
    leaders = _entries(nodes, cut).groupBy("slot").agg(F.min(F.struct(F.col("f0").alias("fb"), F.col("part").alias("pb"))).alias("l"))
    pairs = _near_pairs(_probes(nodes, cut, rule.max_bits // len(cut)), leaders.select("slot", "l.*"), ["slot"], rule)
    # They merge what the other join need not compare.
    return pairs.groupBy("a").agg(F.array_distinct(F.array(F.min("b"), F.max("b"))).alias("b")).select("a", F.explode("b").alias("b"))


def probe_links(nodes: DataFrame, rule: SimHash, cut: list[_Segment], hot: DataFrame) -> DataFrame:
    """Links (a, b) of nodes(f0, part) between different parts; slots of hot(hot) are divided."""
    n = rule.max_bits + 1
    left = _divided(_probes(nodes, cut, rule.max_bits // len(cut)), hot, cut, n)
    right = _divided(_entries(nodes, cut), hot, cut, n).withColumnsRenamed({"f0": "fb", "part": "pb"})
    return _near_pairs(left, right, ["slot", "piece"], rule)


def _near_pairs(left: DataFrame, right: DataFrame, keys: list[str], rule: SimHash) -> DataFrame:
    """Distinct pairs of left(f0, part, keys) and right(fb, pb, keys) of different parts, by complete distance."""
    left = left.select(F.col("f0").alias("fa"), F.col("part").alias("pa"), *keys)
    right = right.select("fb", "pb", *[F.col(k).alias(f"__{k}") for k in keys])
    wanted = (F.col("pa") != F.col("pb")) & (_distance([F.col("fa")], [F.col("fb")]) <= rule.max_bits)
    for key in keys:
        wanted = (F.col(key) == F.col(f"__{key}")) & wanted
    return left.join(shuffled(right), wanted).select(*_link("fa", "fb")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b): each linked node but the smallest of its component, and that smallest node, of links(a, b) with a > b."""
    spark = links.sparkSession
    state, path = written(links.distinct(), "components")
    seen = None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct()
        told = Observation()
        checked = after.observe(told, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
        state, new_path = written(checked, "components")
        remove(spark, path)
        path, now = new_path, told.get
        if now == seen:
            return state
        seen = now


def _rooted(nodes: DataFrame, key: str, roots: DataFrame, name: str) -> DataFrame:
    """nodes with ``name``: the root of column ``key``, itself where roots(a, b) has none."""
    found = roots.select(F.col("a").alias("__a"), F.col("b").alias("__b"))
    return nodes.join(shuffled(found), F.col(key) == F.col("__a"), "left").withColumn(name, F.coalesce("__b", key)).drop("__a", "__b")


def simhash_groups(docs: DataFrame, rule: SimHash = SimHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 lower-case hex digits), component_id (smallest id reachable).

    Texts that are null or without words have fingerprint zero and link like any others; very long texts are read
    whole, in blocks of shingles. Null ids count for
    nothing in component_id, which is null only where a whole component has no id. Repeated rows are in one
    component. Other columns are ignored; an empty table gives no rows.
    """
    tables = Scratch()
    rows = tables.written(fingerprints(docs, rule, id_col, text_col), "simhash-rows")
    nodes = tables.written(rows.groupBy("f0").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    parts, _ = _linked(nodes, rule, tables)
    shape = ["doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id"]
    return _placed(rows, parts, tables, shape)


def _linked(nodes: DataFrame, rule: SimHash, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """nodes(f0, ...) with part, the smallest fingerprint of the component, and the links (a, b) that make the components."""
    cut = _segments(rule.segments or (3 if nodes.count() <= rule.three_segments_upto else 2))
    parts = nodes.withColumn("part", F.col("f0"))
    led = tables.written(leader_links(parts.select("f0", "part"), rule, cut), "simhash-led")
    parts = _merged(parts, led, tables)
    hot = tables.written(hot_slots(nodes.select("f0"), cut, rule.hot_slot), "simhash-hot")
    met = tables.written(probe_links(parts.select("f0", "part"), rule, cut, hot), "simhash-met")
    return _merged(parts, met, tables), led.unionByName(met)


def simhash_pairs(nodes: DataFrame, rule: SimHash, tables: Scratch) -> DataFrame:
    """Pairs (a, b) of nodes(f0, print, size): each and the largest with its fingerprint, and the largest of linked fingerprints."""
    prints = nodes.groupBy("print").agg(F.max(F.struct("size", "f0")).alias("l")).select(F.col("print").alias("f0"), F.col("l.f0").alias("lead"))
    prints = tables.written(prints, "similar-prints")
    _, links = _linked(prints.select("f0"), rule, tables)
    of = shuffled(prints)
    between = links.join(of.toDF("a", "la"), "a").join(of.toDF("b", "lb"), "b").select(*_link("la", "lb"))
    same = nodes.select("f0", "print").join(of.toDF("print", "lead"), "print").where("f0 != lead").select(*_link("f0", "lead"))
    return between.unionByName(same).distinct()


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose nodes are in different parts."""
    of = shuffled(parts.select("f0", "part"))
    return pairs.join(of.toDF("a", "pa"), "a").join(of.toDF("b", "pb"), "b").where("pa != pb").select("a", "b")


def _placed(rows: DataFrame, parts: DataFrame, tables: Scratch, shape: list) -> DataFrame:
    """rows(doc_id, f0) with component_id, the smallest id of their part, written; the other tables go."""
    ids = tables.written(parts.groupBy("part").agg(F.min("first").alias("component_id")), "near-ids")
    found = tables.written(parts.select("f0", "part").join(shuffled(ids), "part").select("f0", "component_id"), "near-components")
    out, _ = written(rows.select("doc_id", "f0").join(shuffled(found), "f0").select(*shape), "near-groups")
    tables.clear()
    return out


def _merged(parts: DataFrame, links: DataFrame, tables: Scratch) -> DataFrame:
    """parts(f0, part, ...) with the parts of linked nodes made one."""
    of = shuffled(parts.select("f0", "part"))
    bridges = links.join(of.toDF("a", "pa"), "a").join(of.toDF("b", "pb"), "b").select(*_link("pa", "pb"))
    roots = components(bridges)
    return tables.written(_rooted(parts, "part", roots, "root").drop("part").withColumnRenamed("root", "part"), "near-parts")


def _likely(rows: DataFrame, wanted: DataFrame, bits: int) -> DataFrame:
    """Rows whose f0 may be among wanted(f0): all that are, and few others.

    A Bloom filter of one hash and 2 ** bits bits, in bitmaps of 4096 bytes: that bounds its broadcast, however
    many nodes there are. The fuller it is the more rows pass, which the joins that follow drop.
    """
    place = f"pmod(xxhash64(f0), {1 << bits}) + 1"
    maps = wanted.groupBy(F.expr(f"bitmap_bucket_number({place})").alias("__map")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({place}))").alias("__bits"))
    met = rows.join(F.broadcast(maps), F.expr(f"bitmap_bucket_number({place}) = __map"))
    at = f"cast(bitmap_bit_position({place}) as int)"
    return met.where(f"getbit(cast(conv(hex(substring(__bits, {at} div 8 + 1, 1)), 16, 10) as int), {at} % 8) = 1").drop("__map", "__bits")


def _verified(pairs: DataFrame, rows: DataFrame, rule: Similar, tables: Scratch) -> DataFrame:
    """Those of pairs(a, b) whose whole sets of shingles, in rows(f0, shingles), are similar; each with a > b."""
    pairs, path = written(pairs, "similar-pairs")
    wanted = pairs.select(F.col("a").alias("f0")).unionByName(pairs.select(F.col("b").alias("f0")))
    sets = _likely(rows.select("f0", "shingles"), wanted, rule.filter_bits).groupBy("f0").agg(F.first("shingles").alias("shingles"))
    sets, sets_path = written(sets, "similar-sets")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("f0").alias(side), F.col("shingles").alias(f"{side}_set")), side)
    both = F.size(F.array_intersect("a_set", "b_set")).cast("bigint")
    of, whole = rule.share
    # Shared against the union: both / (a + b - both) >= of / whole.
    links = pairs.where(both * (of + whole) >= (F.size("a_set").cast("bigint") + F.size("b_set")) * of).select(*_link("a", "b"))
    links = tables.written(links, "similar-links")
    for done in (path, sets_path):
        remove(rows.sparkSession, done)
    return links


def _may_link(rule: Similar) -> Column:
    """Whether sets can be similar by their sketches, in columns size, s0 and on, and with b_ before their names."""
    of, whole = rule.share
    sizes, m = F.col("size") + F.col("b_size"), float(rule.parities)
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"b_{c}"))) for c in rule.sketch[1:]), F.lit(0))
    mean = (1 - F.exp(sizes * (-2.0 * (whole - of) / (whole + of) / m))) * (m / 2)
    by_chance = mean + rule.sigmas * F.sqrt(mean * (1 - mean / m))
    return differ <= F.least(sizes * (whole - of) / (whole + of), F.ceil(by_chance))


def similar_groups(docs: DataFrame, rule: Similar = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and component_id (smallest id reachable by links of similar sets of shingles).

    Texts that are null or without words have the empty set, which is similar to itself alone; very long texts are
    read whole. Two sets exactly at the rule's share are linked. Null ids count for
    nothing in component_id, which is null only where a whole component has no id. Other columns are ignored; an
    empty table gives no rows.
    """
    tables, sketch = Scratch(), rule.sketch
    rows = tables.written(shingle_sets(docs, rule, id_col, text_col), "similar-rows")
    nodes = rows.groupBy("f0").agg(F.min("doc_id").alias("first"), F.min("print").alias("print"), F.first("slots").alias("slots"), *[F.first(c).alias(c) for c in sketch])
    nodes = tables.written(nodes, "similar-nodes")
    parts = nodes.select("f0", "first", F.col("f0").alias("part"))
    parts = _merged(parts, _verified(simhash_pairs(nodes.select("f0", "print", "size"), rule.simhash, tables), rows, rule, tables), tables)
    # The rest, by bands: only pairs of different parts are candidates.
    each = nodes.select("f0", F.explode("slots").alias("slot"))
    shared = each.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared, slots_path = written(each.join(shuffled(shared), "slot"), "similar-slots")
    full = shared.groupBy("f0").agg(F.sum("n").alias("full")).join(nodes.select("f0", *sketch), "f0")
    entries = tables.written(shared.select("f0", "slot").join(full, "f0"), "similar-entries")
    remove(docs.sparkSession, slots_path)
    ranked = entries.groupBy("slot").agg(F.max(F.struct("full", "f0", *sketch)).alias("l"))
    leaders = tables.written(ranked.select("slot", *[F.col(f"l.{c}").alias(f"b_{c}") for c in ("full", "f0", *sketch)]), "similar-leaders")
    near = _may_link(rule)
    met = entries.join(leaders, "slot").where((F.col("f0") != F.col("b_f0")) & near).groupBy("f0").agg(F.collect_set(F.struct("b_full", "b_f0")).alias("l"))
    # Of a node's leaders, at most one for each band, the three fullest: they merge what the other join need not compare.
    first = met.select(F.col("f0").alias("a"), F.explode(F.slice(F.sort_array("l", asc=False), 1, 3)).alias("l")).select("a", F.col("l.b_f0").alias("b"))
    parts = _merged(parts, _verified(_apart(first, parts), rows, rule, tables), tables)
    # A link between parts has an end outside the part of its slot's leader.
    placed = entries.join(parts.select("f0", "part"), "f0")
    led = leaders.select("slot", F.col("b_f0").alias("f0")).join(parts.select("f0", F.col("part").alias("lead")), "f0").drop("f0")
    placed = tables.written(placed.join(led, "slot"), "similar-placed")
    left = placed.where("part != lead").select("slot", "lead", "f0", *sketch, "part")
    right = placed.select("slot", *[F.col(c).alias(f"b_{c}") for c in ("f0", *sketch, "part")])
    once = (F.col("b_part") == F.col("lead")) | (F.col("f0") > F.col("b_f0"))
    rest = left.join(right, "slot").where((F.col("part") != F.col("b_part")) & once & near).select(*_link("f0", "b_f0")).distinct()
    parts = _merged(parts, _verified(rest, rows, rule, tables), tables)
    return _placed(rows, parts, tables, ["doc_id", "component_id"])


def drop_near_copies(docs: DataFrame, rule: SimHash | Similar = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are not the smallest id of their component; every column as it was.

    Null texts and texts without words are near copies of each other, and of nothing else by the rule of shingle
    sets. Rows that repeat the smallest id stay together; rows without an id always stay, as no component names
    them. Very long texts are read whole; an empty table gives no rows.
    """
    groups = (similar_groups if isinstance(rule, Similar) else simhash_groups)(docs, rule, id_col, text_col)
    gone = groups.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("gone")).distinct()
    packed = docs.select(quoted(id_col).alias("id"), whole_row(docs).alias("row"))
    return packed.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
