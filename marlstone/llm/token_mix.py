"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets. Sources in code point order (null last) weigh 1, 2, 3 repeating and share all words by weight;
   no target passes ``max_repeat`` times its source's words, and what it leaves is reshared by weight
   (water-filling, solved in closed form over the sorted ratios).
2. Seats. Each source's words are cut into blocks of about ``block_words``. The seats, as many as there are
   blocks in all, go to sources by highest quotients target / (2 k + 1).
3. Shards. A source's rows are dealt to shards of about ``shard_rows`` rows by a hash. The source's seats go to
   groups of ``fan_out`` shards, and a group's to its shards, by highest quotients blocks / (2 k + 1), so that
   no task ranks the quotients of all shards of a large source.
4. Selection. In each shard the rows lie in the order of a seeded hash, and its words are cut into equal
   blocks. A shard with q seats and n blocks takes every block q div n times, and q mod n blocks once more:
   those where floor((j q' + u) / n) steps up, with a seeded offset u. So no block row is ever made: how many
   selected words precede a word is arithmetic, and a row takes the difference over its own words.

No block is taken more than ``max_repeat`` times, so no document exceeds that multiple of its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import whole_row, word_count, written

#: Hex digits of md5 that order rows and choose shards; DuckDB has the same function.
_HEX = 15


def seeded(seed: int, what: str, *cols: str) -> Column:
    """A whole number of 60 bits from the seed and the columns, null as a word of its own."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{what}{seed}"), *parts)), 1, _HEX), 16, 10).cast("bigint")


def source_targets(sources: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """sources(source, source_size, ...) with weight, and target: the share of all words, by water-filling.

    A few numbers for each source; the global windows run over that table alone.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("__nth", F.row_number().over(in_order)).withColumn(
        "weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("__nth") - 1, F.lit(len(weights))) + 1).cast("int")).cast("bigint")
    )
    most = F.lit(max_repeat) * F.col("source_size")
    ratio = most / F.col("weight")
    by_ratio = Window.orderBy(ratio.asc(), F.col("__nth"))
    upto, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(most).over(upto), F.lit(0))) / F.sum("weight").over(after)
    # Sources whose ratio is below their level are full; the first that is not gives the rate of all the others.
    levels = weighed.withColumn("__level", level).withColumn("__rank", F.row_number().over(by_ratio))
    first_open = F.min_by("__level", F.when(ratio >= F.col("__level"), F.col("__rank"))).over(every)
    return (
        levels.withColumn("__rate", first_open)
        .withColumn("target", F.least(most.cast("double"), F.col("__rate") * F.col("weight")))
        .drop("__level", "__rank", "__rate")
    )


def sainte_lague(parties: DataFrame, votes: str, seats: str, most: str, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """parties with ``won``: the seats that highest quotients votes / (2 k + 1) give within each group.

    ``seats`` holds the group's number of seats on every row, ``most`` what a party can take, ``order`` (a key
    within the group, without nulls) breaks ties. Each party first gets the seats that are certain, then the
    quotients about the margin are ranked: about five for each party, whatever the number of seats.
    """
    inside = Window.partitionBy(*group)
    total, count = F.sum(votes).over(inside), F.count(F.lit(1)).over(inside)
    share = F.when(total > 0, F.col(votes) / total).otherwise(F.lit(0.0))
    # The final rate gives each party its share of between seats - parties / 2 and seats + parties / 2.
    low = F.floor(F.greatest(share * (F.col(seats) - count) - 0.5, F.lit(0.0)))
    high = F.ceil(share * (F.col(seats) + count) + 1.5)
    sure = parties.withColumns({"__low": F.least(low, F.col(most)).cast("bigint"), "__high": F.least(high, F.col(most)).cast("bigint")})
    sure = sure.withColumn("__left", (F.col(seats) - F.sum("__low").over(inside)).cast("bigint"))
    keys = [*group, *order]
    margin = sure.where((F.col("__high") > F.col("__low")) & (F.col(votes) > 0)).select(
        *keys, "__left", F.explode(F.sequence(F.col("__low"), F.col("__high") - 1)).alias("__k"), F.col(votes).alias("__votes")
    )
    ranked = Window.partitionBy(*group).orderBy(((2 * F.col("__k") + 1) / F.col("__votes")).asc(), *order)
    extra = margin.withColumn("__rank", F.row_number().over(ranked)).where(F.col("__rank") <= F.col("__left")).groupBy(*keys).agg(F.count(F.lit(1)).alias("__extra"))
    return (
        sure.join(extra, keys, "left")
        .withColumn("won", F.col("__low") + F.coalesce(F.col("__extra"), F.lit(0)))
        .drop("__low", "__high", "__left", "__extra")
    )


def _placed(rows: DataFrame, aimed: DataFrame) -> DataFrame:
    """rows(source, __deal, ...) with __nth, the source's number, and __shard, by the hash __deal."""
    right = aimed.select(F.col("source").alias("__s"), "__nth", "n_shards")
    placed = rows.join(right, F.col("source").eqNullSafe(F.col("__s")))
    return placed.withColumn("__shard", F.pmod(F.col("__deal"), F.col("n_shards"))).drop("__s", "n_shards", "__deal")


def shard_quotas(rows: DataFrame, weights: Sequence[int], max_repeat: int, block_words: int, shard_rows: int, fan_out: int) -> tuple[DataFrame, DataFrame]:
    """Of rows(source, size, n, __deal), each standing for n rows: the sources with their targets, and the shards with blocks and quota."""
    words = F.sum(F.col("size") * F.col("n"))
    sources = rows.groupBy("source").agg(words.alias("source_size"), F.sum("n").alias("n_rows"))
    aimed = source_targets(sources, weights, max_repeat)
    aimed, _ = written(aimed.withColumn("n_shards", F.ceil(F.col("n_rows") / F.lit(shard_rows)).cast("bigint")), "mix-targets")

    shards = _placed(rows, aimed).groupBy("__nth", "__shard").agg(words.alias("words"))
    blocks = F.when(F.col("words") > 0, F.greatest(F.round(F.col("words") / F.lit(block_words)), F.lit(1))).otherwise(F.lit(0))
    shards = shards.withColumn("blocks", blocks.cast("bigint")).withColumn("__lot", F.floor(F.col("__shard") / fan_out).cast("bigint"))
    shards, _ = written(shards, "mix-shards")
    # A source's seats are blocks of its own, so a seat is worth its own words; none takes more than max_repeat times its blocks.
    own, most = F.sum("blocks").alias("blocks"), F.col("blocks") * F.lit(max_repeat)
    votes = aimed.join(shards.groupBy("__nth").agg(own), "__nth").withColumn("most", most)
    votes = votes.withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(F.lit(0.0)))
    votes = votes.withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy())).cast("bigint"))
    seated = sainte_lague(votes, "votes", "seats", "most", [], ["__nth"]).select("__nth", F.col("won").alias("seats"))
    lots = shards.groupBy("__nth", "__lot").agg(own).join(seated, "__nth").withColumn("most", most)
    lots = sainte_lague(lots, "blocks", "seats", "most", ["__nth"], ["__lot"]).select("__nth", "__lot", F.col("won").alias("seats"))
    parts = shards.join(written(lots, "mix-lots")[0], ["__nth", "__lot"]).withColumn("most", most)
    parts = sainte_lague(parts, "blocks", "seats", "most", ["__nth", "__lot"], ["__shard"])
    quotas, _ = written(parts.select("__nth", "__shard", "words", "blocks", F.col("won").alias("quota")), "mix-quotas")
    return aimed, quotas


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    max_repeat: int = 3,
    block_words: int = 64,
    shard_rows: int = 512,
    fan_out: int = 4096,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken (words, repeats counted).

    Null texts and texts without words have size 0 and take 0 words; of a very long text, as of any other, whole
    blocks and parts of blocks are taken. A null source is a source of its own, the last. A null id is an id of its
    own. Rows of one source, id and size are alike; they are counted first and dealt in parts of at most
    ``shard_rows``, so none of them meet in one task however many there are, and they share their source's words
    like any others. Other columns are ignored; an empty table gives no rows. Reruns agree: hashes of seed and id,
    and sizes, give the order.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    # Parts of at most shard_rows rows alike, numbered __part; n is how many rows a part has.
    alike = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("__rows"))
    alike = alike.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__rows") - 1) / shard_rows))))
    alike = alike.withColumn("n", F.least(F.lit(shard_rows).cast("bigint"), F.col("__rows") - F.col("__part") * shard_rows)).drop("__rows")
    rows, _ = written(alike, "mix-sizes")
    rows = rows.withColumn("__deal", seeded(seed, "shard", "doc_id", "__part"))
    aimed, quotas = shard_quotas(rows, weights, max_repeat, block_words, shard_rows, fan_out)
    lying = Window.partitionBy("__nth", "__shard").orderBy("__at", F.col("doc_id").asc_nulls_last(), "size", "__part").rowsBetween(Window.unboundedPreceding, 0)
    dealt = _placed(rows, aimed).withColumn("__at", seeded(seed, "order", "doc_id")).withColumn("__end", F.sum(F.col("size") * F.col("n")).over(lying))
    # The n rows of a part lie side by side.
    dealt = dealt.withColumn("__after", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).withColumn("__end", F.expr("__end - __after * size"))
    dealt = dealt.join(quotas.where("blocks > 0"), ["__nth", "__shard"], "left")
    dealt = dealt.withColumn("__u", F.pmod(seeded(seed, "offset", "__nth", "__shard"), F.col("blocks")))
    taken = F.expr(f"size * (quota div blocks) + {selected_before('__end')} - {selected_before('(__end - size)')}")
    dealt = dealt.withColumn("taken", F.coalesce(taken, F.lit(0)).cast("bigint"))
    return dealt.join(aimed.select("__nth", "source_size", "target"), "__nth").select("doc_id", "source", "size", "source_size", "target", "taken")


def selected_before(at: str) -> str:
    """SQL: words selected once more among the first ``at`` of a shard.

    In units of 1 / blocks of a word every block is exactly ``words`` units long, so block and place within it
    are integer arithmetic; the selected units, rounded down to words, grow by 0 or 1 from word to word.
    """
    block = f"({at} * blocks) div words"
    upto = f"(({block}) * (quota % blocks) + __u) div blocks"
    this = f"((({block}) + 1) * (quota % blocks) + __u) div blocks - {upto}"
    return f"((({upto}) * words + (({at} * blocks) % words) * ({this})) div blocks)"


def mixed_documents(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeat: int = 3, block_words: int = 64, shard_rows: int = 512, fan_out: int = 4096, seed: int = 20
) -> DataFrame:
    """docs(doc_id, text, source, ...) as the mix gives them: each row as often as it is taken, whole, every column as it was.

    The same targets, seats and quotas as mix_sources, but no text is cut, very long ones neither: in each shard
    the rows are gone through from the largest on, and each is taken as often, up to ``max_repeat`` times, as
    comes nearest to its share and what the rows before it have left over or taken too much. So a shard ends about
    half a smallest text off its quota. A source whose words lie in a few texts meets its target only as near as
    their sizes allow.

    Null texts and texts without words are taken as often as their shard's quota has it, rounded, and not where
    their shard has no words at all. A null source is a source of its own; rows with null or repeated ids are dealt
    by their texts' hash too. Rows that repeat id and text are taken each for itself, and lie in one shard. An
    empty table gives no rows. Reruns agree.
    """
    named = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("__hash"))
    rows, _ = written(named, "mix-sizes")

    def dealt(frame: DataFrame) -> DataFrame:
        return frame.withColumn("__deal", seeded(seed, "shard", "doc_id", "__hash"))

    aimed, quotas = shard_quotas(dealt(rows).withColumn("n", F.lit(1).cast("bigint")), weights, max_repeat, block_words, shard_rows, fan_out)
    able = quotas.where("blocks > 0").select("__nth", "__shard", "quota", "blocks")
    # In units of 1 / blocks of a word all is integer arithmetic.
    taken = f"least({max_repeat}, greatest(0, 2 * (quota * x + a.left) + blocks * x) div (2 * blocks * x))"
    step = f"transform(array(if(x = 0, least({max_repeat}, (2 * quota + blocks) div (2 * blocks)), {taken})), k -> named_struct('left', a.left + (quota - k * blocks) * x, 'k', concat(a.k, array(cast(k as int)))))[0]"
    copies = F.expr(f"aggregate(sizes, named_struct('left', 0L, 'k', cast(array() as array<int>)), (a, x) -> {step}, a -> a.k)")
    sizes = _placed(dealt(rows), aimed).groupBy("__nth", "__shard").agg(F.sort_array(F.collect_list("size"), asc=False).alias("sizes"))
    chosen, _ = written(sizes.join(able, ["__nth", "__shard"]).select("__nth", "__shard", copies.alias("__copies")), "mix-copies")

    whole = dealt(docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("__hash"), whole_row(docs).alias("__row")))
    lying = Window.partitionBy("__nth", "__shard").orderBy(F.col("size").desc(), seeded(seed, "order", "doc_id", "__hash"), F.col("doc_id").asc_nulls_last(), "__hash")
    placed = _placed(whole, aimed).withColumn("__i", F.row_number().over(lying)).join(chosen, ["__nth", "__shard"])
    taken_rows = placed.withColumn("__n", F.get("__copies", F.col("__i") - 1)).where("__n > 0")
    return taken_rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy")).select("__row.*")


def duckdb_sql(block_words: int = 64, shard_rows: int = 512, fan_out: int = 4096, seed: int = 20) -> str:
    """mix_sources with weights 1, 2, 3 and at most three repeats, in DuckDB: every quotient is ranked, none is skipped."""

    def hashed(what: str, *columns: str) -> str:
        parts = " || ':' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'null')" for c in columns)
        return f"CAST('0x' || substr(md5('{what}{seed}:' || {parts}), 1, {_HEX}) AS BIGINT)"

    def before(at: str) -> str:
        block = f"(({at} * blocks) // words)"
        upto = f"(({block} * (quota % blocks) + u) // blocks)"
        return f"(({upto} * words + (({at} * blocks) % words) * ((({block} + 1) * (quota % blocks) + u) // blocks - {upto})) // blocks)"

    return rf"""
WITH d AS (
  SELECT doc_id, source, size, (row_number() OVER (PARTITION BY doc_id, source, size) - 1) // {shard_rows} AS part
  FROM (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents)
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_rows, row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM d GROUP BY source
), w AS (
  SELECT *, 1 + (nth - 1) % 3 AS weight, (3 * source_size) / (1 + (nth - 1) % 3) AS ratio FROM s
), l AS (
  SELECT *, row_number() OVER (ORDER BY ratio, nth) AS place,
    CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(weight) OVER (ORDER BY ratio, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w
), t AS (
  SELECT *, least(CAST(3 * source_size AS DOUBLE), (SELECT level FROM l WHERE ratio >= level ORDER BY place LIMIT 1) * weight) AS target,
    CAST(ceil(n_rows / {shard_rows}) AS BIGINT) AS n_shards FROM l
), p AS (
  SELECT d.*, nth, source_size, target, {hashed("shard", "doc_id", "part")} % n_shards AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), h AS (
  SELECT nth, shard, words, CASE WHEN words > 0 THEN greatest(CAST(round(words / {block_words}) AS BIGINT), 1) ELSE 0 END AS blocks
  FROM (SELECT nth, shard, CAST(sum(size) AS BIGINT) AS words FROM p GROUP BY nth, shard)
), v AS (
  SELECT nth, o.blocks, CASE WHEN source_size > 0 THEN target * o.blocks / source_size ELSE 0 END AS votes
  FROM t JOIN (SELECT nth, CAST(sum(blocks) AS BIGINT) AS blocks FROM h GROUP BY nth) o USING (nth)
), q AS (
  SELECT nth, (2 * k + 1) / votes AS cost FROM (SELECT nth, votes, unnest(range(0, 3 * blocks)) AS k FROM v WHERE votes > 0)
), seat AS (
  SELECT nth, count(*) AS seats FROM (SELECT nth, row_number() OVER (ORDER BY cost, nth) AS place FROM q)
  WHERE place <= (SELECT round(sum(votes)) FROM v) GROUP BY nth
), part AS (
  SELECT nth, lot, (2 * k + 1) / blocks AS cost
  FROM (SELECT nth, lot, blocks, unnest(range(0, 3 * blocks)) AS k FROM (SELECT nth, shard // {fan_out} AS lot, CAST(sum(blocks) AS BIGINT) AS blocks FROM h GROUP BY nth, lot) WHERE blocks > 0)
), given AS (
  SELECT nth, lot, count(*) AS seats FROM (SELECT nth, lot, row_number() OVER (PARTITION BY nth ORDER BY cost, lot) AS place FROM part) JOIN seat USING (nth)
  WHERE place <= seats GROUP BY nth, lot
), deal AS (
  SELECT nth, shard, shard // {fan_out} AS lot, (2 * k + 1) / blocks AS cost FROM (SELECT nth, shard, blocks, unnest(range(0, 3 * blocks)) AS k FROM h WHERE blocks > 0)
), won AS (
  SELECT nth, shard, count(*) AS quota
  FROM (SELECT nth, shard, lot, row_number() OVER (PARTITION BY nth, lot ORDER BY cost, shard) AS place FROM deal) JOIN given USING (nth, lot)
  WHERE place <= seats GROUP BY nth, shard
), x AS (
  SELECT p.*, h.words, h.blocks, coalesce(won.quota, 0) AS quota, {hashed("offset", "p.nth", "p.shard")} % greatest(h.blocks, 1) AS u,
    CAST(sum(size) OVER (PARTITION BY p.nth, p.shard ORDER BY {hashed("order", "doc_id")}, doc_id NULLS LAST, size, part ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM p JOIN h ON p.nth = h.nth AND p.shard = h.shard LEFT JOIN won ON p.nth = won.nth AND p.shard = won.shard
)
SELECT doc_id, source, size, source_size, target,
  CAST(CASE WHEN words > 0 THEN size * (quota // blocks) + {before("upto")} - {before("(upto - size)")} ELSE 0 END AS BIGINT) AS taken
FROM x
"""
