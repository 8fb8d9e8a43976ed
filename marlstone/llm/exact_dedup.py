"""Exact deduplication by skew-safe combining.

Texts are equal when identical after each run of white space became one space. The rows are combined
three times, and each time the whole normalised text is part of the key, so a digest never decides alone:

1. locally: Spark's partial aggregate reduces a map task's rows to one for each text;
2. salted: what the map tasks have left meets by (digest, salt), where the salt is the map task's number,
   so a text that fills a third of the table is spread over ``salts`` tasks;
3. globally: at most ``salts`` winners of a text meet by digest.

The winners (digest, smallest id, size) are written to the shared folder, and every row finds its winner by
digest. That join carries no text; Spark splits its large partitions where one digest is very frequent.
Digests with more than one text (counted, never assumed absent) are resolved by joining on the text too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import SPACE, quoted, whole_row, written


def normalised(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256_bytes(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def winners(rows: DataFrame, salts: int = 16) -> DataFrame:
    """One row for each content of rows(doc_id, digest, content): digest, content, keep_id, group_size."""
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "content")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    return salted.groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256_bytes,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal to each other; very long texts are compared whole. A null id never wins over another;
    where all ids of a group are null, keep_id is null and its rows are kept. Rows that repeat an id with an
    equal text are one document given several times: all count in group_size and carry the same verdict.
    Rows that repeat an id with different texts are judged apart. Other columns are ignored; an empty table
    gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("content")).withColumn("digest", digest(F.col("content")))
    best, _ = written(winners(rows, salts).withColumn("sha", F.sha2("content", 256)).select("digest", "keep_id", "group_size", "sha"), "exact-winners")
    clashing = best.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("digest")
    members = rows.select("doc_id", "digest")
    shape = [
        "doc_id",
        "keep_id",
        F.col("group_size").cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    ]
    if clashing.isEmpty():
        return members.join(best, "digest").select(*shape)
    # Texts of one digest are told apart by their content, which meets the winners' contents again.
    apart = winners(rows, salts).join(clashing, "digest", "left_semi").withColumn("sha", F.sha2("content", 256))
    alone = members.join(best.join(clashing, "digest", "left_anti"), "digest").select(*shape)
    return alone.unionByName(rows.join(apart, ["digest", "content"]).select(*shape))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """docs with one row for each text, that of the smallest id; every column as it was.

    Texts are equal as in exact_dedup: null texts count as empty, and very long ones are compared whole. Of rows that
    repeat the smallest id of their text, or of a text that has no id at all, one stays: where other columns differ
    it is chosen by a hash of the row, so reruns agree. An empty table gives no rows.
    """
    judged = exact_dedup(docs, id_col, text_col, salts)
    verdicts, _ = written(judged.select(F.col("doc_id").alias("of_id"), F.unhex("text_sha256").alias("of_sha"), "kept"), "exact-verdicts")
    repeated = verdicts.where("kept").groupBy("of_id", "of_sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    repeated, _ = written(repeated, "exact-repeated")
    packed = docs.select(quoted(id_col).alias("id"), sha256_bytes(normalised(quoted(text_col))).alias("sha"), whole_row(docs).alias("row"))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("sha") == F.col("of_sha"))
    stay = packed.join(verdicts.where(~F.col("kept")), same, "left_anti")
    if repeated.isEmpty():
        return stay.select("row.*")
    once = stay.join(repeated, same).groupBy("id", "sha").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return stay.join(repeated, same, "left_anti").select("row.*").union(once.select("row.*"))
