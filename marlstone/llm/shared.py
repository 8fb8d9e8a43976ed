"""What the training-data operators have in common: white space, written tables, training splits."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A run of white space, and the same characters as a list for trim().
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: SPACE_CHARS as a SQL string; SQL strings have no escape for the form feed but its number.
SPACE_SQL = r"' \t\n\u000B\u000C\r'"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The session names it in spark.checkpoint.dir. Only a session without that setting gets one from
    here: a temporary folder where driver and executors are one process, else the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        named = "file://" + tempfile.mkdtemp(prefix="marlstone-")
    else:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_marlstone"
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when this Python process ends in good order."""
    root = f"{shared_dir(spark)}/marlstone-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove_quietly, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


_roots: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def lowered(column: pa.Array) -> list[bytes]:
    """Lower-cased UTF-8 of a batch's texts; empty for null."""
    return [b"" if t is None else t.encode() for t in pc.utf8_lower(column).to_pylist()]


def _remove_quietly(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            remove(spark, path)
        except Exception:  # the JVM may have ended before this process
            pass


def written(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, reread, with its path; ``codec`` "zstd" makes tables of texts small.

    It cuts the lineage and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path), path


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides, whatever Spark estimates.

    The estimates know neither how many rows an explode makes nor how well a file is compressed; a table that
    they take for a small one is collected by the driver to be broadcast.
    """
    return df.hint("merge")


class Scratch:
    """Written tables of one computation, all removed together once its result is written."""

    def __init__(self) -> None:
        self._paths: list[tuple[SparkSession, str]] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        table, path = written(df, name)
        self._paths.append((df.sparkSession, path))
        return table

    def clear(self) -> None:
        while self._paths:
            remove(*self._paths.pop())


def word_array(text: str) -> str:
    """SQL for the words of the string expression ``text``: the runs without white space."""
    trimmed = f"trim(BOTH {SPACE_SQL} FROM coalesce({text}, ''))"
    return rf"filter(split({trimmed}, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def word_count(text: Column | str) -> Column:
    """Number of words, 0 for null: each word becomes one letter, and the white space goes."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.length(F.regexp_replace(F.regexp_replace(col, r"[^\x20\x09-\x0D]+", "x"), SPACE, "")).cast("bigint")


def quoted(name: str) -> Column:
    """The column of this very name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(df: DataFrame) -> Column:
    """All columns as a struct, so that an operator's own columns clash with none; ``select("name.*")`` gives them back."""
    return F.struct(*[quoted(c) for c in df.columns])


def few_by_hash(df: DataFrame, most: int, group: str | None = None, most_groups: int = 1, id_col: str = "doc_id") -> DataFrame:
    """A bounded sample of the distinct rows of df(id, group): of each group the ``most`` ids with the smallest hashes.

    The groups, none of them null and at most ``most_groups``, are counted. A threshold on the hash, a filter in the
    scan's own stage, leaves about four times ``most`` rows of each (fewer where rows repeat), so that only those are shuffled and ranked, however
    large a group is.
    """
    keys = [group] if group else []
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).limit(most_groups + 1).collect()
    if len(sizes) > most_groups:
        raise ValueError(f"more than {most_groups} values of {group}: a sample of each has no bound")
    place = F.shiftrightunsigned(F.xxhash64(id_col), 11) * F.lit(2.0**-53)
    limits = [(F.col(group) == F.lit(r[0]) if group else F.lit(True), 4.0 * most / max(r["n"], 1)) for r in sizes]
    near = df.where(reduce(lambda a, b: a | b, [which & (place < F.lit(limit)) for which, limit in limits], F.lit(False))).distinct()
    ranked = Window.partitionBy(*keys).orderBy(F.xxhash64(id_col), id_col, *[c for c in df.columns if c not in (*keys, id_col)])
    return near.withColumn("__nth", F.row_number().over(ranked)).where(F.col("__nth") <= most).drop("__nth")


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; remainder 0 is held out from training. Null ids are never trained on."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where the fold is 0, and for a null id."""
    return F.coalesce(fold_of(doc_id) == 0, F.lit(True))
