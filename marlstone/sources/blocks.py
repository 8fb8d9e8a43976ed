"""Binary files as fixed-size blocks, and their checksums."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.checksum import block_order, checksum_blocks
from marlstone.shipping import ship

#: The largest block: what one read() returns at most.
MOST_BLOCK = 2_147_479_552


def _checked(block_size: int) -> int:
    if not 0 < block_size <= MOST_BLOCK:
        raise ValueError(f"a block has 1 to {MOST_BLOCK} bytes, not {block_size}")
    return block_size


def blocks(spark: SparkSession, path: str, block_size: int) -> DataFrame:
    """path, block (from 0) and data of each block of the files, of up to 2 GB each; the last one filled up with zero bytes."""
    count = F.ceil(F.col("length") / F.lit(_checked(block_size))).cast("int")
    # The blocks are cut before they become rows, so that no row but the file's own carries its content.
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.rpad(F.substring(F.col("content"), i * block_size + 1, F.lit(block_size)), block_size, F.lit(b"\0")))
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.select("path", F.posexplode(cut).alias("block", "data")).withColumn("block", F.col("block").cast("bigint"))


def checksums(spark: SparkSession, path: str, block_size: int) -> DataFrame:
    """For each file path, order ("sequential" or "alternating"), crc64 (16 hex digits) and blocks.

    The fold goes through a file's blocks one after the other, files side by side. Spark lists no empty files.
    """
    _checked(block_size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                n = -(-len(content) // block_size)
                for name, alternating in (("sequential", False), ("alternating", True)):
                    crc, count = checksum_blocks((content[i * block_size : (i + 1) * block_size] for i in block_order(n, alternating)), block_size)
                    rows.append((path, name, f"{crc:016x}", count))
            yield pd.DataFrame(rows, columns=["path", "order", "crc64", "blocks"])

    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, order string, crc64 string, blocks bigint")
