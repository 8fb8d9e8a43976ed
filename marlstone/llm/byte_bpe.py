"""Byte-level BPE encoding and decoding with the tiktoken library and a rank file.

The rank file is read on the driver (from a local path, or any path Spark reads) and broadcast: its size is checked.
Long texts are cut at boundaries that no match of the splitting pattern crosses and that no look-ahead sees
past, so the pieces' ids, one after the other, are the text's ids, in bounded memory.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.shipping import ship

#: The rank file of production, and the largest that is broadcast.
RANKS = "byte_bpe_multi_50k.tiktoken"
MOST_RANK_BYTES = 64 << 20
#: Code points from which a text is cut, and about how long its pieces are.
PIECE = 1 << 16

#: White space after a letter or digit. A match of the pattern has white space only at its start or in a run of
#: white space, and looks ahead only from such a run; after a letter or digit none is open, so a cut there is safe.
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}])[ \n]")


def read_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file's bytes, checked against the broadcast bound."""
    if os.path.exists(path):
        size = os.path.getsize(path)
    else:
        size = spark.read.format("binaryFile").load(path).select("length").first()[0]
    if size > MOST_RANK_BYTES:
        raise ValueError(f"{path} has {size} bytes; the most that is broadcast is {MOST_RANK_BYTES}")
    if os.path.exists(path):
        with open(path, "rb") as file:
            return file.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


_built: dict[tuple[bytes, str], tiktoken.Encoding] = {}


def encoding(ranks: bytes, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """The encoding of a rank file, built once in each process."""
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _built:
        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        _built[key] = tiktoken.Encoding("rank-file", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _built[key]


def pieces(text: str, piece: int = PIECE) -> Iterator[str]:
    """The text in parts of about ``piece`` code points, cut at safe boundaries; longer where none is near."""
    at = 0
    while len(text) - at > piece:
        cut = _SAFE.search(text, at + piece)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(enc: tiktoken.Encoding, text: str | None, piece: int = PIECE) -> np.ndarray:
    """Ids of the whole text as unsigned 32-bit numbers, without special tokens; none for null."""
    parts = [np.asarray(enc.encode_ordinary(p), dtype="<u4") for p in pieces(text or "", piece)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode(enc: tiktoken.Encoding, ids: np.ndarray, piece: int = PIECE) -> Iterator[bytes]:
    """The raw bytes of the ids, in parts; a part may end within a character."""
    for at in range(0, len(ids), piece):
        yield enc.decode_bytes(ids[at : at + piece].tolist())


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, ids (token ids; only ``with_ids``), n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty: no ids, and the digests of nothing. Very long texts are encoded whole, in pieces. Each row is taken for itself, so repeated rows
    and ids give repeated results; a null id stays null. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shipped.value)
        for batch in batches:
            all_ids, counts, digests, decoded = [], [], [], []
            for text in batch.column(1):
                ids = encode(enc, text.as_py())
                raw = hashlib.sha256()
                for part in decode(enc, ids):
                    raw.update(part)
                counts.append(len(ids))
                digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(raw.hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = {"doc_id": batch.column(0)}
            if with_ids:
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                flat = np.concatenate(all_ids) if all_ids else np.zeros(0, dtype="<u4")
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
            columns |= {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(digests, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    kind = rows.schema["doc_id"].dataType.simpleString()
    ship(spark)
    return rows.mapInArrow(run, f"doc_id {kind}, " + "ids array<int>, " * with_ids + "n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of encoded: doc_id and content, the raw bytes of its ids (empty for null).

    Each row is taken for itself, so repeated rows and null ids stay as they are; very long lists are decoded in
    parts. Other columns are ignored; an empty table gives no rows.
    """
    spark = encoded.sparkSession
    shipped = spark.sparkContext.broadcast(read_ranks(spark, ranks_path))
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(shipped.value)
        for batch in batches:
            content = [b"".join(decode(enc, np.asarray(ids.as_py() or [], dtype="<u4"))) for ids in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "content": pa.array(content, pa.binary())})

    ship(spark)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, content binary")
