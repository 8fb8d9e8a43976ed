"""WARC archives: writing, and a normaliser of monolithic gzip files.

Writing deduplicates payloads: of records with equal payloads of at least ``least`` bytes the one with the
largest id is a response, the others are revisits of it. Each task writes archives as one gzip stream over the whole file,
the form in which many archives come. The normaliser inflates such a stream once, rewrites every record as a
gzip member of its own, and writes a sidecar index of offsets, so that any record can be read alone. Reading
goes by the index.

Every attempt of a task writes files of its own names, and a file counts only where the table of archives,
which Spark commits for one attempt, names it. So executors can be lost at any time. Files are reached by
pyarrow's file systems, in the shared folder (so it must be of a kind that both Spark and pyarrow know); a path without
a scheme is on Spark's default file system. Memory holds one record at a time and one buffer of the stream.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shared import scratch_path, written
from marlstone.shipping import ship

#: Bytes of a payload from which equal ones become revisits.
LEAST = 1000
#: Bytes read, and bytes of records after which a task begins another archive.
BUFFER = 1 << 20
ARCHIVE_BYTES = 256 << 20
#: gzip, as zlib's window bits.
GZIP = 31
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    return f"<urn:marlstone:page:{'none' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    """The page of a record id; null for none."""
    last = (name or "none").strip("<>").rpartition(":")[2]
    return None if last == "none" else int(last)


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *[f"{k}: {v}".encode() for k, v in headers.items()], f"Content-Length: {len(block)}".encode(), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """A response with its payload, or a revisit that names the response; both tell the payload's digest and length."""
    headers = {"WARC-Type": "revisit" if is_revisit else "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE}
    if url is not None:
        headers["WARC-Target-URI"] = "".join(c if c.isprintable() and not c.isspace() else "%%%02X" % ord(c) for c in url)
    headers |= {"WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(len(payload)), "Content-Type": "text/html; charset=utf-8"}
    if is_revisit:
        headers |= {"WARC-Refers-To": record_id(refers_to), "WARC-Profile": PROFILE}
    return record(headers, b"" if is_revisit else payload)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream, of one member or of many, a buffer at a time."""
    opened = zlib.decompressobj(GZIP)
    for chunk in chunks:
        while chunk:
            if opened.eof:
                opened = zlib.decompressobj(GZIP)
            out = opened.decompress(chunk, BUFFER)
            if out:
                yield out
            chunk = opened.unused_data if opened.eof else opened.unconsumed_tail
    tail = opened.flush()
    if tail:
        yield tail
    if not opened.eof:
        raise ValueError("the gzip stream ends early")


def records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from inflated bytes."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        begin = 0
        while (at := held.find(b"\r\n\r\n", begin)) >= 0:
            told = [x.split(b":", 1)[1].strip() for x in bytes(held[begin:at]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
            if len(told) != 1 or not told[0].isdigit():
                raise ValueError("a record doesn't tell its length")
            end = at + 4 + int(told[0]) + 4
            if len(held) < end:
                break
            yield bytes(held[begin:end])
            begin = end
        del held[:begin]
    if held:
        raise ValueError("the archive ends within a record")


def _chunks(source) -> Iterator[bytes]:
    while data := source.read(BUFFER):
        yield data


def located(spark: SparkSession, folder: str) -> str:
    """The folder's whole URI, by Spark's file systems, with pyarrow's name for those that Spark calls s3a or s3n."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri().toString()
    return pyarrow_uri(uri)


def pyarrow_uri(uri: str) -> str:
    scheme, _, rest = uri.partition(":")
    return f"s3:{rest}" if scheme in ("s3a", "s3n") else uri


class _Files:
    """The shared folder as executors reach it."""

    def __init__(self, root: str):
        self.system, self.root = fs.FileSystem.from_uri(root)
        self.system.create_dir(self.root, recursive=True)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def create(self, name: str):
        return self.system.open_output_stream(self.path(name), compression=None)


def write_monolithic(rows: Iterator[bytes], sink, level: int = LEVEL) -> None:
    """All records as one gzip member."""
    stream = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    for data in rows:
        sink.write(stream.compress(data))
    sink.write(stream.flush())


def normalise(source, sink, level: int = LEVEL) -> Iterator[dict]:
    """Rewrite each record of a gzip stream as a member of its own; yields its entry of the index."""
    offset = 0
    for data in records(inflated(_chunks(source))):
        packer = zlib.compressobj(level, zlib.DEFLATED, GZIP)
        member = packer.compress(data) + packer.flush()
        sink.write(member)
        headers, _ = parse_record(data)
        yield {"offset": offset, "length": len(member), "id": headers["WARC-Record-ID"], "type": headers["WARC-Type"], "digest": headers.get("WARC-Payload-Digest", "")}
        offset += len(member)


def read_member(file, entry: dict) -> tuple[dict[str, str], bytes]:
    """The record at an entry of the index."""
    file.seek(entry["offset"])
    return parse_record(zlib.decompress(file.read(entry["length"]), GZIP))


def _attempt() -> str:
    """A name of this attempt of this task."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return f"part-{task.partitionId():06d}-{task.taskAttemptId():010d}"


@dataclass(frozen=True)
class Archives:
    """A DataFrame with one row for each archive (archive, n_records), and the folder that holds them."""

    files: DataFrame
    folder: str


def _one_by_one(archives: Archives) -> DataFrame:
    """The archives' names, as many partitions as there are names: a name is small, but what it stands for is not."""
    ship(archives.files.sparkSession)
    return archives.files.select("archive").repartition(max(1, archives.files.count()))


def judged_pages(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages as page_id, url, payload, digest (SHA-1), is_revisit and refers_to.

    Payloads are equal when their SHA-256 digests and lengths are. Keys are reduced map-side before they meet, and
    only those of several records are looked up; Spark broadcasts that table below its size threshold, and
    splits very frequent keys beyond it.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    keyed = rows.withColumns({"key": F.unhex(F.sha2("payload", 256)), "size": F.octet_length("payload")})
    groups = keyed.where(F.col("size") >= least).groupBy("key", "size").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
    groups, _ = written(groups.where("n > 1").select(F.col("key").alias("__key"), "last"), "warc-payloads")
    out = keyed.join(groups, (F.col("key") == F.col("__key")) & (F.col("size") >= least), "left")
    revisit = F.coalesce(F.col("page_id") != F.col("last"), F.col("last").isNotNull())
    return out.select("page_id", "url", "payload", F.sha1("payload").alias("digest"), revisit.alias("is_revisit"), F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES, **columns: str) -> Archives:
    """Write pages(page_id, url, html) as monolithic gzip archives; see the module's text.

    A null html is an empty payload, a null url has no target, and a null id is named "none" (it never becomes
    the response of others, and is one itself where its group has no other id). Repeated rows with the largest id
    are responses alike.
    """
    spark = pages.sparkSession
    folder = located(spark, folder or scratch_path(spark, "warc"))
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, attempt, number = _Files(folder), _attempt(), 0
        rows = (tuple(v.as_py() for v in values) for batch in batches for values in zip(*batch.columns))
        row = next(rows, None)
        while row is not None:
            name, count, size = f"{attempt}-{number:06d}.mono.warc.gz", 0, 0

            def lines() -> Iterator[bytes]:
                nonlocal row, count, size
                while row is not None and (not count or size < archive_bytes):
                    page_id, url, payload, digest, is_revisit, refers_to = row
                    yield page_record(page_id, url, payload, digest, refers_to, is_revisit)
                    size, count, row = size + len(payload), count + 1, next(rows, None)

            with files.create(name) as sink:
                write_monolithic(lines(), sink)
            yield pa.RecordBatch.from_pydict({"archive": pa.array([name], pa.string()), "n_records": pa.array([count], pa.int64())})
            number += 1

    manifest = judged_pages(pages, least, **columns).mapInArrow(run, "archive string, n_records bigint")
    return Archives(written(manifest, "warc-manifest")[0], folder)


def normalise_archives(archives: Archives) -> Archives:
    """Each monolithic archive as one with a member for each record (.warc.gz) and an index (.idx, lines of JSON)."""
    folder = archives.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, attempt = _Files(folder), _attempt()
        for batch in batches:
            for name in batch.column(0).to_pylist():
                stem, count = f"{name.removesuffix('.mono.warc.gz')}-{attempt}", 0
                with files.system.open_input_stream(files.path(name), compression=None) as source, files.create(f"{stem}.warc.gz") as sink, files.create(f"{stem}.idx") as index:
                    for entry in normalise(source, sink):
                        index.write((json.dumps(entry) + "\n").encode())
                        count += 1
                yield pa.RecordBatch.from_pydict({"archive": pa.array([f"{stem}.warc.gz"], pa.string()), "n_records": pa.array([count], pa.int64())})

    return Archives(written(_one_by_one(archives).mapInArrow(run, "archive string, n_records bigint"), "warc-normalised")[0], folder)


def read_archives(archives: Archives, with_payload: bool = True) -> DataFrame:
    """One row per record, read by the index: page_id, url, record_type, payload_bytes, payload_digest, refers_to, and ``with_payload`` payload.

    A revisit's length and digest are those that its headers tell of the full payload, and its payload is null;
    a response's are computed from what was read, which must agree with its headers.
    """
    folder = archives.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder)
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * with_payload
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with files.system.open_input_file(files.path(name)) as file, files.system.open_input_stream(files.path(name.removesuffix(".warc.gz") + ".idx"), compression=None) as index:
                    for line in _lines(index):
                        headers, block = read_member(file, json.loads(line))
                        kind, told = headers["WARC-Type"], (int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:"))
                        if kind == "response" and told != (len(block), hashlib.sha1(block).hexdigest()):
                            raise ValueError(f"{name}: {headers['WARC-Record-ID']} doesn't hold the payload that it tells of")
                        rows.append((page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, *told, page_of(headers.get("WARC-Refers-To")), *[block if kind == "response" else None] * with_payload))
                        size += len(block)
                        if size >= BUFFER:
                            yield packed(rows)
                            rows, size = [], 0
                if rows:
                    yield packed(rows)

    schema = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint" + ", payload binary" * with_payload
    return _one_by_one(archives).mapInArrow(run, schema)


def _lines(stream) -> Iterator[bytes]:
    rest = b""
    for chunk in _chunks(stream):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from whole
    if rest:
        yield rest


def round_trip(pages: DataFrame, folder: str | None = None, least: int = LEAST) -> DataFrame:
    """Write, normalise and read back: page_id, payload_bytes, payload_digest, record_type, refers_to of every page.

    Extra columns are ignored; an empty table gives no archives and no rows. See write_archives for nulls and ties.
    """
    read = read_archives(normalise_archives(write_archives(pages, folder, least)), with_payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
