"""WARC archives: records with revisits, and a normaliser for archives that were compressed as one gzip stream.

`write_archives` writes pages as WARC/1.1 records, one monolithic gzip stream a file. `normalise` inflates each such file
once, from front to back, rewrites every record as a gzip member of its own and in the same pass writes a sidecar file with
the offset, length and headers of each; `read_records` uses it to slice and inflate single members. All files are read and
written by Spark, so they may lie in any store that Spark reaches, and a task that is run again writes the same file. Spark
reads an archive as a whole, so archives are bounded in bytes: the uncompressed records of one are at most `FILE_BYTES`, or a
single record.

Spark's text writer puts bytes out as they are and a separator after each row. A gzip member ends with the highest byte
of its uncompressed size, which is 0 below 16 MiB, so members are written without it and with the separator NUL; a larger
record gets an empty member after it.

Defined results: null html is an empty payload, null urls give records without a target URI, and of urls just the characters
that can't stand in a header (spaces and control characters) are percent-encoded. Of equal payloads of at least `least` bytes the smallest page_id is the response; rows that
repeat that page_id are responses too. Null page_ids give records without that header, are read back as null and sort
after all others as response. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import frugal, work_folder, written

LEAST = 100
FILE_BYTES = 64 << 20
CHUNK = 1 << 18
#: Bytes of archives that a partition reads back.
READ_BYTES = 16 << 20
MOST_PARTITIONS = 1 << 16
DATE = "2024-01-01T00:00:00Z"
#: Characters of a url that can't stand in a header.
UNFIT = r"[\x00-\x20\x7f]"


def with_revisits(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """page_id, url, html, digest, size, refers_to (null for responses)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    firsts = pages.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    firsts = written(firsts, folder, "firsts")
    return pages.join(firsts, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") > F.col("first"), F.col("first"))).drop("first")


def records(pages: DataFrame) -> DataFrame:
    """The text of each record, without its last line end."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    # A space, CR, LF or other control character can't stand in a header.
    one = lambda c: F.when(c.rlike(UNFIT), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)
    uri = F.when(F.col("url").rlike(UNFIT), F.array_join(F.transform(F.split("url", ""), one), "")).otherwise(F.col("url"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block_size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))), F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
        line("WARC-Target-URI", uri), F.lit("Content-Type: application/http; msgtype=response\r\n"), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("refers_to")), F.lit("\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Length: "), block_size.cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(F.concat(head, http, F.when(revisit, F.lit("")).otherwise(F.col("html")), F.lit("\r\n")).alias("record"))


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Monolithic archives of rows from with_revisits(), in path/part=N/: each task fills one archive after the other."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = held = 0
        for batch in batches:
            sizes = pc.binary_length(batch.column("record")).to_pylist()
            parts = []
            for size in sizes:
                if held and held + size > file_bytes:
                    part, held = part + 1, 0
                held += size
                parts.append(part)
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array(parts, pa.int32())], ["record", "part"])

    dealt = records(pages).mapInArrow(frugal(deal), T.StructType.fromDDL("record string, part int"))
    dealt.write.partitionBy("part").option("compression", "gzip").option("lineSep", "\r\n").text(path)


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from the parts of an inflated stream; holds one record at a time."""
    held = bytearray()
    need = 0
    for piece in pieces:
        held += piece
        at = 0
        while True:
            if not need:
                end = held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                need = end + 4 - at + int(headers(bytes(held[at:end]))["content-length"]) + 4
            if len(held) - at < need:
                break
            yield bytes(held[at : at + need])
            at, need = at + need, 0
        del held[:at]
    if held.strip(b"\r\n"):
        raise ValueError("an archive ends within a record")


def inflated(content: memoryview) -> Iterator[bytes]:
    """Parts of a file's uncompressed stream, across members if there are several."""
    stream = zlib.decompressobj(31)
    for a in range(0, len(content), CHUNK):
        part = bytes(content[a : a + CHUNK])
        while part:
            if stream.eof:
                part = part.lstrip(b"\0")
                if not part:
                    break
                stream = zlib.decompressobj(31)
            yield stream.decompress(part)
            part = stream.unused_data
    if not stream.eof and len(content):
        raise ValueError("an archive's gzip stream is cut off")


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])} | {"": lines[0]}


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member (without time or name) that ends with a zero byte."""
    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = coder.compress(record) + coder.flush()
    if out[-1]:
        coder = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += coder.compress(b"") + coder.flush()
    return out


_INDEX = "offset long, length long, record_id string, record_type string, digest string"


def normalise(spark: SparkSession, path: str, to: str) -> None:
    """Rewrites every archive below path with a member for each record, as one file in to/kind=members/archive=NAME/, and
    writes its index, as lines of JSON, in to/kind=index/archive=NAME/."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                folder, file = name.as_py().rsplit("/", 2)[1:]
                archive = f"{file.split('.')[0]}-{folder.rpartition('=')[2]}"
                rows, size, seq, offset = [], 0, 0, 0
                for record in split_records(inflated(memoryview(content.as_buffer()))):
                    whole, h = member(record), headers(record.partition(b"\r\n\r\n")[0])
                    entry = [offset, len(whole), h["warc-record-id"], h["warc-type"], h.get("warc-payload-digest")]
                    rows += [("members", archive, seq, whole[:-1]), ("index", archive, seq, json.dumps(dict(zip(FIELDS, entry, strict=True))).encode())]
                    offset, seq, size = offset + len(whole), seq + 1, size + len(whole)
                    if size > 1 << 22:
                        yield _lines(rows)
                        rows, size = [], 0
                if rows:
                    yield _lines(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    lines = files.mapInArrow(frugal(rewrite), T.StructType.fromDDL("kind string, archive string, seq long, line binary"))
    ordered = lines.sortWithinPartitions("kind", "archive", "seq").select("kind", "archive", F.col("line").cast("string").alias("line"))
    ordered.write.partitionBy("kind", "archive").option("lineSep", "\x00").option("compression", "none").text(to)


FIELDS = [x.split()[0] for x in _INDEX.split(", ")]


def _lines(rows: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "archive", "seq", "line"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """archive, offset, length, record_id, record_type, digest of every member of normalised archives, from their sidecars."""
    lines = spark.read.option("lineSep", "\x00").text(f"{path}/kind=index")
    return lines.select(F.col("archive").cast("string").alias("archive"), F.from_json("value", _INDEX).alias("x")).select("archive", "x.*")


_RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def read_records(spark: SparkSession, path: str, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the index (rows from read_index), each inflated on its own from its member. Payloads of responses are checked against
    their digest; a revisit has the digest and length of the payload that it refers to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for content, spans in zip(batch.column("content"), batch.column("spans"), strict=True):
                view, rows, size = memoryview(content.as_buffer()), [], 0
                for span in spans.as_py():
                    record = zlib.decompressobj(31).decompress(bytes(view[span["offset"] : span["offset"] + span["length"]]))
                    head, _, block = record.partition(b"\r\n\r\n")
                    h = headers(head)
                    http, _, payload = block[: int(h["content-length"])].partition(b"\r\n\r\n")
                    digest, length = h["warc-payload-digest"].removeprefix("sha256:"), int(headers(http)["content-length"])
                    if h["warc-type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
                        raise ValueError(f"the payload of {h['warc-record-id']} doesn't have its digest")
                    rows.append((h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h.get("warc-refers-to"), digest, length, payload if with_payload and h["warc-type"] == "response" else None))
                    size += len(payload)
                    if size > 1 << 22:
                        yield _records(rows)
                        rows, size = [], 0
                if rows:
                    yield _records(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(f"{path}/kind=members")
    size = files.agg(F.sum("length")).first()[0] or 0  # from the listing; no archive is read
    parts = max(1, min(MOST_PARTITIONS, -(-size // READ_BYTES)))
    # Archives move once to meet their spans, the same at any size; no side is sorted or sent to all.
    files = files.select(F.regexp_extract("path", "archive=([^/]+)/", 1).alias("archive"), "content").repartition(parts, "archive")
    spans = index.repartition(parts, "archive").groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("spans"))  # an archive's size is bounded
    return files.join(spans.hint("shuffle_hash"), "archive").select("content", "spans").mapInArrow(frugal(read), T.StructType.fromDDL(_RECORD))


def _records(rows: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _RECORD.split(", ")])


def page_number(urn: str) -> F.Column:
    digits = F.regexp_extract(urn, r"^<urn:page:(-?\d+)>$", 1)
    return F.when(digits != "", digits.cast("long"))


def archive_round_trip(pages: DataFrame, least: int = LEAST, folder: str | None = None, with_payload: bool = False) -> DataFrame:
    """Pages written as monolithic archives, normalised with their index and read back: page_id, payload_bytes, payload_digest,
    record_type, refers_to (and the payload of responses)."""
    spark = pages.sparkSession
    folder = folder or work_folder(spark)
    write_archives(with_revisits(pages, folder, least), f"{folder}/monolithic")
    normalise(spark, f"{folder}/monolithic", f"{folder}/normalised")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    monolithic, index = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{x}") for x in ("monolithic", "normalised/kind=index"))
    monolithic.getFileSystem(conf).delete(monolithic, True)
    if index.getFileSystem(conf).exists(index):
        got = read_records(spark, f"{folder}/normalised", read_index(spark, f"{folder}/normalised"), with_payload)
    else:
        got = spark.createDataFrame([], _RECORD)
    return got.select(page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_number("refers_to").alias("refers_to"), *["payload"] * with_payload)


SQL = """
SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100 AND page_id > first THEN first END AS refers_to
FROM (SELECT page_id, html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""
