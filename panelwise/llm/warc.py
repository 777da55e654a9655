"""WARC archives, index first.

``archive_index`` computes, before anything is written, where every record
will be: file, offset, length, URL and payload digest. ``write_archives``
writes the records in that order through Spark's text writer with the record
terminator as line separator, so the files are plain WARC on any file system
Spark can write to. ``read_records`` takes any selection of the index, sorts
and coalesces the byte ranges, and reads one range at a time.

Records with equal payloads of at least ``LEAST_BYTES`` bytes: the one with
the largest id is a response, the others revisit it.

Defined results: a null payload is an empty one; a null URL gives a record
without target; control characters and blanks in a URL are written as %20; a
null id is never the largest, and rows that repeat the largest id are all
responses; repeated rows are repeated records; an empty table gives no
archive and no rows; other columns do not take part.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelwise.llm.common import small_batches, stored

LEAST_BYTES = 1000
FILE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
GAP_BYTES = 64 << 10
#: Fixed values of the format.
END = "\r\n\r\n"
CRLF = "\r\n"


def _facts(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    body = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"), body.alias("body"),
                        F.octet_length(body).cast("long").alias("bytes"), F.sha1(body.cast("binary")).alias("digest"))


def _typed(facts: DataFrame, keepers: DataFrame) -> DataFrame:
    """Add the id a record revisits, if any, and its headers."""
    joined = facts.join(keepers, ["digest", "bytes"], "left")
    revisits = F.col("keeper").isNotNull() & ~F.col("id").eqNullSafe(F.col("keeper"))
    return joined.withColumn("refers_to", F.when(revisits, F.col("keeper"))).drop("keeper").withColumn("head", _headers())


def _headers() -> Column:
    """WARC and HTTP headers of a record; a response's payload follows them."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    revisit = F.col("refers_to").isNotNull()
    length = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    def name(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    target = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20]", "%20"), F.lit(CRLF)))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(f"{CRLF}WARC-Record-ID: "), name("id"),
        F.lit(f"{CRLF}WARC-Date: 2024-01-01T00:00:00Z{CRLF}"), F.coalesce(target, F.lit("")), F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit(CRLF),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "WARC-Refers-To: "), name("refers_to"), F.lit(CRLF))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), length.cast("string"), F.lit(END), http)


def _record_bytes() -> Column:
    return F.octet_length("head") + F.when(F.col("refers_to").isNotNull(), F.lit(0)).otherwise(F.col("bytes"))


def archive_index(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
                  file_bytes: int = FILE_BYTES) -> tuple[DataFrame, DataFrame, int]:
    """(index, keepers, number of files): file, offset and length of every record to be written.

    Payloads are measured and digested in one scan and not shuffled.
    """
    facts = stored(_facts(pages, key, url, payload).drop("body"), "page-facts")
    keepers = stored(facts.where(F.col("bytes") >= LEAST_BYTES).groupBy("digest", "bytes").agg(F.max("id").alias("keeper"), F.count("*").alias("n"))
                     .where("n > 1").drop("n"), "payload-keepers")
    typed = _typed(facts, keepers)
    total = facts.agg(F.sum(F.col("bytes") + 512)).first()[0] or 0
    files = max(1, math.ceil(total / file_bytes))
    before = W.partitionBy("file").orderBy("id", "url", "digest").rowsBetween(W.unboundedPreceding, -1)
    placed = typed.withColumn("length", _record_bytes().cast("long")).withColumn("file", _file(files)) \
        .withColumn("offset", F.coalesce(F.sum(F.col("length") + len(END)).over(before), F.lit(0)))
    index = placed.select("id", "url", "digest", "bytes", "refers_to", "file", "offset", "length")
    return stored(index, "archive-index"), keepers, files


def _file(files: int) -> Column:
    return F.pmod(F.xxhash64("id", "url"), F.lit(files)).cast("int")


def _packed(pages: DataFrame, keepers: DataFrame, files: int, key: str, url: str, payload: str) -> DataFrame:
    """A row per record with its file; payloads are packed and headers not yet made, so that little is shuffled."""
    pack = F.udf(lambda raw: None if raw is None else zlib.compress(raw, 6), "binary", useArrow=True)
    typed = _typed(_facts(pages, key, url, payload), keepers).withColumn("file", _file(files))
    block = F.when(F.col("refers_to").isNull(), F.col("body").cast("binary"))
    return typed.select("file", "id", "url", F.unhex("digest").alias("sha1"), "bytes", "refers_to", pack(block).alias("packed"))


def _unpacked(packed: DataFrame) -> DataFrame:
    """The records of :func:`_packed` as they stand in the archives."""
    unpack = F.udf(lambda raw: None if raw is None else zlib.decompress(raw), "binary", useArrow=True)
    typed = packed.withColumn("digest", F.lower(F.hex("sha1"))).withColumn("block", unpack("packed").cast("string")).withColumn("head", _headers())
    return typed.select("file", "id", "url", "digest", F.concat("head", F.coalesce("block", F.lit(""))).alias("value"))


def write_archives(pages: DataFrame, keepers: DataFrame, files: int, folder: str, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write all records; (file, path, size) of the archives. One shuffle of the packed payloads, to their files."""
    small_batches(pages.sparkSession)
    records = _unpacked(_packed(pages, keepers, files, key, url, payload).repartition(files, "file")).sortWithinPartitions("file", "id", "url", "digest")
    records.select("file", "value").write.partitionBy("file").option("lineSep", END).text(folder)
    return pages.sparkSession.read.format("binaryFile").load(folder).select(F.col("file").cast("int").alias("file"), "path", F.col("length").alias("size"))


def _open(path: str):
    """A seekable file by URI: local or shared disks directly, other stores through Arrow's file systems."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return open(path[path.index(":") + 1:] if parts.scheme else path, "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def parse_record(raw: bytes) -> dict:
    """Type, id, target, digest and payload of one WARC record."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line[16:]) for line in http.decode().split(CRLF) if line.startswith("Content-Length: "))
    if int(fields["Content-Length"]) != len(block):
        raise ValueError("a record's length does not agree with its header")

    def number(name: str) -> int | None:
        text = fields.get(name, "")[len("<urn:page:"):-1]
        return int(text) if text else None

    revisit = fields["WARC-Type"] == "revisit"
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
        raise ValueError("a payload does not agree with its digest")
    return {"id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "payload_bytes": size,
            "payload_digest": digest, "refers_to": number("WARC-Refers-To"), "payload": None if revisit else payload}


def read_records(selected: DataFrame, archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """id, url, record_type, payload_bytes, payload_digest, refers_to (and payload) of the selected index rows, from the archives.

    Ranges with gaps up to ``GAP_BYTES`` are read together, up to about
    ``RANGE_BYTES``; ranges, not files, are the unit of work. A record whose
    bytes do not agree with its headers stops the job.
    """
    ordered = W.partitionBy("file").orderBy("offset")
    end = F.col("offset") + F.col("length")
    runs = selected.withColumn("_gap", (F.col("offset") - F.lag(end, 1, 0).over(ordered) > GAP_BYTES).cast("int")) \
        .withColumn("_run", F.sum("_gap").over(ordered)).withColumn("_part", F.floor(F.col("offset") / RANGE_BYTES))
    ranges = runs.groupBy("file", "_run", "_part").agg(
        F.min("offset").alias("start"), F.max(end).alias("stop"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("records"))
    ranges = stored(ranges.join(archives, "file").select("path", "start", "stop", "records"), "byte-ranges")
    tasks = max(1, min(20_000, ranges.count()))
    columns = ["id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *(["payload"] if with_payload else [])]
    schema = "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if with_payload else "")
    arrow = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if with_payload else [])])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["path"]) as source:
                    source.seek(row["start"])
                    data = source.read(row["stop"] - row["start"])
                found = [parse_record(data[r["offset"] - row["start"]:r["offset"] - row["start"] + r["length"]]) for r in row["records"]]
                yield pa.RecordBatch.from_pylist([{c: x[c] for c in columns} for x in found], schema=arrow)

    return ranges.repartition(tasks, "path", "start").mapInArrow(read, schema)
