"""WARC archives: monolithic gzip files, and their normal form with one gzip member per record and an offset index.

``write_monolithic`` makes one gzip stream per file, as crawlers' naive writers do: Spark's text sink writes one record per row
(the record's last line feed is the row's separator), so any file system Spark can write to will do. ``normalise`` inflates
each such stream once, in chunks, and rewrites every record as a gzip member of its own, with a sidecar index next to the
archive: a JSON line per record with its id, type, offset and length. ``read`` finds records by that index alone and opens
each member by itself.

A null payload is empty, a null URL becomes ``urn:page:ID``; line breaks and blanks in a URL are percent-encoded. Rows with a null
page id get no page id header and read back as null. Of equal payloads of at least ``least`` bytes, all rows that carry the
largest page id are responses (they cannot be told apart); if no row of a group has an id, all are responses. An empty table gives
an archive without records, and no rows. Extra columns are ignored. A payload may be as long as Spark's strings can be.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import file_system
from codeloom.session import scratch_path, written

LEAST = 1000
CHUNK = 1 << 20


def record_id(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("null")), digest))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def records(pages: DataFrame, least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """A column record for each row of ``pages`` (page_id, url, html): its text without the last line feed."""
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    p = p.withColumns({"bytes": F.octet_length("payload"), "digest": F.sha1("payload")})
    # written, so that the join below has plain exchanges on both sides and splits a payload that very many pages share
    first = written(p.where(F.col("bytes") >= least).groupBy("digest", "bytes")
                    .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("rows"))
                    .where("rows > 1 and first is not null").drop("rows"), "warc-first")
    p = p.join(first, ["digest", "bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    blank = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]", "%20")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    lines = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("digest"))), F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(blank, F.concat(F.lit("urn:page:"), name))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("first"), F.col("digest")))),
        F.when(again, F.concat(F.lit("X-Refers-To-Page: "), F.col("first").cast("string"))),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return p.select(F.concat(lines, F.lit("\r\n\r\n"), block, F.lit("\r\n\r")).alias("record"))


def write_monolithic(pages: DataFrame, least: int = LEAST) -> str:
    """Write the pages' archives, each file one gzip stream; returns the folder."""
    folder = scratch_path(pages.sparkSession, "warc")
    records(pages, least).write.option("compression", "gzip").option("lineSep", "\n").text(folder)
    return folder


def inflated(source):
    """The bytes of a gzip stream of any number of members, in chunks."""
    inflate = zlib.decompressobj(31)
    while raw := source.read(CHUNK):
        while raw:
            yield inflate.decompress(raw)
            raw = inflate.unused_data
            if inflate.eof:
                inflate = zlib.decompressobj(31)


def split_records(chunks):
    """(header, rest of the record) of a stream of WARC records; holds one record at a time."""
    held = bytearray()
    chunks = iter(chunks)

    def fill(n: int) -> bool:
        while len(held) < n:
            more = next(chunks, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while True:
        seen, end = 0, -1
        while end < 0:
            end = held.find(b"\r\n\r\n", max(0, seen - 3))
            seen = len(held)
            if end < 0 and not fill(seen + 1):
                if held.strip():
                    raise ValueError("archive ends inside a record")
                return
        header = bytes(held[:end + 4])
        size = int(fields(header)["content-length"])
        whole = end + 4 + size + 4
        if not fill(whole) or held[whole - 4:whole] != b"\r\n\r\n":
            raise ValueError("record without its end")
        yield header, bytes(held[end + 4:whole])
        del held[:whole]


def fields(header: bytes) -> dict[str, str]:
    lines = header.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines if x)}


def member(record: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(record) + deflate.flush()


def normalise(spark, folder: str) -> DataFrame:
    """Rewrite all archives of ``folder``; returns the index: archive, at, length, record_id, record_type."""
    out_folder = scratch_path(spark, "warc-members")
    system, local = file_system(out_folder)
    system.create_dir(local)

    def run(batches):
        out_system, out_local = file_system(out_folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                # a name for every attempt: the index lists only those of tasks that succeed
                name = f"{path.rsplit('/', 1)[-1].split('.')[0]}-{uuid.uuid4().hex}.warc.gz"
                rows, at = [], 0
                in_system, in_local = file_system(path)
                with in_system.open_input_file(in_local) as source, out_system.open_output_stream(f"{out_local}/{name}", compression=None) as out, \
                        out_system.open_output_stream(f"{out_local}/{name}.idx", compression=None) as sidecar:
                    for header, rest in split_records(inflated(source)):
                        raw = member(header + rest)
                        out.write(raw)
                        told = fields(header)
                        row = {"archive": name, "at": at, "length": len(raw), "record_id": told["warc-record-id"],
                               "record_type": told["warc-type"]}
                        sidecar.write(json.dumps(row).encode() + b"\n")
                        rows.append(row)
                        at += len(raw)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows)

    # without the column content, only the files' names are read here
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("path")
    n = max(1, files.count())
    index = written(files.repartition(n).mapInArrow(
        run, "archive string, at long, length long, record_id string, record_type string"), "warc-index")
    return index.withColumn("archive", F.concat(F.lit(out_folder + "/"), "archive"))


def read(index: DataFrame) -> DataFrame:
    """A row per record of the index, from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's size and digest are taken from its payload, and must be what the headers say; a revisit has none, so its
    headers tell those of the payload it stands for."""
    def number(text):
        return None if text is None else int(text)

    def run(batches):
        name, source = None, None
        for batch in batches:
            rows = []
            for archive, at, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "at", "length")), strict=True):
                if archive != name:
                    if source is not None:
                        source.close()
                    system, local = file_system(archive)
                    name, source = archive, system.open_input_file(local)
                raw = zlib.decompress(source.read_at(length, at), 31)
                head, _, rest = raw.partition(b"\r\n\r\n")
                told = fields(head)
                http, _, payload = rest[:-4].partition(b"\r\n\r\n")
                digest, size = told["warc-payload-digest"].removeprefix("sha1:"), int(fields(http)["content-length"])
                if told["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest(), len(payload)) != (digest, size):
                    raise ValueError(f"damaged record {told['warc-record-id']}")
                rows.append((number(told.get("x-page-id")), size, digest, told["warc-type"], number(told.get("x-refers-to-page"))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5,
                                                (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.select("archive", "at", "length").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as d from pages),
q as (select page_id, octet_length(b)::bigint as payload_bytes, d as payload_digest, max(page_id) over (partition by d) as last from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and last <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and last <> page_id then last end as refers_to
from q
"""
