"""WARC archives with revisit records.

Writing: headers (id, digest, length) are shuffled by payload digest with
map-side partial minima, the smallest id of each digest becomes the response,
the decision goes back to the pages by id, and every page becomes one record with
fresh headers.  Payloads cross the network once.  A record is a gzip member of its
own, so archives can be read from any record on.  Files end at ``FILE_BYTES``; they
are written by Spark's text sink, one row a file, whose committer works with any
file system and survives lost executors.  The line separator that the sink puts
behind a file's only row is the member of the last record's closing line breaks.

Reading: files are unpacked and parsed record by record, payload digests are
computed anew, and revisit records are joined to the responses that they refer to.

Defined results: a null payload is empty; a null or unusable url becomes a urn of
the id; ids may repeat: equal rows are separate records, of which the first is
the response; null ids are read back as null, ids of other types as that type;
an empty table gives no records; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise, scratch_path

#: Payloads from this size on are stored once.
MIN_REVISIT_BYTES = 100
#: Compressed bytes at which a file ends; readers hold a file at a time.
FILE_BYTES = 64 << 20
#: Compressed bytes that are unpacked at a time.
PIECE_BYTES = 16 << 10
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def mark_revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int) -> DataFrame:
    """id, digest, bytes, response id (null: this record is a response) for each distinct (id, digest)."""
    body = F.coalesce(F.col(payload_col), F.lit(""))
    headers = pages.select(F.col(id_col).alias("_id"), F.sha2(body, 256).alias("_digest"), F.octet_length(body).cast("long").alias("_bytes"))
    # Only digests that occur again go on: the rest needs no answer.
    shared = headers.filter(F.col("_bytes") >= min_bytes).groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    return headers.join(shared, "_digest").filter("_id is null or _id >= _first").select("_id", "_digest", "_first").distinct()


def member(data: bytes) -> bytes:
    """A gzip member, without a time."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _packer(file_bytes: int):
    """Records to files' contents: all but the last record end with END within their member, the last with the sink's separator."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda parts: pa.record_batch([pa.array([b"".join(parts)], pa.binary())], names=["value"])
        parts, held, last = [], 0, None
        for batch in batches:
            for record in batch.column(0):
                if last is not None:
                    if held >= file_bytes:
                        yield row([*parts, member(last)])
                        parts, held = [], 0
                    else:
                        parts.append(member(last + END.encode()))
                        held += len(parts[-1])
                last = record.as_buffer().to_pybytes()
        if last is not None:
            yield row([*parts, member(last)])

    return pack


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    body = F.coalesce(F.col(payload_col), F.lit(""))
    all_ = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), body.alias("_body"), F.sha2(body, 256).alias("_digest"), F.octet_length(body).cast("long").alias("_bytes"))
    # One shuffle of payloads, by id and digest, serves the join, the numbering and the files.
    key = F.concat(F.lit("page:"), F.col("_id").cast("string"))
    key = F.coalesce(key, F.lit("null"))
    again = mark_revisits(pages, id_col, payload_col, min_bytes).select(key.alias("_key"), "_digest", "_first")
    known = all_.withColumn("_key", key).join(again, ["_key", "_digest"], "left")
    # Rows of one id and digest are few; the n-th of them is told apart by its number.
    nth = F.row_number().over(Window.partitionBy("_key", "_digest").orderBy("_url"))
    known = known.withColumn("_nth", nth - 1)
    revisit = F.col("_first").isNotNull() & ~(F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_nth") == 0))
    shown = lambda i: F.coalesce(F.concat(F.lit("page:"), F.url_encode(i.cast("string"))), F.lit("null:"))
    urn = lambda i, n: F.concat(F.lit("urn:"), shown(i), F.lit(":"), n)
    own = urn(F.col("_id"), F.col("_nth").cast("string"))
    uri = F.coalesce(F.nullif(F.regexp_replace("_url", r"[\x00-\x20\x7F<>]", "_"), F.lit("")), own)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("_body")))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        _header("WARC-Record-ID", F.concat(F.lit("<"), own, F.lit(">"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", uri),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))),
        F.when(revisit, F.concat(_header("WARC-Profile", F.lit(PROFILE)), _header("WARC-Refers-To", F.concat(F.lit("<"), urn(F.col("_first"), F.lit("0")), F.lit(">"))))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    files = known.select(record.cast("binary").alias("value")).mapInArrow(_packer(file_bytes), "value binary").select(F.col("value").cast("string").alias("value"))
    # The separator's characters stand for bytes.
    files.write.option("lineSep", member(END.encode()).decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 1).text(path)


def members(content: memoryview) -> Iterator[bytes]:
    """What the gzip members of a file hold, one after the other."""
    at = 0
    while at < len(content):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(content):
                raise ValueError("a gzip member is cut off")
            # What stands behind a member is copied by the library, so it gets little at a time.
            piece = content[at : at + PIECE_BYTES]
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        yield b"".join(parts)


def parse_record(data: bytes) -> tuple[dict[str, str], memoryview]:
    """Headers (lower-case names) and block of a record, whose closing line breaks may be in the next member."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = memoryview(data)[end + 4 : end + 4 + int(head["content-length"])]
    if len(block) < int(head["content-length"]) or data[end + 4 + len(block) :] not in (b"", END.encode()):
        raise ValueError("a record's length is wrong")
    return head, block


def _id_of(urn: str | None) -> str | None:
    kind, _, rest = (urn or "<urn:null::>").strip("<>").removeprefix("urn:").partition(":")
    return rest.rpartition(":")[0] if kind == "page" else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record", "page_id", "record_type", "refers_record", "refers_to", "stated_digest", "payload_digest", "payload_bytes", "url"]
    kinds = [pa.int64() if n == "payload_bytes" else pa.string() for n in names]
    shown = lambda rows: pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=names)
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for data in members(memoryview(content.as_buffer())):
                if data == END.encode():
                    continue
                head, block = parse_record(data)
                payload = bytes(block).partition(b"\r\n\r\n")[2]
                stored = head["warc-type"] == "response"
                refers = head.get("warc-refers-to")
                rows.append(
                    (
                        head["warc-record-id"], _id_of(head["warc-record-id"]), head["warc-type"], refers, _id_of(refers), head["warc-payload-digest"].removeprefix("sha256:"),
                        hashlib.sha256(payload).hexdigest() if stored else None, len(payload) if stored else None, head["warc-target-uri"],
                    )
                )
                if len(rows) >= 4096:
                    yield shown(rows)
                    rows = []
            yield shown(rows)


def read_archives(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """One row per record, revisits resolved to the responses that they refer to: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select("content")
    parsed = files.mapInArrow(_read, "record string, page_id string, record_type string, refers_record string, refers_to string, stated_digest string, payload_digest string, payload_bytes bigint, url string")
    known = {c: F.url_decode(c).cast(id_type) for c in ("page_id", "refers_to")}
    # Archives are parsed once; what follows needs the headers only.
    records = materialise(parsed.withColumns(known), "warc-headers")
    revisits, responses = records.filter("record_type = 'revisit'"), records.filter("record_type <> 'revisit'")
    # A response that thousands refer to: the long side is small headers, which skewed joins split.
    originals = responses.select(F.col("record").alias("_r"), F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_b"))
    joined = revisits.join(originals.hint("merge"), (F.col("refers_record") == F.col("_r")) & (F.col("stated_digest") == F.col("_d")))
    resolved = joined.select("page_id", F.col("_b").alias("payload_bytes"), F.col("_d").alias("payload_digest"), "record_type", "refers_to", "url")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast(id_type).alias("refers_to"), "url").unionByName(resolved)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, id_col, url_col, payload_col)
    return read_archives(pages.sparkSession, path, pages.schema[id_col].dataType.simpleString()).withColumnRenamed("page_id", id_col)
