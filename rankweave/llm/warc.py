"""WARC archives with revisit resolution, in DataFrame operations only.

Payload digests are shuffled without their payloads; a digest that several records share names
its response, and only those decisions return to the pages. A record is one text value (WARC
header, HTTP header, payload), and the text writer's line separator is the two CRLFs that end
a record, so Spark writes and commits the archives on any file system.

Every header starts with the archive's own id, drawn anew for each write: the reader splits
the files (each gzipped as a whole) at that line, and no payload can hold it. Lengths and digests of the payloads
read are checked against the headers. Archives of others are read by content length.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import apart, shared_path, stored, tidy

CRLF = "\r\n"
END = CRLF + CRLF
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{END}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Revisit decisions that are sent to every task; more are joined by page.
BROADCAST_REVISITS = 50_000
#: Digits of a number in base 32 and the letters that RFC 4648 gives them.
_DIGITS, _LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of binary: five hex digits make four letters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _DIGITS, _LETTERS)


def _record_id(archive: str, *of: Column) -> Column:
    h = F.sha1(F.concat_ws(":", F.lit(archive), *(F.coalesce(x.cast("string"), F.lit("null")) for x in of)))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """One header line, or nothing for a null; line breaks in a value are percent-encoded."""
    clean = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def resolve_revisits(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0, broadcast_revisits: int = BROADCAST_REVISITS) -> DataFrame:
    """pages(page_id, url, html) with payload_digest, payload_bytes, and the response that each
    repeats: first_id, first_url (both null for responses) and revisit.

    Of equal payloads of ``min_bytes`` or more, the largest page_id is the response (a null id
    is below all others); rows that repeat its id are responses as well. A null html is an empty payload;
    other columns are left out; no rows give no rows.
    """
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"), base32_sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    heads = rows.select("page_id", "url", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= min_bytes)
    key = F.xxhash64("payload_digest")
    firsts = heads.groupBy("payload_digest").agg(F.max(F.struct(F.col("page_id"), F.col("url"))).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(apart(key).alias("k"), F.col("payload_digest").alias("d"), F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"))
    again = heads.select("page_id", "payload_digest", apart(key).alias("hk")).join(firsts, (F.col("hk") == F.col("k")) & (F.col("payload_digest") == F.col("d"))).where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    again = again.select(F.col("page_id").alias("again_id"), F.col("payload_digest").alias("again_digest"), "first_id", "first_url").distinct()
    again = stored(again, "revisits")
    if again.limit(broadcast_revisits + 1).count() <= broadcast_revisits:
        again = F.broadcast(again)  # else both sides are shuffled by page
    out = rows.join(again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("payload_digest") == F.col("again_digest")), "left")
    return out.select("page_id", "url", "html", "payload_digest", "payload_bytes", F.col("again_digest").isNotNull().alias("revisit"), "first_id", "first_url")


def write_warc(resolved: DataFrame, path: str, *, date: str | None = None) -> str:
    """Write the result of :func:`resolve_revisits`; the archive id that :func:`read_warc` takes.

    Headers are fresh: the date (by default of the write), and record ids that depend on the
    archive. A response's id follows from its page and payload, so that revisits can name it
    without a join (rows that repeat such a page share it); each revisit has its own.
    """
    archive, date = f"<urn:uuid:{uuid.uuid4()}>", date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisit = F.col("revisit")
    block_bytes = F.lit(len(HTTP)) + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Warcinfo-ID: {archive}{CRLF}"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.when(revisit, _record_id(archive, F.lit("row"), F.monotonically_increasing_id())).otherwise(_record_id(archive, F.col("page_id"), F.col("payload_digest")))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        _line("WARC-Refers-To", F.when(revisit, _record_id(archive, F.col("first_id"), F.col("payload_digest")))),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, F.col("first_url"))),
        _line("WARC-Refers-To-Date", F.when(revisit, F.lit(date))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF),
        _line("Content-Length", block_bytes.cast("string")),
        F.lit(CRLF + HTTP),
        F.when(revisit, "").otherwise(F.col("html")),
    )
    resolved.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)
    return archive


def read_warc(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """The records of an archive of :func:`write_warc`, payloads checked against their headers.

    record_type, record_id, refers_to_id, page_id, url, payload (binary), payload_digest, intact.
    """
    sep = f"{END}WARC/1.1{CRLF}WARC-Warcinfo-ID: {archive}{CRLF}"
    raw = spark.read.option("lineSep", sep).text(path)
    first = sep.removeprefix(END)
    value = F.when(F.col("value").startswith(first), F.substr("value", F.lit(len(first) + 1))).otherwise(F.col("value"))
    parts = raw.select(value.alias("r")).where("r <> ''").select(F.substring_index("r", END, 1).alias("head"), "r")
    parts = parts.select(F.concat(F.lit(CRLF), "head", F.lit(CRLF)).alias("head"), F.substr("r", F.length("head") + 5).cast("binary").alias("block"))

    def header(name: str) -> Column:
        mark = f"{CRLF}{name}: "
        return F.when(F.contains("head", F.lit(mark)), F.substring_index(F.substring_index("head", mark, -1), CRLF, 1))

    length = header("Content-Length").cast("int")
    whole = F.substring(F.col("block"), F.lit(1), length)
    rows = parts.select(
        header("WARC-Type").alias("record_type"), header("WARC-Record-ID").alias("record_id"), header("WARC-Refers-To").alias("refers_to_id"),
        header("X-Page-ID").cast("long").alias("page_id"), header("WARC-Target-URI").alias("url"), F.substring(F.replace(header("WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")), 1, 32).alias("payload_digest"),
        F.substring(whole, F.lit(len(HTTP) + 1), length).alias("payload"), (F.octet_length(whole) == length).alias("complete"),
    )
    intact = F.col("complete") & ((F.col("record_type") == "revisit") | (base32_sha1(F.col("payload")) == F.col("payload_digest")))
    return rows.select("record_type", "record_id", "refers_to_id", "page_id", "url", "payload", "payload_digest", intact.alias("intact"))


def read_foreign_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of any WARC files, gzipped or not, by content length; a file is read by one task.

    record_type, record_id, refers_to_id, url, payload_digest, block (binary). After a broken
    header reading goes on at the next line that begins a record. A file is one value, which
    Spark bounds at 2 GB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_type", "record_id", "refers_to_id", "url", "payload_digest", "block"]
        keys = ["warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-payload-digest"]
        for b in batches:
            for data in b.column("content"):
                data, at, rows = data.as_py(), 0, []
                data = gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data
                while at >= 0:
                    end = data.find(b"\r\n\r\n", at) if data.startswith(b"WARC/", at) else -1
                    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at : max(at, end)].decode("utf-8", "replace").split("\r\n")[1:])}
                    size = head.get("content-length", "")
                    if size.isdigit() and (data.startswith(b"\r\n\r\n", end + 4 + int(size)) or end + 4 + int(size) == len(data)):
                        rows.append([*(head.get(k) for k in keys), data[end + 4 : end + 4 + int(size)]])
                        at = end + 8 + int(size)
                        if data.startswith(b"WARC/", at):
                            continue
                    at = data.find(b"\nWARC/", at)  # a broken header or length: on to the next record
                    at += at >= 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "block" else pa.string()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(tidy(run), "record_type string, record_id string, refers_to_id string, url string, payload_digest string, block binary")


def warc_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write all pages, read the archives back, and resolve revisits to their responses.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.
    """
    spark = pages.sparkSession
    path = path or shared_path(spark, "warc")
    archive = write_warc(resolve_revisits(pages), path)
    heads = read_warc(spark, path, archive).select("record_type", "record_id", "refers_to_id", "page_id", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"), "intact")
    responses = heads.where("record_type = 'response'")
    targets = responses.select(apart(F.xxhash64("record_id")).alias("k"), F.col("record_id").alias("to"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("bytes")).distinct()
    again = heads.where("record_type = 'revisit'").withColumn("hk", apart(F.xxhash64("refers_to_id"))).join(targets, (F.col("hk") == F.col("k")) & (F.col("refers_to_id") == F.col("to")), "left")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    return responses.withColumn("refers_to", F.lit(None).cast("long")).select(*cols).unionByName(again.select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "intact"))
