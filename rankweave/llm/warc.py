"""Web archives (WARC 1.1): written from a table, read back, and deduplicated by revisit records.

* Writing. A record is one string, its header, an HTTP header and the payload, and Spark's text writer puts records one after the
  other: task commits are Spark's, so a lost executor leaves no half archive. Files are gzip streams, one a task.
* Reading. Files are cut at the mark between records by Spark's text reader, one gzip file a task and in order; a payload that
  itself holds the mark is put together again by its Content-Length. Payloads are hashed as they pass.
* Deduplicating. Headers alone are shuffled, by payload digest: of records with equal payloads of at least `least` bytes the one with
  the smallest page id is the response, and the headers of the others join it as its revisits. Payloads do not move: a Bloom filter of
  bounded size finds the rows that may be revisits; all others are written as they are read, and only those it finds meet the revisits
  by digest and id. Fresh headers have new record ids and dates; a revisit names the response's record, address and date, and holds no payload.

Cases: a null payload is an empty one; a null address gives no target; a null page id gives no id header and counts as the
largest; rows that share payload and the smallest page id are all responses, as none of them is another page's copy;
rows that are equal throughout get equal record ids, and are records each; page ids of other types than numbers are written URL-encoded;
an empty table gives archives without records. Line breaks and blanks in an address are percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegralType, StructType

from . import bloom
from .common import bounded_batches, shared_folder, small, stored

VERSION, MARK = "WARC/1.1", b"\r\n\r\nWARC/1."
LEAST, MOST_BITS = 100, 27
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PAGE = "X-Page-Id"


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


def headers(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, digest, n_bytes, row_hash): what a record's header says; row_hash names (digest, page_id)."""
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    named = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("n_bytes"))
    return named.withColumn("row_hash", F.xxhash64("digest", "page_id"))


def record_id(digest: Column, page: Column, url: Column, kind: str) -> Column:
    """A UUID of a record's content and address, the same whenever a task runs again."""
    h = F.sha2(F.concat_ws("\n", F.lit(kind), digest, F.coalesce(page.cast("string"), F.lit("-")), F.coalesce(url, F.lit("-"))), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def originals(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """(digest, origin, origin_url) of payloads that more than one page has: the page that keeps it."""
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")
    many = heads.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min(order).alias("a"), F.max(order).alias("b"))
    repeated = ~F.col("a.page_id").eqNullSafe(F.col("b.page_id"))
    return many.where(repeated).select("digest", F.col("a.page_id").alias("origin"), F.col("a.url").alias("origin_url"))


def revisits(heads: DataFrame, least: int = LEAST) -> DataFrame:
    """Headers of records whose payload another page keeps, with that page."""
    kept = originals(heads, least)
    joined = heads.join(F.broadcast(kept) if small(kept) else kept, "digest")
    return joined.where((F.col("n_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("origin")))


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")))


def _address(url: Column) -> Column:
    for char, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(char), F.lit(code))
    return url


def _page(page: Column, number: bool) -> Column:
    return page.cast("string") if number else F.url_encode(page.cast("string"))


def _record(kind: str, fields: list[tuple[str, Column]], body: Column) -> Column:
    """A record without its last line feed, which the writer adds."""
    parts = [F.lit(f"{VERSION}\r\nWARC-Type: {kind}\r\n"), *[_field(n, v) for n, v in fields], F.lit("\r\n"), body, F.lit("\r\n\r")]
    return F.concat(*parts).alias("value")


def responses(pages: DataFrame, date: str, number: bool, key: str = "page_id", url: str = "url", payload: str = "html", digest: str = "digest") -> DataFrame:
    """Response records (value) of rows that have their digest."""
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    size = F.octet_length(raw) + len(HTTP)
    fields = [
        ("WARC-Record-ID", record_id(F.col(digest), F.col(key), F.col(url), "response")), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", _address(F.col(url))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col(digest))), (PAGE, _page(F.col(key), number)), ("Content-Type", F.lit("application/http;msgtype=response")), ("Content-Length", size.cast("string")),
    ]
    return pages.select(_record("response", fields, F.concat(F.lit(HTTP), raw.cast("string"))))


def revisit_records(found: DataFrame, date: str, number: bool) -> DataFrame:
    """Revisit records (value) of revisits(): fresh headers, and no payload."""
    fields = [
        ("WARC-Record-ID", record_id(F.col("digest"), F.col("page_id"), F.col("url"), "revisit")), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", _address(F.col("url"))),
        ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", record_id(F.col("digest"), F.col("origin"), F.col("origin_url"), "response")), ("WARC-Refers-To-Target-URI", _address(F.col("origin_url"))), ("WARC-Refers-To-Date", F.lit(date)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), (PAGE, _page(F.col("page_id"), number)), ("Content-Type", F.lit("application/http;msgtype=response")), ("Content-Length", F.lit(str(len(HTTP)))),
    ]
    return found.select(_record("revisit", fields, F.lit(HTTP)))


def write_archives(records: DataFrame, path: str, mode: str = "error") -> None:
    """Records (value) as gzip files. The text writer ends each with the line feed that its record lacks."""
    records.write.mode(mode).option("lineSep", "\n").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def write_deduplicated(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, date: str | None = None, most_bits: int = MOST_BITS) -> None:
    """Archives of all rows: responses, and revisits of payloads that another row keeps."""
    date, number = date or now(), isinstance(pages.schema[key].dataType, IntegralType)
    found = stored(revisits(stored(headers(pages, key, url, payload)), least))
    count = found.count()
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"), raw.alias("html"), F.sha2(raw, 256).alias("digest"))
    if count:
        bits = bloom.size_for(count, most_bits)
        side = stored(bloom.words(found, "row_hash", bits))
        tested = bloom.tested(rows.withColumn("row_hash", F.xxhash64("digest", "page_id")), side, bits, "row_hash", "maybe")
        # A filter holds every revisit and a few others; those are told apart by the whole digest and the id, in which no key is common.
        gone = found.select(F.col("row_hash").alias("_h"), F.col("digest").alias("_d"), F.col("page_id").alias("_p")).distinct()
        same = (F.col("row_hash") == F.col("_h")) & (F.col("digest") == F.col("_d")) & F.col("page_id").eqNullSafe(F.col("_p"))
        kept = ["page_id", "url", "html", "digest"]
        rows = tested.where(~F.col("maybe")).select(*kept).unionByName(tested.where("maybe").join(gone, same, "left_anti").select(*kept))
    write_archives(responses(rows, date, number).unionByName(revisit_records(found, date, number)), path)


FIELD = re.compile(rb"^([A-Za-z0-9-]+):[ \t]*(.*?)[ \t]*$", re.M)
READ = "record_id string, record_type string, page string, url string, date string, refers_to_record string, said_digest string, n_bytes long, digest string, whole boolean"


def fields_of(header: bytes) -> dict[bytes, bytes]:
    return {k.lower(): v for k, v in FIELD.findall(header.replace(b"\r\n", b"\n"))}


def needed(chunk: bytes) -> int | None:
    """Bytes of a record behind "WARC/1.", by its header; None where the header is not all there."""
    at = chunk.find(b"\r\n\r\n")
    size = fields_of(chunk[:at]).get(b"content-length", b"") if at >= 0 else b""
    return at + 4 + int(size) if size.isdigit() else None


def parsed(chunk: bytes, with_payload: bool) -> tuple:
    """A whole record."""
    at = chunk.find(b"\r\n\r\n")
    fields = fields_of(chunk[:at])
    block = chunk[at + 4 : needed(chunk)]
    http = fields.get(b"content-type", b"").startswith(b"application/http")
    payload = block[block.find(b"\r\n\r\n") + 4 :] if http and b"\r\n\r\n" in block else b"" if http else block
    text = lambda name: fields[name].decode("utf-8", "replace") if name in fields else None
    said = text(b"warc-payload-digest")
    digest = hashlib.sha256(payload).hexdigest()
    row = (text(b"warc-record-id"), text(b"warc-type"), text(PAGE.lower().encode()), text(b"warc-target-uri"), text(b"warc-date"), text(b"warc-refers-to"), said.split(":", 1)[-1] if said else None, len(payload), digest, True)
    return (*row, payload) if with_payload else row


def records_of(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(file, chunk) in order to records; chunks are what lies between marks, so a payload that holds marks spans several."""
    with_payload = len(schema) > 10
    unread = (*(None,) * 7, 0, None, False, *(None,) * with_payload)
    made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)] if out else [pa.array([], f.type) for f in schema], schema=schema)
    file, parts, have, need = None, [], 0, None
    for batch in batches:
        out = []
        for name, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if name != file:
                out += [unread] * bool(parts)
                file, parts, have, need = name, [], 0, None
                chunk = chunk.removeprefix(MARK[4:])
            parts += [MARK, chunk] if parts else [chunk] if chunk else []
            have += len(chunk) + len(MARK) * (len(parts) > 1)
            if parts and need is None:
                parts = [b"".join(parts)]
                need = needed(parts[0])
            if need is not None and have >= need:
                out.append(parsed(b"".join(parts), with_payload))
                parts, have, need = [], 0, None
        yield made(out)
    if parts:
        yield made([unread])


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of gzip archives: header fields, bytes and digest of the payload, and the payload if asked for.

    `whole` is false for bytes at the end of a file that are no whole record. Files must be compressed, so that a task reads one
    from its start.
    """
    bounded_batches(spark)
    kind = StructType.fromDDL(READ + (", payload binary" if with_payload else ""))
    arrow = to_arrow_schema(kind)
    chunks = spark.read.option("lineSep", MARK.decode()).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("chunk"))
    return chunks.mapInArrow(lambda batches: records_of(batches, arrow), kind)


def pages_of(records: DataFrame, kind: str) -> DataFrame:
    """Records with page_id in its own type; `kind` is that type's name."""
    number = kind in ("bigint", "int", "smallint", "tinyint")
    page = F.col("page").cast(kind) if number else F.url_decode("page").cast(kind)
    return records.withColumn("page_id", page).drop("page")


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records from pages_of(): revisits have what their response has."""
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    none = F.lit(None).cast(records.schema["page_id"].dataType)
    own = records.where("record_type = 'response'").select("page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", none.alias("refers_to"))
    again = records.where("record_type = 'revisit'").select("page_id", "refers_to_record")
    asked = again.select(F.col("refers_to_record").alias("record_id")).distinct()
    first = records.where("record_type = 'response'").join(asked, "record_id", "left_semi").groupBy("record_id").agg(F.min(F.struct("page_id", "n_bytes", "digest")).alias("r"))
    met = again.join(F.broadcast(first) if small(first) else first, F.col("refers_to_record") == F.col("record_id"), "left")
    back = met.select("page_id", F.col("r.n_bytes").alias("payload_bytes"), F.col("r.digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("r.page_id").alias("refers_to"))
    return own.select(*columns).unionByName(back)


def archive_pages(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST, path: str | None = None) -> DataFrame:
    """Write archives of `pages`, read them back, and return what they hold of each row. Without a path they go to the shared folder."""
    spark = pages.sparkSession
    path = path or folder(spark)
    write_deduplicated(pages, path, key, url, payload, least)
    kind = pages.schema[key].dataType.simpleString()
    records = stored(pages_of(read_archives(spark, path), kind))
    return resolved(records).withColumnRenamed("page_id", key)


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
