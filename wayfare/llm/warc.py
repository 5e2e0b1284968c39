"""A content-addressed WARC archive of DataFrames.

Payload bytes are stored once, compressed, under their SHA-256 digest; exact record
headers stand in a table of their own. Records come back by joining the two; what is
read is digested anew and must match its address, and what is told of a record is
read out of its own bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.common import small_batches, stored

CRLF = "\r\n"
END = b"\r\n\r\n"


def _urn(*parts: Column) -> Column:
    """A record id that no other record has: of its page's id and url, its address and its number among equal ones."""
    h = F.md5(F.to_json(F.array(*(p.cast("string") for p in parts))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def _lines(*lines: Column) -> Column:
    """Header lines, each ended, null ones left out, and the empty line."""
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF))


def _escaped(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one record for each row into path/payloads and path/headers.

    The payload is the text in UTF-8, empty for null. Of records with equal
    payloads of at least ``least`` bytes the one with the largest id is the
    response, others revisit it; smaller ones are all responses. Rows with null
    ids revisit too, and are responses if no row of their payload has an id; rows
    that repeat the response's id are responses, and the one with the largest url is
    referred to. Equal rows are records with ids of their own. Line ends in urls and ids are
    percent-encoded, null urls and ids have no header line; columns besides the three are ignored.
    """
    spark = pages.sparkSession
    small_batches(spark)
    kind = pages.schema[id_col].dataType.simpleString()
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("payload"))

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = zstandard.ZstdCompressor(level=3)
        for b in batches:
            raw = b.column(2).to_pylist()
            made = ([hashlib.sha256(x).hexdigest() for x in raw], [hashlib.sha1(x).hexdigest() for x in raw], list(map(len, raw)), list(map(own.compress, raw)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(m, t) for m, t in zip(made, (pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True))], names=["page_id", "url", "address", "sha1", "length", "packed"])

    # copies meet map-side first, so a payload of many pages is shuffled once for each task at most
    store = base.mapInArrow(press, f"page_id {kind}, url string, address string, sha1 string, length long, packed binary").groupBy("address")
    store = store.agg(F.max(F.struct("page_id", "url")).alias("response"), F.first("length").alias("length"), F.first("sha1").alias("sha1"), F.first("packed").alias("packed"))
    store.write.option("compression", "none").parquet(f"{path}/payloads")

    groups = spark.read.schema(store.schema).parquet(f"{path}/payloads").select("address", "response", "length", "sha1")
    # equal rows are one with a count until they have their numbers; the address of a hot payload is split when they are joined
    rows = base.select("page_id", "url", F.sha2("payload", 256).alias("address")).groupBy("page_id", "url", "address").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.join(groups.hint("merge"), "address").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    again = (F.col("length") >= least) & F.col("response.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response.page_id"))
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), F.col("length")))
    rows = rows.withColumn("again", again).withColumn("http", http)
    block = F.octet_length("http") + F.when(F.col("again"), 0).otherwise(F.col("length"))
    head = _lines(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"), F.col("url"), F.col("address"), F.col("copy"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _escaped(F.col("url"))),
        F.concat(F.lit("Page-ID: "), _escaped(F.col("page_id").cast("string"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(F.col("again"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("again"), F.concat(F.lit("WARC-Refers-To: "), _urn(F.col("response.page_id"), F.col("response.url"), F.col("address"), F.lit(1).cast("long")))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), block),
    )
    rows.select("address", F.encode(F.concat(head, F.col("http")), "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def rebuilt(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    """The bytes of each record, without payload for revisits, and the payload it stands for. batch: address, header, packed."""
    own, last, payload = zstandard.ZstdDecompressor(), None, b""
    for address, header, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if address != last:
            payload, last = own.decompress(packed), address
            if hashlib.sha256(payload).hexdigest() != address:
                raise ValueError(f"payload does not match its address {address}")
        revisit = b"\r\nWARC-Type: revisit\r\n" in header.split(END, 1)[0]
        yield header + (b"" if revisit else payload) + END, payload


def parsed(record: bytes, payload: bytes) -> tuple[str | None, str, str, str | None, int, str]:
    """(page id, record id, type, id of the record that it refers to, payload bytes, payload digest) as a record's bytes tell them."""
    head, rest = record.split(END, 1)
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    http, body = rest[: -len(END)].split(END, 1)
    length, digest = int(http.rsplit(b": ", 1)[1]), fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
    own = payload if fields[b"WARC-Type"] == b"revisit" else body
    if int(fields[b"Content-Length"]) != len(rest) - len(END) or length != len(own) or hashlib.sha1(own).hexdigest() != digest:
        raise ValueError(f"record {fields[b'WARC-Record-ID'].decode()} does not match its header")
    page, refers = fields.get(b"Page-ID"), fields.get(b"WARC-Refers-To")
    return page and page.decode(), fields[b"WARC-Record-ID"].decode(), fields[b"WARC-Type"].decode(), refers and refers.decode(), length, digest


def _joined(spark: SparkSession, path: str) -> DataFrame:
    # both sides are plain tables, so the header rows of a hot payload are split when they are joined
    payloads = spark.read.parquet(f"{path}/payloads").select("address", "packed")
    return spark.read.parquet(f"{path}/headers").join(payloads.hint("merge"), "address").select("address", "header", "packed")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, payload): the bytes of each WARC record, without payload for revisits, and the payload it stands for."""
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(zip(*rebuilt(b), strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.binary()) for m in made], names=["record", "payload"])

    return _joined(spark, path).mapInArrow(run, "record binary, payload binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): every record rebuilt and read; refers_to is the page of the record that a revisit names, which must be there."""
    small_batches(spark)
    kind = spark.read.parquet(f"{path}/payloads").schema["response"].dataType["page_id"].dataType.simpleString()
    names = ["page", "record_id", "record_type", "refers", "payload_bytes", "payload_digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            facts = list(zip(*(parsed(*r) for r in rebuilt(b)), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(facts, [pa.string()] * 4 + [pa.int64(), pa.string()], strict=True)], names=names)

    facts, _ = stored(_joined(spark, path).mapInArrow(run, "page string, record_id string, record_type string, refers string, payload_bytes long, payload_digest string"), "warc-facts")
    own = ["page", "payload_bytes", "payload_digest", "record_type"]
    named = facts.where("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page").alias("named"), F.lit(True).alias("there"))
    again = facts.where("record_type = 'revisit'").join(named.hint("merge"), "refers", "left")
    again = again.withColumn("named", F.when(F.col("there"), F.col("named")).otherwise(F.raise_error(F.concat(F.lit("no record "), F.coalesce("refers", F.lit("")))).cast("string")))
    rows = facts.where("record_type = 'response'").select(*own, F.lit(None).cast("string").alias("named")).unionByName(again.select(*own, "named"))
    return rows.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("named").cast(kind).alias("refers_to"))


#: DuckDB, over a table pages.
SQL = """
with facts as (select page_id, encode(coalesce(html, '')) as payload from pages),
sized as (select page_id, octet_length(payload)::bigint as n, sha1(payload) as digest, sha256(payload) as address from facts),
marked as (select *, max(page_id) over (partition by address) as response from sized)
select page_id, n as payload_bytes, digest as payload_digest,
  case when n >= 1000 and page_id <> response then 'revisit' else 'response' end as record_type,
  case when n >= 1000 and page_id <> response then response end as refers_to
from marked
"""
