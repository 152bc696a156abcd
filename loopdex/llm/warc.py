"""WARC: write captures as request, response (or revisit) and metadata records; read archives back and assemble one
nested row per capture.

Archives are gzip files, of one member or of one a record; plain ones are read too.

Writing: of captures with equal payloads of at least ``least_bytes``, the one with the largest id is a response and
the others are revisits that refer to it, without a body; smaller ones are all responses. Groups are found on
(digest, size) alone, combined before the shuffle and joined back with a salt, so a payload that a third of all pages
share doesn't meet in one task. Files are written by Spark (its commit protocol survives lost executors), at most
RECORDS_A_FILE captures a file, and read back whole, one file in memory at a time.

Reading: records are cut by Content-Length, so payloads may hold anything, record separators included. Request and
metadata records find their captures through each of their WARC-Concurrent-To: directly, or through a request record
that names them; a record that names several captures is part of each. A record that is cut short, has no length, or
whose payload hasn't the digest it states is kept and says so in ``damage`` (short, digest), never taken for whole.

Edge cases: a null payload is empty, a null URL gives no WARC-Target-URI; rows that repeat a page (id and payload) are
written each, share their record ids and come back as one capture with copies > 1; a request or metadata record whose
capture isn't there makes a row without a response; warcinfo records belong to no capture; empty tables give no captures; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopdex.llm.common import scratch

VERSION = "WARC/1.1"
END = "\r\n\r\n"
RECORDS_A_FILE = 2000
LEAST_BYTES = 1000
SALTS = 32
RECORD = "type string, record_id string, concurrent_to array<string>, refers_to string, target_uri string, payload_bytes bigint, payload_digest string, fields map<string,string>, payload binary, damage string"


def _header(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a pair whose value is null has none."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in pairs]
    return F.concat(F.lit(f"{VERSION}\r\n"), *[F.coalesce(x, F.lit("")) for x in lines], F.lit("\r\n"))


def _size(text: Column) -> Column:
    return F.octet_length(text).cast("string")


def linked(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(id, url, payload, digest, revisit_of): revisit_of is the id of the response with the same payload, or null."""
    pages = pages.withColumns({"digest": F.sha1(F.encode("payload", "UTF-8")), "size": F.octet_length("payload")})
    same = pages.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1")
    same = same.select(F.col("digest").alias("d"), "last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    pages = pages.withColumn("salt", salt).join(same, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")), "left")
    return pages.withColumn("revisit_of", F.when(F.col("id") != F.col("last"), F.col("last"))).drop("d", "s", "salt", "last", "size")


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write pages (id, url, payload) as WARC files."""
    pages = linked(pages.withColumn("payload", F.coalesce("payload", F.lit(""))), least_bytes)
    name = lambda id_, kind: F.concat(F.lit("<urn:capture:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(f":{kind}>"))
    id_, uri = F.col("id"), F.regexp_replace("url", r"[\r\n]+", "%0A")
    revisit = F.col("revisit_of").isNotNull()
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), _size(F.col("payload")), F.lit(END))
    block = F.when(revisit, answer).otherwise(F.concat(answer, F.col("payload")))
    digest = F.concat(F.lit("sha1:"), F.col("digest"))
    main = _header(
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", name(id_, "response")),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", digest),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(revisit, name(F.col("revisit_of"), "response"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", _size(block)),
    )
    asked = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + END))
    request = _header(
        ("WARC-Type", F.lit("request")), ("WARC-Record-ID", name(id_, "request")), ("WARC-Target-URI", uri),
        ("WARC-Concurrent-To", name(id_, "response")), ("Content-Type", F.lit("application/http; msgtype=request")), ("Content-Length", _size(asked)),
    )
    notes = F.concat(F.lit("capture-id: "), F.coalesce(id_.cast("string"), F.lit("null")), F.lit("\r\npayload-bytes: "), _size(F.col("payload")), F.lit("\r\n"))
    metadata = _header(
        ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", name(id_, "metadata")), ("WARC-Target-URI", uri),
        ("WARC-Concurrent-To", name(id_, "request")), ("Content-Type", F.lit("application/warc-fields")), ("Content-Length", _size(notes)),
    )
    records = F.concat(request, asked, F.lit(END), main, block, F.lit(END), metadata, notes)
    pages.select(records.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_A_FILE).option("compression", "gzip").text(folder)


def parse(data: bytes) -> Iterator[dict]:
    """The records of one file: header names lower-cased, repeated headers as lists, the block, and whether it is short (cut
    by the end of the file, or without a length, which leaves what follows unread)."""
    at = 0
    while (start := data.find(VERSION.encode(), at)) >= 0:
        end = data.find(b"\r\n\r\n", start)
        head: dict[str, list[str]] = {}
        for line in data[start : end if end >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            head.setdefault(key.strip().lower(), []).append(value.strip())
        length = head.get("content-length", [""])[0]
        short = end < 0 or not length.isdigit()
        at = len(data) if short else end + 4 + int(length)
        yield {"head": head, "block": data[end + 4 : at] if end >= 0 else b"", "short": short or at > len(data)}


def records(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """One row a record of the archives in folder. payload_bytes and payload_digest are of the entity body read back
    (revisits: the digest the record states); without payload the bodies stay in the reading task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    keep = payload

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                rows = []
                data = content.as_py()
                for r in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    head, one = r["head"], lambda k, h=r["head"]: h.get(k, [None])[0]
                    kind, body = one("warc-type"), r["block"]
                    fields = {}
                    if kind == "metadata":
                        fields = {k.strip(): v.strip() for k, s, v in (x.partition(":") for x in body.decode("utf-8").split("\r\n")) if s}
                    elif (one("content-type") or "").startswith("application/http"):
                        body = body.partition(b"\r\n\r\n")[2]
                    stated = (one("warc-payload-digest") or "").removeprefix("sha1:")
                    digest = hashlib.sha1(body).hexdigest() if kind == "response" else stated or None
                    damage = "short" if r["short"] else "digest" if kind == "response" and stated and stated.lower() != digest and len(stated) == 40 else None
                    rows.append((kind, one("warc-record-id"), head.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), len(body), digest, list(fields.items()), body if keep else None, damage))
                names = ["type", "record_id", "concurrent_to", "refers_to", "target_uri", "payload_bytes", "payload_digest", "fields", "payload", "damage"]
                kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    return files.mapInArrow(run, RECORD)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row a capture: capture_id, copies, response, request, metadata (structs, null where missing)."""
    main = F.col("type").isin("response", "revisit", "resource")
    body = F.struct("type", "record_id", "refers_to", "target_uri", "payload_bytes", "payload_digest", "fields", "payload", "damage")
    anchors = rows.where(main).select(F.col("record_id").alias("capture_id"), body.alias("record"))
    own = F.when(F.size("concurrent_to") > 0, F.array_distinct("concurrent_to")).otherwise(F.array("record_id"))
    others = rows.where(~main & (F.col("type") != "warcinfo")).select("record_id", F.explode(own).alias("target"), body.alias("record"))
    # A record may name a request instead of the capture: one more step along the request's own links.
    hops = rows.where("type = 'request'").select(F.col("record_id").alias("hop"), F.explode("concurrent_to").alias("next")).distinct()
    others = others.join(hops, others.target == hops.hop, "left").select(F.coalesce("next", "target").alias("capture_id"), "record")

    def of(*kinds):
        is_one = F.col("record.type").isin(*kinds)
        return F.min_by(F.when(is_one, F.col("record")), F.when(is_one, F.col("record.record_id")))

    return anchors.unionByName(others).groupBy("capture_id").agg(
        F.count_if(F.col("record.type").isin("response", "revisit", "resource")).alias("copies"),
        of("response", "revisit", "resource").alias("response"), of("request").alias("request"), of("metadata").alias("metadata"),
    )


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES, payload: bool = False) -> DataFrame:
    """Write pages (id, url, payload) to new archives in the shared folder and assemble the captures read back."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    write(pages, folder, least_bytes)
    return assemble(records(spark, folder, payload))


def captured(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, from its assembled capture."""
    rows = round_trip(pages.select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload")), least_bytes)
    ids = lambda c: F.regexp_extract(c, "^<urn:capture:([^:]*):", 1).try_cast("long")
    notes = F.col("metadata.fields")
    out = rows.where("response IS NOT NULL").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        F.element_at(notes, "capture-id").try_cast("long").alias("page_id"),
        F.when(F.col("response.type") == "revisit", F.element_at(notes, "payload-bytes").cast("long")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), ids(F.col("response.refers_to")).alias("refers_to"),
    )


def sql() -> str:
    return f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN n >= {LEAST_BYTES} AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= {LEAST_BYTES} AND page_id <> last THEN last END AS refers_to FROM g"""
