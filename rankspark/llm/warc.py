"""WARC archives: writing captures and assembling them again (operator 2).

Spark's text writer makes the archive files: a row is one WARC record, the line separator is the
blank lines that end a record, and a file is one gzip stream. Reading takes each file whole (the
writer bounds its records), parses records by their declared length, and joins request, capture
(response or revisit) and metadata records through WARC-Concurrent-To into one nested row.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark.llm.common import materialize, shared_dir

#: Equal payloads of at least so many bytes are stored once.
MIN_REVISIT_BYTES = 1000
#: Records of a file at most, and the bytes of payload it should hold, about: the counted mean size
#: of a page decides which of the two binds.
RECORDS_PER_FILE = 12_000
FILE_BYTES = 64 * 2**20
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

NULL_ID = -(2**63)


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.lit(kind), *[p.cast("string") for p in parts]))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def _record(kind: Column, ident: Column, date: str, uri: Column, headers: list[tuple[str, Column]], content_type: Column, block: Column) -> Column:
    lines = [F.concat(F.lit(f"{VERSION}\r\nWARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), ident), F.lit(f"WARC-Date: {date}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in [("WARC-Target-URI", uri), *headers, ("Content-Type", content_type), ("Content-Length", F.octet_length(block).cast("string"))]]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def archive_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Three records (request, response or revisit, metadata) for every row of ``pages``, as a
    text column ``value`` without the blank lines that end a record."""
    pid = F.coalesce(F.col("page_id"), F.lit(NULL_ID))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumns(
        {"pid": pid, "size": F.octet_length("payload"), "sha": F.sha1("payload"), "check": F.xxhash64("payload")}
    )
    key = ["size", "sha", "check"]
    narrow = rows.where(F.col("size") >= min_bytes).select("pid", *key)
    keepers = narrow.groupBy(*key).agg(F.max("pid").alias("keeper"), F.min("pid").alias("lowest")).where("lowest < keeper")
    revisits = narrow.join(keepers, key).where("pid < keeper").select("pid", "sha", "keeper").distinct()
    rows = rows.join(revisits, ["pid", "sha"], "left")
    # rows that repeat a page and its payload get ids of their own
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("pid", "sha").orderBy("url")))
    uri = F.regexp_replace("url", "[\r\n]", "%0A")
    ident = _urn("capture", F.col("pid"), F.col("sha"), F.col("copy"))
    digest = F.concat(F.lit("sha1:"), F.col("sha"))
    again = F.col("keeper").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    host, path = F.coalesce(F.try_parse_url(uri, F.lit("HOST")), F.lit("")), F.coalesce(F.nullif(F.try_parse_url(uri, F.lit("FILE")), F.lit("")), F.lit("/"))
    request = _record(
        F.lit("request"), _urn("request", F.col("pid"), F.col("sha"), F.col("copy")), date, uri, [("WARC-Concurrent-To", ident)],
        F.lit("application/http; msgtype=request"), F.concat(F.lit("GET "), path, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")),
    )
    capture = _record(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")), ident, date, uri,
        [("WARC-Payload-Digest", digest), ("WARC-Profile", F.when(again, F.lit(REVISIT_PROFILE))), ("WARC-Refers-To", F.when(again, _urn("capture", F.col("keeper"), F.col("sha"), F.lit(1))))],
        F.lit("application/http; msgtype=response"), F.concat(http, F.when(again, F.lit("")).otherwise(F.col("payload"))),
    )
    metadata = _record(
        F.lit("metadata"), _urn("metadata", F.col("pid"), F.col("sha"), F.col("copy")), date, uri, [("WARC-Concurrent-To", ident)],
        F.lit("application/warc-fields"), F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")),
    )
    return rows.select(F.explode(F.array(request, capture, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, **options) -> None:
    """Write the pages' records as gzip-compressed WARC files under ``path``. A file holds at most
    ``records_per_file`` records, fewer if the pages' mean size asks for it."""
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    records_per_file = max(3, min(records_per_file, int(3 * FILE_BYTES / max(1, mean))))
    writer = archive_records(pages, **options).write.option("lineSep", RECORD_END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", records_per_file).text(path)


_PARSED = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, declared_digest string, payload_digest string, payload_bytes long, fields string"


def parse_records(raw: bytes):
    """(headers with lower-case names, block) of every record; a truncated record is an error."""
    at = 0
    while at < len(raw):
        head = raw.find(b"\r\n\r\n", at)
        if head < 0 or not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = raw[at:head].decode().split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        block = raw[head + 4: head + 4 + size]
        at = head + 4 + size + 4
        if len(block) != size or raw[at - 4: at] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield headers, block


def _parse(with_payload: bool):
    def run(batches):
        import gzip
        import hashlib

        names = ["warc-record-id", "warc-type", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date"]
        for b in batches:
            for content in b.column(0):
                rows: list[list] = [[] for _ in range(10 + with_payload)]
                for headers, block in parse_records(gzip.decompress(content.as_buffer())):
                    kind = headers.get("warc-type")
                    values = [headers.get(n) for n in names]
                    declared = (headers.get("warc-payload-digest") or "").removeprefix("sha1:") or None
                    digest = size = fields = payload = None
                    if kind in ("response", "revisit"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                        else:
                            said = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                            digest, size, payload = declared, int(said[0]) if said else None, None
                    elif kind == "metadata":
                        fields = block.decode()
                    for column, value in zip(rows, [*values, declared, digest, size, fields, *([payload] if with_payload else [])], strict=True):
                        column.append(value)
                arrays = [pa.array(x, pa.int64() if j == 8 else pa.binary() if j == 10 else pa.string()) for j, x in enumerate(rows)]
                yield pa.record_batch(arrays, names=[x.split()[0] for x in _PARSED.split(", ")] + ["payload"] * with_payload)

    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives under ``path``. Payload digest and size are computed
    from a response's payload; a revisit's are those it declares."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse(with_payload), _PARSED + (", payload binary" if with_payload else ""))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, target_uri, date, capture (type, digests, size,
    refers_to, payload if read), request and metadata (lists of the records concurrent to it,
    empty if none). Records concurrent to no capture are left out."""
    captures = records.where("type IN ('response', 'revisit')")
    inner = [c for c in ("type", "declared_digest", "payload_digest", "payload_bytes", "refers_to", "payload") if c in records.columns]
    joined = captures.select(F.col("record_id").alias("capture_id"), "target_uri", "date", F.struct(*inner).alias("capture"))
    for kind, keep in (("request", ["record_id", "target_uri"]), ("metadata", ["record_id", "fields"])):
        side = records.where(F.col("type") == kind).groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.sort_array(F.collect_list(F.struct(*keep))).alias(kind))
        joined = joined.join(side, "capture_id", "left")
    return joined


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Archive ``pages`` (page_id, url, html; other columns are ignored) and read the captures
    back: page_id, payload_bytes, payload_digest, record_type, refers_to, request_uri (of the request
    concurrent to the capture) and metadata_fields per row.

    The archives are read and parsed once; the parsed records, without payloads, are stored and
    assembled.

    Of equal payloads of at least MIN_REVISIT_BYTES the largest page_id is the response and the
    others revisit it. Null html is an empty payload; a null page_id counts as the smallest; rows
    that repeat a page_id with the same payload are responses both; no rows give no rows.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    records = materialize(read_records(spark, path), "warc-records")
    fields = F.get("metadata", F.lit(0))["fields"]
    captures = materialize(assemble(records).select(
        "capture_id", "capture.*", F.regexp_extract(fields, r"pageId: (-?\d+)", 1).try_cast("long").alias("page_id"),
        F.get("request", F.lit(0))["target_uri"].alias("request_uri"), fields.alias("metadata_fields")), "warc-captures")
    targets = captures.where("type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("target_page"))
    shown = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "request_uri", "metadata_fields"]
    alone = captures.where("refers_to IS NULL").select(*shown, F.lit(None).cast("long").alias("refers_to"))
    again = captures.where("refers_to IS NOT NULL").join(targets, captures.refers_to == targets.target, "left")
    rows = alone.unionByName(again.select(*shown, F.col("target_page").alias("refers_to")))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "request_uri", "metadata_fields")
