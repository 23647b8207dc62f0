"""WARC archives: one request, one response or revisit, and one metadata record a page; read back and assembled."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, page_id long, digest string, n_bytes long, http_head string, fields string"


def _record(kind: str, name, fields: list[tuple[str, object]], block):
    """The text of a record but for its closing CRLF CRLF; fields that are null are left out."""
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), name, F.lit(">\r\n")]
    for key, value in fields:
        lines.append(F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 6000) -> None:
    """Write gzipped archives of three records a row to the folder ``path``.

    Of rows with equal payloads (the html in UTF-8, empty for null) of ``least`` bytes or more, the one
    with the largest id is a response and the others are revisits that refer to it. Digests are
    pre-aggregated; texts move once, with the id. Rows that repeat an id are numbered and are captures
    of their own; with equal payloads the first is the response. A null id sorts below all others; a
    null url leaves out the target. Line breaks in a url are percent-encoded.
    """
    crlf = F.lit("\r\n")
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.regexp_replace(url_col, r"[\r\n]+", "%0A").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    # One key for the join and both windows, so that texts are dealt out once.
    pages = pages.withColumn("digest", F.sha1("html")).withColumn("n", F.octet_length("html").cast("long")).withColumn("key", F.coalesce(F.col("id").cast("string"), F.lit("none")))
    long_ = pages.select("id", "key", "digest", "n").filter(F.col("n") >= least)
    groups = long_.groupBy("digest").agg(F.max("id").alias("best"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "best")
    later = long_.select("key", "digest").distinct().join(groups, "digest").groupBy("key").agg(F.collect_list(F.struct("digest", "best")).alias("groups"))
    laid = pages.join(later, "key", "left")
    laid = laid.withColumn("group", F.get(F.filter("groups", lambda g: g["digest"] == F.col("digest")), F.lit(0))).withColumn("best", F.col("group.best")).drop("groups")
    laid = laid.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("digest", "url")) - 1)
    laid = laid.withColumn("same", F.row_number().over(Window.partitionBy("key", "digest").orderBy("url")) - 1)
    revisit = F.col("group").isNotNull() & ((~F.col("id").eqNullSafe(F.col("best"))) | (F.col("same") > 0))
    name = F.concat(F.lit("urn:page:"), F.col("key"), F.lit(":"), F.col("nth").cast("string"))
    main, ask, more = (F.concat(name, F.lit(x)) for x in (":response", ":request", ":metadata"))
    base = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    key = [("WARC-Page-ID", F.col("id").cast("string"))]
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))]
    link = [("WARC-Concurrent-To", F.concat(F.lit("<"), main, F.lit(">")))]
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    http = [("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record("response", main, base + key + digest + http, F.concat(head, "html"))
    refers = [("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("best").cast("string"), F.lit("none")), F.lit(":0:response>"))), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))]
    again = _record("revisit", main, base + key + digest + refers + http, head)
    get = F.concat(F.lit("GET "), F.coalesce("url", F.lit("*")), F.lit(" HTTP/1.1"), crlf, crlf)
    request = _record("request", ask, base + link + [("Content-Type", F.lit("application/http; msgtype=request"))], get)
    notes = F.concat(F.lit("payload-bytes: "), F.col("n").cast("string"), crlf)
    metadata = _record("metadata", more, base + link + [("Content-Type", F.lit("application/warc-fields"))], notes)
    records = laid.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


#: What parts two records; the rest of a version line follows.
BORDER = b"\r\n\r\nWARC/"


def parse_warc(chunks: Iterator[tuple[str, bytes]]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record, from ``(file, bytes between borders)`` in order.

    Lengths cut the records, not borders: where a block itself holds a border, its chunks are put
    together again. One record is held at a time. ValueError where a record is cut short or isn't one.
    """
    held, own = None, None
    for file, chunk in chunks:
        if file != own:
            if held is not None:
                raise ValueError(f"a record of {own} is cut short")
            own, chunk = file, chunk.lstrip(b"\r\n")
            if not chunk:
                continue
            if not chunk.startswith(b"WARC/"):
                raise ValueError(f"no WARC record at the start of {file}")
            data = chunk[5:]
        else:
            data = chunk if held is None else held + BORDER + chunk
        held = None
        while data is not None:
            stop = data.find(b"\r\n\r\n")
            if stop < 0:
                held = data
                break
            fields = {}
            for line in data[:stop].decode("utf-8").split("\r\n")[1:]:
                key, _, value = line.partition(":")
                fields[key.strip().lower()] = value.strip()
            end = stop + 4 + int(fields["content-length"])
            if len(data) < end:
                held = data
                break
            yield fields, data[stop + 4 : end]
            rest = data[end:]
            # A reader of lines may overlook a border that begins like the block's end.
            data = rest[len(BORDER) :] if rest.startswith(BORDER) else None
            if data is None and rest.strip(b"\r\n"):
                raise ValueError(f"a record of {file} is longer than it says")
    if held is not None:
        raise ValueError(f"a record of {own} is cut short")


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row a record of the gzipped archives in ``path``: ``RECORD`` and, if asked for, the payload.

    ``digest`` and ``n_bytes`` of a response are those of the payload bytes as read; a revisit has the
    digest that it declares. A file is streamed by one task, a record at a time, so neither its size nor
    its number of records has a bound. An empty folder is an error, empty archives give no rows.
    """
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
    kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in RECORD.split(", ")] + [pa.binary()] * with_payload
    bare = lambda x: x.strip("<>") if x else None

    def row(f: dict[str, str], block: bytes) -> tuple:
        kind, head, body, notes = f.get("warc-type"), None, None, None
        if kind in ("response", "revisit"):
            top, _, body = block.partition(b"\r\n\r\n")
            head = top.decode("utf-8", "replace")
        elif kind == "metadata":
            notes = block.decode("utf-8", "replace")
        digest = hashlib.sha1(body).hexdigest() if kind == "response" else (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None
        out = (bare(f.get("warc-record-id")), kind, bare(f.get("warc-concurrent-to")), bare(f.get("warc-refers-to")), f.get("warc-target-uri"), int(f["warc-page-id"]) if "warc-page-id" in f else None, digest, len(body) if kind == "response" else None, head, notes)
        return (*out, body if kind == "response" else None) if with_payload else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        chunks = ((file, chunk) for batch in batches for file, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for fields, block in parse_warc(chunks):
            rows.append(row(fields, block))
            size += len(block) * with_payload
            if len(rows) == 2000 or size > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    parts = spark.read.option("lineSep", BORDER.decode()).text(path).select("_metadata.file_path", F.col("value").cast("binary"))
    return parts.mapInArrow(run, RECORD + ", payload binary" * with_payload)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: its response or revisit, request and metadata, joined through concurrent-to ids.

    A capture without a request or metadata keeps null there; a request or metadata record whose
    capture is missing is left out. Of several that name one capture, the smallest record id counts.
    """
    side = lambda kind: records.filter(F.col("record_type") == kind).groupBy(F.col("concurrent_to").alias("of")).agg(F.min_by(F.struct("record_id", "target_uri", "fields"), "record_id").alias(kind))
    main = records.filter(F.col("record_type").isin("response", "revisit"))
    both = main.join(side("request"), main["record_id"] == F.col("of"), "left").drop("of")
    return both.join(side("metadata"), both["record_id"] == F.col("of"), "left").drop("of")


def captures(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Assembled captures of the archives in ``path`` with ``payload_bytes`` of the full payload.

    The archives are parsed once, into a table of records.
    """
    found = assemble(table(read_warc(spark, path, with_payload), "warc-records"))
    noted = F.expr("try_cast(regexp_extract(metadata.fields, 'payload-bytes: ([0-9]+)', 1) as bigint)")
    return found.withColumn("payload_bytes", F.coalesce("n_bytes", noted))
