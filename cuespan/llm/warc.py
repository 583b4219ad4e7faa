"""WARC archives: writing with duplicates as revisits and long payloads in segments; reading them back."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, column_of, shared_folder, staged

#: One archive holds at most this many records, so that a reading task's file is bounded.
RECORDS = 2000

# Lines of the archive and transfer formats.
_VERSION = b"WARC/1.1\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_HEX = re.compile(rb"[0-9A-Fa-f]+")


def base32(sha1_hex: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: eight letters for each ten hex digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for part in range(4):
        n = F.conv(F.substring(sha1_hex, 10 * part + 1, 10), 16, 10).cast("long")
        out += [F.substr(letters, (F.shiftright(n, 35 - 5 * k).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for k in range(8)]
    return F.concat(*out)


def chunked(payload: bytes, size: int) -> bytes:
    """Chunked transfer framing."""
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%X\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """Undo chunked framing; chunk extensions and trailers are skipped. Broken framing raises ValueError."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        m = _HEX.match(body, at)
        if end < 0 or not m:
            raise ValueError(f"no chunk size at byte {at}")
        n, at = int(m[0], 16), end + 2
        if not n:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError(f"chunk of {n} bytes is cut at byte {at}")
        out.append(body[at : at + n])
        at += n + 2


def _record(head: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return _VERSION + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def write_archives(pages: DataFrame, least_bytes: int = 0, segment: int = 8192, chunk: int = 4096, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write one record per row of ``page_id``, ``url``, ``payload`` (bytes; null: empty); gives the folder.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the largest page_id
    (null is least; among equals the last of the scan) is a response, the others are revisits that
    name it and carry no payload; smaller payloads are all responses. Payloads are framed in chunks of
    ``chunk`` bytes; blocks of over ``segment`` bytes continue in further records with the first one's
    id, numbered, the last one with the total length.

    Equal payloads are found by digest on thin rows, combined before the shuffle, and only revisits go
    back to the wide rows, by row. Archives are Spark text files (gzip) whose line end is the end of
    a record. ``pages`` should be a table in storage: rows are matched by scan position. Equal rows
    are records of their own. An empty table gives archives without records.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("payload"), F.lit(b"")).alias("payload"), F.monotonically_increasing_id().alias("row"))
    thin = staged(rows.select("page_id", "row", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("bytes")), "digests")
    first = thin.where(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.max(F.struct("page_id", "row")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    best = thin.join(first, "sha").where((F.col("row") != F.col("best.row")) & (F.col("bytes") >= least_bytes))
    revisits = best.select("row", F.col("best.page_id").alias("to_page"), F.col("best.row").alias("to_row"), F.lit(True).alias("again"))
    typed = rows.join(revisits, "row", "left").select("page_id", "url", "row", F.coalesce("again", F.lit(False)).alias("again"), "to_page", "to_row", base32(F.sha1("payload")).alias("digest"), F.when(F.col("again").isNull(), F.col("payload")).alias("payload"))
    job = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("value", pa.binary())])

        def urn(row: int, part: int = 1) -> str:
            return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{job}/{row}/{part}')}>"

        for batch in batches:
            out = []
            for page, url, row, again, to_page, to_row, digest, payload in zip(*[column_of(batch, c).to_pylist() for c in batch.schema.names], strict=True):
                head = [("WARC-Date", date), ("WARC-Target-URI", re.sub(r"[\r\n]", "", url) if url is not None else None), ("X-Page-Id", page)]
                own = [("WARC-Payload-Digest", f"sha1:{digest}")]
                if again:
                    out.append(_record([("WARC-Type", "revisit"), ("WARC-Record-ID", urn(row)), *head, *own, ("WARC-Refers-To", urn(to_row)), ("X-Refers-To-Page", to_page), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], b""))
                    continue
                block = _HTTP + chunked(payload, chunk)
                parts = [block[k : k + segment] for k in range(0, len(block), segment)]
                for k, part in enumerate(parts, 1):
                    many = [("WARC-Segment-Number", k)] if len(parts) > 1 else []
                    if k > 1:
                        many.append(("WARC-Segment-Origin-ID", urn(row)))
                    if 1 < len(parts) == k:
                        many.append(("WARC-Segment-Total-Length", len(block)))
                    kind = "response" if k == 1 else "continuation"
                    out.append(_record([("WARC-Type", kind), ("WARC-Record-ID", urn(row, k)), *(head + own if k == 1 else head[:2]), *many], part))
                if len(out) >= 512:
                    yield batch_of(schema, [out])
                    out = []
            yield batch_of(schema, [out])

    records = typed.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    folder = f"{shared_folder(spark)}/archives-{job}"
    # a cast from bytes to text keeps the bytes, so any payload passes
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(folder)
    return folder


def parse(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive, headers in lower case; each block has the length that its header says."""
    at = 0
    while at < len(archive):
        if not archive.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        end = archive.index(b"\r\n\r\n", at)
        head = {}
        for line in archive[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            head[k.strip().lower()] = v.strip()
        n, at = int(head["content-length"]), end + 4
        if at + n > len(archive):
            raise ValueError("the last record is cut")
        yield head, archive[at : at + n]
        at += n
        while archive.startswith(b"\r\n", at):
            at += 2


def _inflated(content: bytes) -> bytes:
    """Gzip members one after another, or plain bytes."""
    if not content.startswith(b"\x1f\x8b"):
        return content
    out = []
    while content:
        one = zlib.decompressobj(31)
        out.append(one.decompress(content))
        content = one.unused_data
    return b"".join(out)


def _payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_SEGMENT = "page_id long, record_id string, kind string, digest string, refers_to long, refers_id string, segment int, total long, block binary"
_WHOLE = "page_id long, record_id string, record_type string, payload_digest string, refers_to long, refers_id string, payload binary"


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of all archives in ``folder``; ``record_id`` is a continuation's origin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("kind", pa.string()), ("digest", pa.string()), ("refers_to", pa.int64()), ("refers_id", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("block", pa.binary())])
        whole = lambda v: None if v is None else int(v)
        for batch in batches:
            for content in column_of(batch, "content").to_pylist():
                rows, size = [], 0
                for h, block in parse(_inflated(content)):
                    digest = h.get("warc-payload-digest")
                    rows.append((whole(h.get("x-page-id")), h.get("warc-segment-origin-id", h["warc-record-id"]), h["warc-type"], digest and digest.partition(":")[2], whole(h.get("x-refers-to-page")), h.get("warc-refers-to"), whole(h.get("warc-segment-number")), whole(h.get("warc-segment-total-length")), block))
                    size += len(block)
                    if size > 1 << 22:
                        yield batch_of(schema, zip(*rows, strict=True))
                        rows, size = [], 0
                if rows:
                    yield batch_of(schema, zip(*rows, strict=True))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where("length > 0").select("content")
    return files.mapInArrow(run, _SEGMENT)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: those in one piece as they are, others with the blocks of their segments in order.

    A record's segments meet in one group, which is as large as the record. Segments must be numbered
    from 1 without a gap and their length be the total that the last one says; anything else raises, as
    does a payload whose chunks don't add up or whose digest differs.
    """
    single = records.where("segment is null")
    parts = records.where("segment is not null").groupBy("record_id").agg(
        F.max("page_id").alias("page_id"),
        F.max(F.when(F.col("segment") == 1, F.col("kind"))).alias("kind"),
        F.max("digest").alias("digest"),
        F.max("total").alias("total"),
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    ordered = F.forall(F.transform("parts", lambda p, i: p["segment"] == i + 1), lambda ok: ok)
    block = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["block"])), ""))
    right = ordered & F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False))
    joined = parts.withColumn("block", block).withColumn("block", F.when(right, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments of "), "record_id", F.lit(" are not whole")))))
    names = ["page_id", "record_id", "kind", "digest", "refers_to", "refers_id", "block"]
    both = single.select(*names).union(joined.select("page_id", "record_id", "kind", "digest", F.lit(None).cast("long"), F.lit(None).cast("string"), "block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("refers_id", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            payloads = []
            for name, kind, digest, block in zip(*[column_of(batch, c).to_pylist() for c in ("record_id", "kind", "digest", "block")], strict=True):
                if kind == "revisit":
                    payloads.append(None)
                    continue
                payload = _payload(block)
                if digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"digest of {name} differs")
                payloads.append(payload)
            yield batch_of(schema, [column_of(batch, c) for c in names[:-1]] + [pa.array(payloads, pa.binary())])

    return both.mapInArrow(run, _WHOLE)


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record that isn't a continuation: ``page_id``, ``record_type``, ``refers_to``, ``payload_digest``
    and ``payload_bytes`` of the full payload, which a revisit takes from the response that it names."""
    whole = reassembled(segments(spark, folder))
    if with_payload:
        return whole.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    thin = staged(whole.select("page_id", "record_id", "record_type", "payload_digest", "refers_to", "refers_id", F.octet_length("payload").cast("long").alias("bytes")), "records")
    named = thin.where("record_type = 'response'").select(F.col("record_id").alias("refers_id"), F.col("bytes").alias("full"))
    known = thin.where("record_type = 'revisit'").join(named, "refers_id", "left").select("page_id", F.col("full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    own = thin.where("record_type <> 'revisit'").select("page_id", F.col("bytes").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.union(known)
