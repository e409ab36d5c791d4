"""WARC archives: writing records, reading them back, reassembling segments.

Writing: one record per page. Its HTTP response has the payload in chunked
transfer framing; a block longer than ``segment_bytes`` is split into a first
record and ``continuation`` records that name it as their origin, are numbered,
and end with the total length. Of pages with equal payloads the one of smallest
id is stored and the others are ``revisit`` records that refer to it. Spark's
text writer commits the files (records end with two line breaks, which is the
separator), so retried and lost tasks leave nothing behind, and any store that
Spark writes to will do. A file has at most ``file_records`` records.

Reading: whole files of archives, plain or in one or more gzip members, are parsed by their
Content-Length fields, never by searching for marks inside blocks. Segments are
grouped by origin, ordered by number, checked for gaps and against the total
length, and joined; then transfer framing is removed. Only segments are
shuffled; a group is one original record.

Null payloads are empty. Payloads of under ``min_revisit`` bytes are always
stored. Null page ids are stored, or revisit the smallest known id with their
payload. Rows that repeat a page id are records of their own; those of the
smallest id are all stored. Extra columns are not read. A record that can't be
put together has a null payload and says why in ``problem``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from optiq.session import cut_lineage, scratch_path
from optiq.sources.tables import table

BREAK = b"\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str, part: str = "") -> str:
    """The id of a page's record: rows that share page and payload share it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {page_id} {digest} {part}'.encode()).digest())}>"


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    """``payload`` in chunked transfer framing."""
    out = []
    for at in range(0, len(payload), chunk_bytes):
        part = payload[at:at + chunk_bytes]
        out += [b"%x\r\n" % len(part), part, BREAK]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(BREAK, at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        at = end + 2 + size
        if body[at:at + 2] != BREAK:
            raise ValueError("a chunk doesn't end where it should")
        out.append(body[end + 2:at])
        at += 2


def _record(kind: str, fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line breaks after it (the writer adds them)."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in fields if v is not None]
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8") + block


def page_records(row, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one page (page_id, url, payload, digest, first_id, row)."""
    page_id, url, payload, digest, first_id, number = row
    url = url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    own = record_id(page_id, digest)
    base = [("WARC-Record-ID", own), ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", f"sha256:{digest}"), ("Optiq-Page-Id", page_id),
            ("Optiq-Row", number), ("Content-Type", "application/http; msgtype=response")]
    if first_id is not None and first_id != page_id:
        head = HTTP_HEAD + b"Content-Length: %d\r\n\r\n" % len(payload)
        return [_record("revisit", [*base, ("WARC-Profile", PROFILE),
                                    ("WARC-Refers-To", record_id(first_id, digest))], head)]
    block = HTTP_HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return [_record("response", base, block)]
    parts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record("response", [*base, ("WARC-Segment-Number", 1)], parts[0])]
    for i, part in enumerate(parts[1:], start=2):
        out.append(_record("continuation", [
            ("WARC-Record-ID", record_id(page_id, digest, f"{number} {i}")), ("WARC-Target-URI", url),
            ("Optiq-Row", number), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", i),
            ("WARC-Segment-Total-Length", len(block) if i == len(parts) else None)], part))
    return out


def write(pages: DataFrame, path: str, min_revisit: int = 100, segment_bytes: int = 32_768,
          chunk_bytes: int = 8_192, file_records: int = 4096, compression: str = "gzip") -> None:
    """Archives of ``pages`` (page_id, url, html) under ``path``; ``compression``
    is a codec of Spark's text writer that ``plain`` can read: gzip or none."""
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                         F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    known = known.withColumn("digest", F.sha2("payload", 256))
    firsts = (known.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
              .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
              .select(F.col("digest").alias("d"), "first_id"))
    rows = known.join(firsts, F.col("digest") == F.col("d"), "left").select(
        "page_id", "url", "payload", "digest", "first_id", F.monotonically_increasing_id().alias("row"))

    def run(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out, size = [], 0
            for row in zip(*columns, strict=True):
                made = page_records(row, segment_bytes, chunk_bytes)
                out += made
                size += sum(map(len, made))
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    (rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", file_records)
     .option("compression", compression).text(path))


FIELDS = {"warc-type": "type", "warc-record-id": "record_id", "warc-segment-origin-id": "origin_id",
          "warc-segment-number": "segment", "warc-segment-total-length": "total_length",
          "warc-refers-to": "refers_to", "warc-target-uri": "url", "warc-payload-digest": "digest",
          "optiq-page-id": "page_id", "optiq-row": "row"}
RECORDS = pa.schema([("type", pa.string()), ("record_id", pa.string()), ("origin_id", pa.string()),
                     ("segment", pa.int64()), ("total_length", pa.int64()), ("refers_to", pa.string()),
                     ("url", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()),
                     ("row", pa.int64()), ("block", pa.binary())])
NUMBERS = {"segment", "total_length", "page_id", "row"}


PIECE = 1 << 20


def inflated(content: bytes):
    """A file's bytes in pieces, out of gzip members where it has them; ValueError where a
    member is damaged or cut."""
    if content[:2] != b"\x1f\x8b":
        yield from (content[i:i + PIECE] for i in range(0, len(content), PIECE))
        return
    while content:
        member = zlib.decompressobj(31)
        while not member.eof:
            try:
                piece = member.decompress(content, PIECE)
            except zlib.error as e:
                raise ValueError(f"a gzip member is damaged: {e}") from e
            content = member.unused_data if member.eof else member.unconsumed_tail
            if not piece and not content and not member.eof:
                raise ValueError("a gzip member is cut")
            yield piece


def plain(content: bytes) -> bytes:
    """A file's bytes as a whole."""
    return b"".join(inflated(content))


class _Buffer:
    """What has been read of a stream and not yet used."""

    def __init__(self, stream):
        self.stream, self.held = iter(stream), bytearray()

    def more(self) -> bool:
        piece = next(self.stream, None)
        self.held += piece or b""
        return piece is not None

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        if len(self.held) < n:
            raise ValueError("a record is cut")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def until(self, mark: bytes) -> bytes:
        at = 0
        while (end := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                raise ValueError("a record's header is cut")
        return self.take(end + len(mark))[:end]


def parse(stream):
    """Records of one archive (pieces of its bytes) as dicts, one in memory at a time; the
    header fields not in FIELDS are dropped. ValueError where the archive is damaged."""
    buffer = _Buffer([stream] if isinstance(stream, bytes) else stream)
    while True:
        while buffer.held[:2] == BREAK or (len(buffer.held) < 2 and buffer.more()):
            if buffer.held[:2] == BREAK:
                del buffer.held[:2]
        if not buffer.held:
            return
        lines = buffer.until(b"\r\n\r\n").decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no record where one should begin")
        header = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
        if not header.get("content-length", "").isdigit():
            raise ValueError("a record has no length")
        found = {name: header.get(field) for field, name in FIELDS.items()}
        yield {**{k: int(v) if k in NUMBERS and v is not None else v for k, v in found.items()},
               "block": buffer.take(int(header["content-length"]))}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``: FIELDS and ``block``. Where an archive is
    damaged, a row with ``problem`` and ``url``, the file, stands for the rest of it."""
    schema = RECORDS.append(pa.field("problem", pa.string()))

    def run(batches):
        for batch in batches:
            for name, content in zip(*batch.columns, strict=True):
                out, size = [], 0
                records = parse(inflated(content.as_py()))
                while True:
                    try:
                        record = next(records, None)
                    except ValueError as e:  # the file can't be read any further
                        record = {"type": "damaged", "url": name.as_py(), "problem": str(e)[:200]}
                        records = iter(())
                    if record is None:
                        break
                    out.append(record)
                    size += len(record.get("block") or b"")
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "type string, record_id string, origin_id string, segment long, "
                            "total_length long, refers_to string, url string, digest string, "
                            "page_id long, row long, block binary, problem string")


def _joined(blocks: pa.Array) -> pa.Array:
    return pa.array((b"".join(x) for x in blocks.to_pylist()), type=pa.binary())


def reassemble(records: DataFrame) -> DataFrame:
    """``records`` without continuations: segmented ones with their whole block,
    or a null block and the ``problem`` where segments are missing or doubled
    or don't add up to the total length. Rows of damaged archives pass through."""
    names = [c for c in records.columns if c not in ("origin_id", "segment", "total_length", "problem")]
    whole = records.where("type <> 'continuation' AND segment IS NULL")
    parts = records.where("segment IS NOT NULL").withColumn(
        "origin", F.coalesce("origin_id", "record_id"))
    order = F.array_sort(F.collect_list(F.struct("segment", "block", *[c for c in names if c != "block"])))
    groups = (parts.groupBy("origin", F.col("row").alias("_row"))
              .agg(order.alias("p"), F.max("total_length").alias("total")))
    n, length = F.size("p"), F.aggregate("p", F.lit(0).cast("long"),
                                         lambda a, x: a + F.octet_length(x["block"]))
    numbered = F.forall(F.arrays_zip(F.col("p.segment").alias("s"), F.sequence(F.lit(1), n).alias("i")),
                        lambda x: x["s"] == x["i"])
    problem = (F.when(F.element_at("p.segment", 1) != 1, "no first segment")
               .when(F.col("total").isNull(), "no last segment")
               .when(~numbered, "segments missing or doubled")
               .when(length != F.col("total"), "wrong total length"))
    joined = F.arrow_udf(_joined, "binary")(F.col("p.block"))
    whole_again = groups.withColumn("problem", problem).select(
        *[(F.when(F.col("problem").isNull(), joined) if c == "block" else F.element_at(f"p.{c}", 1)).alias(c)
          for c in names], "problem")
    own = F.col("problem") if "problem" in records.columns else F.lit(None).cast("string")
    return whole.select(*names, own.alias("problem")).unionByName(whole_again)


def _bodies(blocks: pa.Array) -> pa.Array:
    out = []
    for block in blocks.to_pylist():
        payload = None
        if block is not None:
            head, found, body = block.partition(b"\r\n\r\n")
            try:
                framed = re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head)
                payload = (dechunked(body) if framed else body) if found else block
            except ValueError:
                pass
        out.append(payload)
    return pa.array(out, type=pa.binary())


def payload(block: Column) -> Column:
    """The body of an HTTP message without transfer framing; null if it is broken."""
    return F.arrow_udf(_bodies, "binary")(block)


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of whole
    records; revisits have the payload of the record that they refer to."""
    read = records.withColumn("body", F.when(F.col("type") == "response", payload(F.col("block"))))
    slim = cut_lineage(read.select(
        "record_id", "page_id", "type", "refers_to", "problem",
        F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha")))
    stored = slim.where("type = 'response'")
    found = (slim.where("type = 'revisit'").select("page_id", "refers_to")
             .join(stored.dropDuplicates(["record_id"]).select(
                 F.col("record_id").alias("r"), F.col("page_id").alias("first"), "bytes", "sha"),
                 F.col("refers_to") == F.col("r"), "left"))
    return (stored.select("page_id", F.col("bytes").alias("payload_bytes"),
                          F.col("sha").alias("payload_digest"), F.lit("response").alias("record_type"),
                          F.lit(None).cast("long").alias("refers_to"))
            .unionByName(found.select("page_id", F.col("bytes").alias("payload_bytes"),
                                      F.col("sha").alias("payload_digest"),
                                      F.lit("revisit").alias("record_type"),
                                      F.col("first").alias("refers_to"))))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return resolved(reassemble(read_records(spark, path)))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
