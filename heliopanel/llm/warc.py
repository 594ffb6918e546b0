"""WARC archives: pages written as compressed records, archives of any origin read by byte ranges.

Writing. Each page becomes one gzip member that holds one WARC 1.1 record. Of pages with equal payloads of at
least `min_revisit_bytes` bytes the one with the largest identifier is a `response`; the others are `revisit`
records that name it and repeat its HTTP header and digest, not its payload. Equal payloads are found by
SHA-256: one narrow aggregate, then a join with the repeated digests only, which is no aggregate itself, so that
Spark can split a digest that many pages share. Members are packed into blocks and Spark's own text writer
stores the blocks, with an empty gzip member as line separator: so files reach any file system that Spark
reaches, a lost task is written again, and only committed tasks count.

Reading. Files are listed by Spark and cut into byte ranges. A task looks for the gzip magic inside its range,
decodes the start of each candidate member and takes it for a record only if it begins with a WARC header
and ends as that header says; a magic inside compressed data fails this and the search goes on behind it.
A task owns the records that start inside its range and reads past the range's end to finish the last one.
`outermost` drops records that lie inside another record's bytes (an archive stored without compression as
the payload of a record). Files on file systems that pyarrow does not open are read whole through Spark.

A null payload counts as empty. A null identifier never makes a response of a group that has other
identifiers; if all are null, or the largest identifier is repeated, all rows with it are responses. Repeated rows are
further records. A null address gives no target, control characters in it are percent-encoded. Digest and length are those
of the whole payload, of any size up to what one row of Spark holds (2 GB); a record is held in memory as a whole. An
empty table gives archives without records, which read as an empty frame. Columns other than the three named
ones do not matter, whatever they are called. Truncated or damaged members are no records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliopanel.llm.common import col, shared_path, stored

MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:record:"
BLOCK_BYTES = 4 << 20
BATCH_BYTES = 16 << 20
BATCH_RECORDS = 1000
RANGE_BYTES = 64 << 20
SCAN_BYTES = 1 << 20
RECORD = ("path string, offset long, length long, record_type string, record_id string, target string, refers_to string, "
          "payload_bytes long, payload_digest string, http_header string, payload binary")


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(identifier: object) -> str:
    return f"<{URN}{'' if identifier is None else quote(str(identifier), safe='')}>"


def identifier(name: Column) -> Column:
    """The identifier that a record's name holds, as text."""
    return F.nullif(F.url_decode(F.regexp_extract(name, f"^<{URN}(.*)>$", 1)), F.lit(""))


def _clean(address: str) -> str:
    return "".join(quote(c) if c < " " or c == "\x7f" else c for c in address)


def record(page_id: object, url: str | None, payload: bytes, refers_to: object | None, date: str = DATE) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_refers_to(pages: DataFrame, payload: str, id_col: str, min_bytes: int) -> DataFrame:
    """Adds refers_to: the page whose response the row repeats, null for a response. Takes the columns of `_narrow`."""
    keyed = pages.withColumn("sha", F.when(F.octet_length(payload) >= min_bytes, F.sha2(F.col(payload), 256)))
    repeated = stored(keyed.where("sha is not null").groupBy("sha").agg(F.max(id_col).alias("first"), F.count("*").alias("n"))
                      .where("n > 1 and first is not null").select("sha", "first"))
    joined = keyed.join(repeated, "sha", "left")
    other = F.col("first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("first"))
    return joined.select(*pages.columns, F.when(other, F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, payload: str = "html", url: str = "url", id_col: str = "page_id",
               min_revisit_bytes: int = 0, level: int = 1) -> None:
    """Write one record per row below `folder`."""
    narrow = pages.select(col(id_col).alias("id"), col(url).cast("string").alias("url"),
                          F.coalesce(col(payload).cast("binary"), F.lit(b"")).alias("body"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for batch in batches:
            for key, address, body, first in zip(*(batch.column(i) for i in range(4))):
                block.append(member(record(key.as_py(), address.as_py(), body.as_py(), first.as_py()), level))
                held += len(block[-1])
                if held >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pydict({"block": pa.array([b"".join(block)], pa.binary())})
                    block, held = [], 0
        if block:
            yield pa.RecordBatch.from_pydict({"block": pa.array([b"".join(block)], pa.binary())})

    blocks = with_refers_to(narrow, "body", "id", min_revisit_bytes).select("id", "url", "body", "refers_to").mapInArrow(packed, "block binary")
    # The writer puts the bytes of the "text" down as they are.
    (blocks.select(F.col("block").cast("string").alias("value")).write
     .option("encoding", "ISO-8859-1").option("lineSep", member(b"", level).decode("latin-1")).text(folder))


class _Bytes:
    """Reads of a file by offset: `read(offset, n)` gives fewer than n bytes only at its end."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read

    @staticmethod
    def of_file(handle) -> _Bytes:
        def read(offset: int, n: int) -> bytes:
            handle.seek(offset)
            return handle.read(n)
        return _Bytes(read)

    def find(self, low: int, high: int) -> int:
        """First magic that starts in low..high-1, or -1."""
        while low < high:
            n = min(SCAN_BYTES, high - low) + len(MAGIC) - 1
            part = self.read(low, n)
            at = part.find(MAGIC)
            if 0 <= at and low + at < high:
                return low + at
            if len(part) < n:
                return -1
            low += n - len(MAGIC) + 1
        return -1

    def unpacked(self, offset: int) -> tuple[bytes, int] | None:
        """Content and length of the member at an offset, None if it is no whole member that starts like a record."""
        unpacker, parts, at, size = zlib.decompressobj(31), [], offset, 4096
        try:
            while not unpacker.eof:
                data = self.read(at, size)
                if not data:
                    return None
                at += len(data)
                parts.append(unpacker.decompress(data))
                if len(parts) == 1 and not parts[0].startswith(b"WARC/"):
                    return None
                size = SCAN_BYTES
        except zlib.error:
            return None
        return b"".join(parts), at - len(unpacker.unused_data) - offset


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {name.strip().lower(): value.strip() for name, found, value in (line.partition(":") for line in lines) if found}


def parsed(data: bytes) -> dict | None:
    """The fields of `RECORD` that a record's content gives, None if lengths do not fit."""
    head, found, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    size = fields.get("content-length", "")
    if not found or not size.isdecimal() or len(rest) != int(size) + 4 or not rest.endswith(b"\r\n\r\n"):
        return None
    body, http, kind = rest[:-4], b"", fields.get("warc-type")
    if fields.get("content-type", "").startswith("application/http"):
        http, _, body = body.partition(b"\r\n\r\n")
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "revisit":
        length = _fields(http).get("content-length", "")
        about = (int(length) if length.isdecimal() else None, said or None)
    else:
        about = (len(body), digest(body))
        if said and said != about[1] and len(said) == 32:
            raise ValueError(f"the payload of {fields.get('warc-record-id')} does not have its digest")
    return {"record_type": kind, "record_id": fields.get("warc-record-id"), "target": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
            "payload_bytes": about[0], "payload_digest": about[1], "http_header": http.decode("utf-8", "replace"), "payload": body}


def records_in(source: _Bytes, start: int, end: int) -> Iterator[dict]:
    """Records of a file that start in start..end-1."""
    at = source.find(start, end)
    while at >= 0:
        content = source.unpacked(at)
        found = parsed(content[0]) if content else None
        if found:
            yield found | {"offset": at, "length": content[1]}
        at = source.find(at + content[1] if found else at + 1, end)


def _opened(path: str):
    where = urlparse(path)
    if where.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(where.path))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _pyarrow_opens(path: str) -> bool:
    if urlparse(path).scheme in ("", "file"):
        return True
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _batches(records: Iterator[dict], payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in RECORD.split(", "))])
    rows, held = [], 0
    for row in records:
        row["payload"] = row["payload"] if payload else None
        rows.append(row)
        held += len(row["payload"] or b"")
        if held >= BATCH_BYTES or len(rows) == BATCH_RECORDS:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_warc(spark: SparkSession, folder: str, payload: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per record with the columns of `RECORD`; without `payload` its bytes stay in the task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    first = files.select("path").first()
    if first and not _pyarrow_opens(first[0]):
        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, content in zip(batch.column(0), batch.column(1)):
                    data = memoryview(content.as_buffer())
                    source = _Bytes(lambda offset, n, data=data: bytes(data[offset:offset + n]))
                    yield from _batches((r | {"path": path.as_py()} for r in records_in(source, 0, len(data))), payload)

        return files.select("path", "content").mapInArrow(whole, RECORD)
    pieces = F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long"))
    ranges = files.where("length > 0").select("path", "length", F.explode(pieces).alias("start"))
    n = ranges.count()

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with _opened(path) as handle:
                    found = records_in(_Bytes.of_file(handle), start, min(start + range_bytes, size))
                    yield from _batches((r | {"path": path} for r in found), payload)

    return ranges.repartition(max(1, n)).mapInArrow(ranged, RECORD)


def outermost(records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Without the records that lie inside another one.

    Such a record can only begin in a later range than the one around it, as a task goes on behind each record.
    So it is enough to know how far the records of the earlier ranges reach: one number per range.
    """
    from pyspark.sql import Window

    placed = records.withColumn("range_no", F.floor(F.col("offset") / range_bytes))
    earlier = Window.partitionBy("path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    reach = (placed.groupBy("path", "range_no").agg(F.max(F.col("offset") + F.col("length")).alias("reach"))
             .select("path", "range_no", F.max("reach").over(earlier).alias("reach")))
    kept = placed.join(reach, ["path", "range_no"])
    return kept.where(F.col("reach").isNull() | (F.col("offset") >= F.col("reach"))).select(*records.columns)


def archived(pages: DataFrame, min_revisit_bytes: int = 0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pages written to archives in the shared folder and read back, as (page_id text, payload_bytes, payload_digest, record_type, refers_to text)."""
    spark = pages.sparkSession
    folder = shared_path(spark)
    write_warc(pages, folder, min_revisit_bytes=min_revisit_bytes)
    found = read_warc(spark, folder, payload=False, range_bytes=range_bytes)
    return found.select(identifier(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        identifier(F.col("refers_to")).alias("refers_to"))
