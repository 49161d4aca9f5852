"""WARC archives: a writer on Spark's text sink and a reader that salvages.

Every record is a gzip member of its own. The text sink writes the members as
they are, one per row; what it puts between rows is an empty gzip member, so
that each file is a valid multi-member gzip file.

The reader checks each member (its checksum) and each record (its length, its
end and its block digest). After a failed check it searches the next gzip magic
or WARC version line that begins a valid record, goes on there, and logs the
bytes between as a gap. A file is one task's work; ``FILE_RECORDS`` and
``FILE_BYTES`` bound it, but a file has one record at least.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerflow.llm.common import in_arrow, materialize, scratch_dir, stacked

LEAST_BYTES = 100  # smaller payloads are never revisited
FILE_RECORDS = 2000
FILE_BYTES = 64 << 20  # compressed, besides the last record
BATCH = 8 << 20
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"
_EMPTY = gzip.compress(b"", mtime=0)


def _line(text: str) -> str:
    return re.sub(r"[\r\n]+", " ", text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, date: str = DATE) -> bytes:
    """One WARC record, uncompressed: response, or revisit if ``refers_to`` is given."""
    name = "" if page_id is None else str(page_id)
    digest = hashlib.sha256(payload).hexdigest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{ID}{name}>"), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _line(url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("WARC-Refers-To", None if refers_to is None else f"<{ID}{refers_to}>"), ("WARC-Profile", None if refers_to is None else PROFILE),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    header = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return VERSION + b"\r\n" + header.encode() + b"\r\n" + block + b"\r\n\r\n"


def planned(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to names the least page_id with
    an equal payload, where that is another page and the payload is large enough."""
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.when(F.length("payload") >= LEAST_BYTES, F.sha2("payload", 256)))
    first = own.where("digest IS NOT NULL AND page_id IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1").select("digest", "first"), "payloads")
    return own.join(first, "digest", "left").select(
        "page_id", "url", "payload", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to")
    )


def write(records: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Write rows of ``planned`` as WARC files under ``path``.

    The sink counts rows. So a member that is longer than its share of
    ``FILE_BYTES`` is preceded by empty rows, which are empty members in the file.
    """
    schema, share = pa.schema([("member", pa.binary())]), max(1, FILE_BYTES // file_records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            members = []
            for row in rows:
                member = gzip.compress(record(*row), 6, mtime=0)
                members += [b""] * (len(member) // share)
                members.append(member)
            yield stacked({"member": members}, schema)

    members = in_arrow(records.select("page_id", "url", "payload", "refers_to"), run, "member binary")
    members.select(F.col("member").cast("string")).write.option("lineSep", _EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option(
        "maxRecordsPerFile", file_records
    ).text(path)


class Broken(ValueError):
    """A check that failed."""


CUT_OFF = "member is cut off"


def _inflate(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """What the member that begins at ``at`` inflates to, where it ends, and what
    is wrong with it: then it is inflated as far as it goes, and has no end."""
    stream, parts, fed = zlib.decompressobj(31), [], at
    while not stream.eof:
        if fed >= len(data):
            return b"".join(parts), fed, CUT_OFF
        piece, before = data[fed : fed + 65536], stream.copy()
        try:
            parts.append(stream.decompress(piece))
        except zlib.error as error:
            try:
                while True:  # up to the byte that breaks it
                    parts.append(before.decompress(data[fed : fed + 1]))
                    fed += 1
            except zlib.error:
                return b"".join(parts), fed, f"member: {error}"
        fed += len(piece)
    return b"".join(parts), fed - len(stream.unused_data), None


_HEAD = re.compile(rb"WARC/1\.[01]\r?\n")
_LINE_END = re.compile(rb"\r\n")


def parse(data: bytes | memoryview, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields, block and end of the record that begins at ``at``."""
    match = _HEAD.match(data, at)
    if not match:
        raise Broken("no version line")
    begin, fields = match.end(), {}
    # Line by line, so that a header may be of any length and what is none is soon left.
    while True:
        stop = _LINE_END.search(data, begin)
        if not stop:
            raise Broken("header has no end")
        line, begin = bytes(data[begin : stop.start()]), stop.end()
        if not line:
            break
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header line without name")
        fields[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = fields.get("content-length", "")
    if not size.isdigit():
        raise Broken("no content length")
    block = bytes(data[begin : begin + int(size)])
    if len(block) != int(size) or bytes(data[begin + len(block) : begin + len(block) + 4]) != b"\r\n\r\n":
        raise Broken("block and length differ")
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha256:") and hashlib.sha256(block).hexdigest() != digest[7:].lower():
        raise Broken("block digest differs")
    return fields, block, begin + len(block) + 4


_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")


def _inside(inner: bytes) -> Iterator[tuple[dict[str, str], bytes] | str]:
    """Valid records of inflated bytes, and the reason of each gap between them."""
    at = 0
    while at < len(inner):
        try:
            fields, block, at = parse(inner, at)
            yield fields, block
            continue
        except Broken as error:
            reason, start = str(error), at
        while True:
            match = _LINE.search(inner, at + 1)
            at = match.start() if match else len(inner)
            if not match:
                break
            try:
                parse(inner, at)
                break
            except Broken:
                continue
        yield f"{reason} (bytes {start} to {at} of the member)"


def records_at(data: memoryview, at: int) -> tuple[list[tuple[dict[str, str], bytes] | str], int, str | None]:
    """What the gzip member or plain record at ``at`` holds: records and reasons of
    gaps; where it ends; and what is wrong with it, if its end is not known."""
    if data[at : at + 2] != b"\x1f\x8b":
        fields, block, end = parse(data, at)
        return [(fields, block)], end, None
    inner, end, wrong = _inflate(data, at)
    found = list(_inside(inner))
    if wrong and wrong != CUT_OFF:  # any byte may be another one: only a digest tells
        found = [x if isinstance(x, str) or x[0].get("warc-block-digest", "").startswith("sha256:") else "no digest in a broken member" for x in found]
    if not any(isinstance(x, tuple) for x in found) and (wrong or found):
        raise Broken(wrong or found[0])
    return found, end, wrong


def salvage(content: bytes) -> Iterator[tuple[int, int, object]]:
    """(start, end, records) of what is valid, (start, end, reason) of gaps, in order.

    Records of a member that is broken or cut off are valid as far as it inflates;
    a bad record inside a member costs its neighbours nothing.
    """
    data, at = memoryview(content), 0
    # Records of a broken member, which may lie in it as they are: those are no others.
    known, known_to = set(), 0

    def told(start: int, end: int, found: list) -> Iterator[tuple[int, int, object]]:
        yield start, end, [x for x in found if isinstance(x, tuple)]
        for reason in found:
            if isinstance(reason, str):
                yield start, end, reason

    while at < len(data):
        start, reason = at, None
        try:
            found, end, reason = records_at(data, at)
            if at < known_to:
                found = [x for x in found if isinstance(x, str) or repr(x[0]) not in known]
            if reason is None:
                yield from told(at, end, found)
                at = end
                continue
        except Broken as error:
            found, reason = [], str(error)
        while True:
            match = _START.search(data, at + 1)
            at = match.start() if match else len(data)
            if not match:
                break
            try:
                records_at(data, at)
                break
            except Broken:
                continue
        if found:
            known, known_to = {repr(x[0]) for x in found if isinstance(x, tuple)} | known, max(known_to, end)
            # What a cut left of its last record is part of the gap of the member.
            yield start, at, [x for x in found if isinstance(x, tuple)]
            yield from ((start, at, x) for x in found[:-1] if isinstance(x, str))
        yield start, at, reason


_ROW = pa.schema(
    [
        ("file", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("page_id", pa.int64()),
        ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("stated_digest", pa.string()), ("payload", pa.binary()),
    ]
)


def _number(value: str | None) -> int | None:
    match = re.fullmatch(rf"<?{ID}(-?\d+)>?", value or "")
    return int(match[1]) if match else None


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Rows of all archives under ``path``.

    A record has file, start and end (of its member, in bytes), page_id (from a
    record id as ``write`` makes it, else null), record_type, url, refers_to,
    payload_bytes and payload_digest (both of the payload in the block, null for
    revisits), stated_digest, and, if asked for, the payload. A gap has file,
    start, end (exclusive) and its reason in ``gap``. Empty files give no rows.
    """

    def row(file: str, start: int, end: int, fields: dict[str, str], block: bytes) -> dict:
        kind = fields.get("warc-type")
        body = None
        if kind != "revisit":
            body = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
        stated = fields.get("warc-payload-digest", "")
        return {
            "file": file, "start": start, "end": end, "page_id": _number(fields.get("warc-record-id")), "record_type": kind,
            "url": fields.get("warc-target-uri"), "refers_to": _number(fields.get("warc-refers-to")),
            "payload_bytes": None if body is None else len(body), "payload_digest": None if body is None else hashlib.sha256(body).hexdigest(),
            "stated_digest": stated[7:].lower() if stated.startswith("sha256:") else None, "payload": body if payloads else None,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                file = batch.column(0)[k].as_py()
                for start, end, found in salvage(batch.column(1)[k].as_py() or b""):
                    if isinstance(found, str):
                        rows.append({"file": file, "start": start, "end": end, "gap": found})
                        continue
                    for fields, block in found:
                        rows.append(row(file, start, end, fields, block))
                        held += len(block) if payloads else 0
                    if held > BATCH or len(rows) >= 2000:
                        yield pa.RecordBatch.from_pylist(rows, _ROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ROW)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = (
        "file string, start long, end long, gap string, page_id long, record_type string, url string, refers_to long, "
        "payload_bytes long, payload_digest string, stated_digest string, payload binary"
    )
    return in_arrow(files, run, kind)


def resolved(rows: DataFrame) -> DataFrame:
    """Records as (page_id, payload_bytes, payload_digest, record_type, refers_to):
    a revisit has the length of the response that it refers to and its stated digest."""
    found = rows.where("gap IS NULL")
    whole = found.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to")).agg(F.max("payload_bytes").alias("n"))
    again = found.where("record_type = 'revisit'").select("page_id", "stated_digest", "record_type", "refers_to")
    again = again.join(whole, "refers_to", "left").select("page_id", F.col("n").alias("payload_bytes"), "stated_digest", "record_type", "refers_to")
    return found.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").union(again)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, read them back, and return ``resolved``.

    Null html is an empty payload, a null url no URI. Rows of one id are all
    written, the least id's all as responses; null ids are never referred to. An
    empty table gives no rows.
    """
    spark = pages.sparkSession
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(planned(pages), path)
    return resolved(materialize(read(spark, path), "records"))
