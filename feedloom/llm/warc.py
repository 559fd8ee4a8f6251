"""WARC archives: written with duplicate payloads as revisits, read by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import open_file, record, rows, spread, write_file
from feedloom.operators.skew import join_by_key
from feedloom.session import materialize, scratch_path

# Fixed values of the WARC 1.1 and HTTP formats.
_VERSION = b"WARC/1."
_PROFILE = "http://netpreservefederation.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"

_FILES = "path string, n_bytes long, n_records long"
_FILE_TYPES = pa.schema([("path", pa.string()), ("n_bytes", pa.int64()), ("n_records", pa.int64())])
_RECORDS = (
    "path string, offset long, record_type string, record_id string, target_uri string, date string,"
    " page_id long, refers_to long, payload_bytes long, payload_digest string"
)


def _gzip(content: bytes) -> bytes:
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(content) + press.flush()


def _line(name: str, value: str) -> str:
    """A header line; control characters of a value cannot end it."""
    return f"{name}: {''.join(c if c >= ' ' and c != chr(127) else ' ' for c in value)}\r\n"


def member(page: dict, date: str) -> bytes:
    """One record of a page as a gzip member of its own."""
    payload, target = page["payload"], page["refers_to"]
    revisit = page["revisit"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    digest = hashlib.sha1(payload).digest()
    head = "WARC/1.1\r\n"
    head += _line("WARC-Type", "revisit" if revisit else "response")
    head += _line("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>")
    head += _line("WARC-Date", date)
    if page["url"]:
        head += _line("WARC-Target-URI", page["url"])
    head += _line("WARC-Payload-Digest", "sha1:" + base64.b32encode(digest).decode())
    if page["page_id"] is not None:
        head += _line("X-Page-ID", str(page["page_id"]))
    if revisit:
        head += _line("WARC-Profile", _PROFILE)
        if target is not None:
            head += _line("X-Refers-To-Page-ID", str(target))
    head += _line("Content-Type", "application/http; msgtype=response")
    head += _line("Content-Length", str(len(block)))
    return _gzip(head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n")


def write_warc(
    pages: DataFrame,
    folder: str | None = None,
    least_bytes: int = 1000,
    file_bytes: int = 64 << 20,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Write a record per row of ``page_id, url, html`` and return the files written.

    The payload is the html in UTF-8, null counting as empty. Of rows with equal payloads
    of at least ``least_bytes`` that with the largest ``page_id`` (a missing one is the
    smallest) is the response and the others revisit it; of rows that repeat its number,
    which cannot be told apart, all are responses. Smaller payloads are responses. Other
    columns are not read.

    Only digests are compared: groups are combined before the shuffle and brought to the
    pages by a broadcast of measured size, else by a join that splits hot digests. Each
    task writes files of about ``file_bytes``; only those of attempts that ended are in
    the result, ``path, n_bytes, n_records``.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn(
        "digest",
        F.when(F.octet_length("payload") >= least_bytes, F.concat_ws("-", F.sha1("payload"), F.octet_length("payload"))),
    )
    groups = (
        keyed.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("refers_to"))
        .where("n > 1 AND refers_to IS NOT NULL")
        .select("digest", "refers_to")
    )
    groups = materialize(groups, "warc-groups")
    revisit = F.coalesce(~F.col("refers_to").eqNullSafe(F.col("page_id")) & F.col("refers_to").isNotNull(), F.lit(False))
    marked = join_by_key(keyed, groups, ["digest"], "left", ["page_id", "url"]).select(
        "page_id", "url", "payload", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        held, size, number = [], 0, 0

        def flushed() -> pa.RecordBatch:
            path = f"{folder}/pages-{task.partitionId():06d}-{number:04d}-{task.taskAttemptId()}.warc.gz"
            write_file(path, b"".join(held))
            return pa.RecordBatch.from_pylist([{"path": path, "n_bytes": size, "n_records": len(held)}], _FILE_TYPES)

        for batch in batches:
            for page in rows(batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                held.append(member(page, date))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flushed()
                    held, size, number = [], 0, number + 1
        if held:
            yield flushed()

    return materialize(marked.mapInArrow(write, _FILES), "warc-files")


# Bytes that are decoded, or read behind a range, at a time.
_CHUNK = 1 << 14


class Members:
    """The gzip members of a file that begin in a byte range.

    ``read(offset, length)`` gives bytes of the file. A range that does not begin with the
    file looks for gzip's magic bytes and takes a place for a member only if it decodes to
    a whole WARC header; from there on members follow one another. The last one is read to
    its end beyond the range. The file is read in windows of ``step``, each byte once but for
    what lies around a window's end, and little of it behind the range.
    """

    def __init__(self, read: Callable[[int, int], bytes], size: int, step: int = 1 << 20):
        self._read, self._size, self._step = read, size, step
        self._limit, self._at, self._window = size, 0, b""

    def _bytes(self, at: int, most: int, least: int = 1) -> bytes:
        """What the window has from a place on, at most ``most``; a new window if that is too little."""
        begin = at - self._at
        if begin < 0 or len(self._window) - begin < min(least, self._size - at):
            inside = self._limit - at
            wanted = min(self._step, inside) if inside >= _CHUNK else min(self._step, _CHUNK)
            self._window = self._read(at, min(max(wanted, least), self._size - at))
            self._at, begin = at, 0
        return self._window[begin : begin + most]

    def _decoded(self, at: int, header_only: bool) -> tuple[bytes, int] | None:
        """The content of the member at a place and the place after it."""
        stream, out, begin = zlib.decompressobj(31), [], at
        try:
            while not stream.eof:
                raw = self._bytes(at, _CHUNK)
                if not raw:
                    return None
                at += len(raw)
                out.append(stream.decompress(raw))
                if header_only:
                    head = b"".join(out)
                    if not head.startswith(_VERSION[: len(head)]):
                        return None
                    if b"\r\n\r\n" in head:
                        return (head, begin) if _fields(head) is not None else None
        except zlib.error:
            return None
        return b"".join(out), at - len(stream.unused_data)

    def _first(self, low: int, high: int) -> int | None:
        """The first true member that begins in the range."""
        at = low
        while at < high:
            window = self._bytes(at, self._step, least=len(_MAGIC))
            found = window.find(_MAGIC)
            while found >= 0 and at + found < high:
                if self._decoded(at + found, header_only=True):
                    return at + found
                found = window.find(_MAGIC, found + 1)
            if len(window) <= 2:
                return None
            at += max(1, len(window) - 2)
        return None

    def within(self, low: int, high: int) -> Iterator[tuple[int, bytes]]:
        self._limit = min(high, self._size)
        at = self._first(low, high)
        while at is not None and at < min(high, self._size):
            decoded = self._decoded(at, header_only=False)
            if decoded is None or not decoded[0].startswith(_VERSION):
                # A broken member: go on at the next true one.
                at = self._first(at + 1, high)
                continue
            yield at, decoded[0]
            at = decoded[1]


def _fields(content: bytes) -> dict[str, str] | None:
    """The header of a record; None if it is none."""
    head, _, _ = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    return fields if "content-length" in fields and "warc-type" in fields else None


def parsed(content: bytes) -> dict:
    """The parts of a record: its header, its HTTP header and its payload."""
    fields = _fields(content) or {}
    begin = content.find(b"\r\n\r\n") + 4
    block = content[begin : begin + int(fields.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    lengths = [line for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    return {
        "fields": fields,
        "payload": payload,
        "length": int(lengths[0].split(b":")[1]) if lengths else len(payload),
    }


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def read_warc(files: DataFrame, split_bytes: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """The records of WARC files ``path, n_bytes``, read in splits of ``split_bytes``.

    A split owns the records that begin inside, however the file was written. A response's
    digest and length are those of the payload read; a revisit has them from its header.
    With ``payloads`` rows carry their ``payload``. A task holds one record at a time
    besides the rows it is about to return.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {
            "path": pa.string(), "offset": pa.int64(), "record_type": pa.string(), "record_id": pa.string(),
            "target_uri": pa.string(), "date": pa.string(), "page_id": pa.int64(), "refers_to": pa.int64(),
            "payload_bytes": pa.int64(), "payload_digest": pa.string(),
        }
        if payloads:
            kinds["payload"] = pa.binary()
        for split in rows(batches):
            file = open_file(split["path"])
            members = Members(lambda offset, length, file=file: file.read_at(length, offset), split["n_bytes"])
            found: dict[str, list] = {name: [] for name in kinds}
            held = 0
            for offset, content in members.within(split["low"], split["low"] + split_bytes):
                one = parsed(content)
                fields, payload = one["fields"], one["payload"]
                kind = fields.get("warc-type")
                if kind == "revisit":
                    stated = fields.get("warc-payload-digest", "").partition(":")[2]
                    digest, length = base64.b32decode(stated).hex(), one["length"]
                else:
                    digest, length = hashlib.sha1(payload).hexdigest(), len(payload)
                values = (
                    split["path"], offset, kind, fields.get("warc-record-id"), fields.get("warc-target-uri"),
                    fields.get("warc-date"), _number(fields.get("x-page-id")),
                    _number(fields.get("x-refers-to-page-id")), length, digest, payload,
                )
                for column, value in zip(found.values(), values, strict=False):
                    column.append(value)
                held += len(payload) if payloads else 100
                if held > 16 << 20:
                    yield record(found, kinds)
                    found, held = {name: [] for name in kinds}, 0
            if found["path"]:
                yield record(found, kinds)

    last = F.greatest(F.col("n_bytes") - 1, F.lit(0))
    splits = files.select(
        "path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(split_bytes).cast("long"))).alias("low")
    )
    schema = _RECORDS + (", payload binary" if payloads else "")
    return spread(splits, "path", "low").mapInArrow(read, schema)
