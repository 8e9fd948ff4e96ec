"""WARC archives: writing pages, and reading records by boundary-chain verification.

Writing: a record per page, payloads already stored become revisit records. Tasks pack records
into files of a bounded number of bytes, which Spark writes, compressed, to any of its stores.

Reading: a task scans each file for the version line and emits every place it is found,
with the offset at which the next record would start if this were a record. The line
may also occur inside payloads; only what a chain of such links from offset 0 reaches is
a record. Pointer jumping finds that: round k joins what is reached so far with the
links over 2^k records, so n records need log2(n) rounds. All gzip members of a file are read
(archives often compress each record on its own). Data pass through a window and
payloads are hashed as they pass, so a task holds a file as it is stored, but never unpacked.
A file whose chain does not arrive at its end is listed with the place and the reason."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelab.llm.arrow import slices
from scorelab.llm.store import written

VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
FILE_BYTES = 16 << 20     # bytes of a file before compression, about (one record may be larger)
WINDOW = 1 << 20          # bytes that are unpacked at once
LONGEST_HEAD = 1 << 16    # bytes of a record's own header lines at most
BROADCAST_PAYLOADS = 200_000   # up to so many repeated payloads (30 bytes each) are broadcast
DATE = "2024-01-01T00:00:00Z"   # a fixed date, so that reruns write the same bytes


def record(page_id, url, payload: str, digest: str, n: int, first, revisit: bool) -> str:
    """One record without the two line ends that follow it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}{END}"
    body = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    head.append(f"Content-Length: {len(body.encode())}")
    return VERSION.decode() + "\r\n".join(head) + END + body


def write_warc(pages: DataFrame, path: str, min_revisit: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a record for every row of ``pages`` to gzip files of about ``FILE_BYTES`` under ``path``.

    Of rows with equal payloads (UTF-8 bytes, null: empty) of at least ``min_revisit``
    bytes, those with the smallest id become responses and the others revisit that id;
    rows with smaller payloads are all responses. A null id revisits if another row has
    the payload and an id. Repeated rows are written as often as they occur. Extra
    columns are not written."""
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                        F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.unhex(F.sha1(F.col("html").cast("binary"))), "n": F.octet_length("html").cast("bigint")})
    first = written(rows.where(F.col("n") >= min_revisit).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("rows")).where(
        "rows > 1").select("sha", "first"), "payloads")
    # only payloads that occur more than once are joined; few of them leave the pages where they are
    if first.limit(BROADCAST_PAYLOADS + 1).count() <= BROADCAST_PAYLOADS:
        first = F.broadcast(first)
    rows = rows.join(first, "sha", "left")

    def pack(batches):
        held, total = [], 0

        def file():
            return pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.string())], names=["value"])

        for batch in batches:
            for part in slices(batch, "html"):
                for page_id, url, html, sha, n, first_ in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "n", "first"))):
                    held.append(record(page_id, url, html, base64.b32encode(sha).decode(), n, first_, first_ is not None and first_ != page_id))
                    total += len(held[-1])
                    if total >= FILE_BYTES:
                        yield file()
                        held, total = [], 0
        if held:
            yield file()

    rows.mapInArrow(pack, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def unpacked(content: bytes) -> Iterator[bytes]:
    """The bytes of a file in windows: all its gzip members, or the file itself. Damaged or cut data raise ``ValueError``."""
    view = memoryview(content)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[i:i + WINDOW]) for i in range(0, len(view), WINDOW))
        return
    at = 0
    while at < len(view) and bytes(view[at:at + 2]) == b"\x1f\x8b":
        member, more = zlib.decompressobj(31), b""
        try:
            while not member.eof:
                if not more:
                    if at >= len(view):
                        raise ValueError("the compressed data end too soon")
                    more, at = bytes(view[at:at + WINDOW]), at + WINDOW
                data = member.decompress(more, WINDOW)
                more = member.unconsumed_tail
                if data:
                    yield data
        except zlib.error as e:
            raise ValueError(f"the compressed data are damaged: {e}") from e
        at = min(at, len(view)) - len(member.unused_data)
    if bytes(view[at:]).strip(b"\0"):
        raise ValueError("data that are not compressed follow the last member")


class _Record:
    """A place that may be a record, while its body passes."""

    def __init__(self, at: int, body: int, fields: dict[bytes, bytes]):
        self.at, self.fields, self.next = at, fields, body + int(fields[b"content-length"]) + 4
        self.head, self.sha, self.n, self.pos, self.tail = b"", None, 0, body, b""

    def take(self, data: bytes) -> bool:
        """Take the next bytes; true once the record is complete."""
        inner = data[:max(0, self.next - 4 - self.pos)]
        self.pos += len(inner)
        rest = data[len(inner):]
        if self.sha is None and inner:
            # the HTTP head ends at its first empty line; of a long one only the search goes on
            before = len(self.head)
            self.head += inner
            end = self.head.find(END.encode(), max(0, before - 3))
            if end >= 0:
                self.sha, inner = hashlib.sha1(), self.head[end + 4:]
                self.head = self.head[:end]
            else:
                inner = b""
                if len(self.head) > 2 * LONGEST_HEAD:
                    self.head = self.head[:LONGEST_HEAD] + self.head[-3:]
        if self.sha is not None:
            self.sha.update(inner)
            self.n += len(inner)
        if self.pos == self.next - 4 + len(self.tail):
            got = rest[:4 - len(self.tail)]
            self.tail += got
            self.pos += len(got)
        return len(self.tail) == 4

    def row(self) -> tuple:
        kind = self.fields.get(b"warc-type", b"").decode("utf-8", "replace")
        digest = self.fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
        said = re.search(rb"(?i)\r\ncontent-length: *(\d{1,18})", self.head) if kind == "revisit" else None
        found = (self.sha or hashlib.sha1()).digest()
        whole = kind == "revisit" or base64.b32encode(found).decode() == digest
        return (self.at, self.next, _urn(self.fields.get(b"warc-record-id")), int(said[1]) if said else self.n, digest, kind,
                _urn(self.fields.get(b"warc-refers-to")), whole)


def candidates(windows: Iterator[bytes]) -> Iterator[tuple]:
    """(offset, offset of the next record, page id, payload bytes, digest, type, refers to, digest
    is that of the payload) for each version line that heads a complete record; at last (-1, size of the data, and nulls)."""
    held, base, searched = b"", 0, 0       # held begins at offset base; version lines before searched are known
    open_: list[_Record] = []
    for data in windows:
        still = []
        for r in open_:
            if not r.take(data):
                still.append(r)
            elif r.tail == END.encode():
                yield r.row()
        open_ = still
        held += data
        while True:
            at = held.find(VERSION, searched - base)
            if at < 0:
                searched = max(searched, base + len(held) - len(VERSION) + 1)
                break
            end = held.find(END.encode(), at, at + LONGEST_HEAD)
            if end < 0:
                if len(held) - at < LONGEST_HEAD:      # wait for more
                    searched = base + at
                    break
            else:
                fields = {}
                for line in held[at + len(VERSION):end].split(b"\r\n"):
                    name, _, value = line.partition(b":")
                    fields[name.strip().lower()] = value.strip()
                if re.fullmatch(rb"\d{1,18}", fields.get(b"content-length", b"")):
                    r = _Record(base + at, base + end + 4, fields)
                    if not r.take(held[end + 4:]):
                        open_.append(r)
                    elif r.tail == END.encode():
                        yield r.row()
            searched = base + at + 1
        keep = min(len(held), max(0, searched - base))
        held, base = held[keep:], base + keep
    yield (-1, base + len(held), None, None, None, None, None, None)


def _urn(value: bytes | None) -> int | None:
    """The id of a page's name; null if it is none or does not fit a long."""
    found = re.fullmatch(rb"<urn:page:(-?\d{1,19})>", value or b"")
    return int(found[1]) if found and -2**63 <= int(found[1]) < 2**63 else None


def read_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of the archives under ``path``.

    Records: ``file``, ``at``, ``page_id`` (null if the record's name is no page id that fits a long), ``payload_bytes``,
    ``payload_digest``, ``record_type``, ``refers_to``, ``intact`` (the payload has its digest). The quarantine has
    ``path``, ``at`` (where the chain of records ends) and ``reason`` for each file in which something is left
    that no chain from the start reaches: a file that begins with no record, is cut or damaged. Its
    records up to there are among the records. A task holds one file as it is stored."""
    files = spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("file"), "path", "content")
    names = ["file", "path", "at", "next", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]

    def scan(batches):
        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        def guarded(content):
            try:
                yield from candidates(unpacked(content))
            except ValueError as e:
                yield (-1, -1, None, None, str(e), None, None, None)

        for batch in batches:
            for n in range(batch.num_rows):
                file, where, rows = batch.column("file")[n].as_py(), batch.column("path")[n].as_py(), []
                for found in guarded(batch.column("content")[n].as_buffer()):
                    rows.append((file, where if found[0] < 0 else None, *found))
                    if len(rows) >= 10_000:
                        yield flush(rows)
                        rows = []
                if rows:
                    yield flush(rows)

    schema = ("file bigint, path string, at bigint, next bigint, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
              "refers_to bigint, intact boolean")
    found = written(files.mapInArrow(scan, schema), "warc-candidates")
    links = found.where("at >= 0")
    records = written(links.join(chain(links.select("file", "at", "next")), ["file", "at"]), "warc-records")
    ends = records.groupBy("file").agg(F.max("next").alias("reached"))
    files = found.where("at < 0").select("file", "path", F.col("next").alias("size"), F.col("payload_digest").alias("error")).join(ends, "file", "left")
    reached = F.coalesce("reached", F.lit(0))
    reason = F.coalesce(F.col("error"), F.when(reached == 0, "no record at the start").otherwise("the chain of records ends before the file"))
    quarantine = files.where(reached != F.col("size")).select("path", reached.alias("at"), reason.alias("reason"))
    return records.drop("next", "path"), quarantine


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of ``read_archives``."""
    return read_archives(spark, path)[0]


def chain(links: DataFrame) -> DataFrame:
    """(``file``, ``at``) of the offsets that links (``file``, ``at``, ``next``) reach from offset 0."""
    reached = links.where("at = 0").select("file", "at")
    jump = links.join(links.select("file", F.col("at").alias("next")), ["file", "next"], "left_semi").select("file", "at", "next")
    while True:
        jump = written(jump, "jumps")
        if jump.isEmpty():
            return reached
        reached = written(reached.union(reached.join(jump, ["file", "at"]).select("file", F.col("next").alias("at"))), "reached")
        onward = jump.select("file", F.col("at").alias("next"), F.col("next").alias("further"))
        jump = jump.join(onward, ["file", "next"]).select("file", "at", F.col("further").alias("next"))
