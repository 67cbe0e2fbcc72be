"""WARC archives: a writer with revisit records, and a salvage reader.

The reader checks every record (gzip checksum, version line, length, end mark, payload digest). After a failed check it searches for the
next gzip member or version line that passes, goes on from there, and logs the bytes between as a quarantined gap.
Archives are read as streams; memory holds one record and the bytes it came from. A plain record's end mark is looked up before its block
is loaded, so a damaged length costs one read of four bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.llm.shared import stage

# Fixed values of the format.
VERSION = b"WARC/1.1"
VERSION_LINE = re.compile(rb"WARC/1\.[0-9]\r?\n")
MAGIC, MARK = b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK, FILE_BYTES, LEVEL = 1 << 16, 64 << 20, 3
HEAD_BYTES = 64 << 20  # of a plain record's header; one in a gzip member ends within the member
DATE = "2020-01-01T00:00:00Z"  # the given pages have no fetch time


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digest_of_hex(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """A response record, or with ``refers_to`` a revisit record, which keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:x-page:{'' if page_id is None else page_id}>", "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%-._~")
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:x-page:{refers_to}>"}
    head |= {"WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Bad(Exception):
    """A record that fails a check."""


class Cut(Bad):
    """A header that has no end in the bytes at hand."""


def header(data: bytes, start: int = 0) -> tuple[dict, int, int]:
    """The header fields of the record that begins at ``start``, where its block begins, and the block's size."""
    m = VERSION_LINE.match(data, start)
    if not m:
        raise Bad("no version line")
    stop = data.find(b"\r\n\r\n", m.end() - 2)
    if stop < 0:
        raise Cut("header without end")
    head = {}
    for line in data[m.end():stop].split(b"\r\n"):
        name, sep, value = line.partition(b":")
        if not sep and line:
            raise Bad("broken header line")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit() or "warc-type" not in head or "warc-record-id" not in head:
        raise Bad("header lacks a field")
    return head, stop + 4, int(head["content-length"])


def parse(data: bytes, start: int = 0) -> tuple[dict, int]:
    """The record that begins at ``start`` and where it ends."""
    head, begin, size = header(data, start)
    if data[begin + size:begin + size + 4] != b"\r\n\r\n":
        raise Bad("truncated" if begin + size + 4 > len(data) else "no end mark after the block")
    block = data[begin:begin + size]
    out = {"type": head["warc-type"], "record_id": head["warc-record-id"], "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to"),
           "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None}
    is_http = head.get("content-type", "").startswith("application/http")
    http, _, payload = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
    if out["type"] == "revisit":
        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
        out |= {"payload": None, "payload_bytes": int(m[1]) if m else None}
    else:
        if out["payload_digest"] and digest_of(payload) != out["payload_digest"].upper():
            raise Bad("payload digest differs")
        out |= {"payload": payload, "payload_bytes": len(payload)}
    return out, begin + size + 4


class Source:
    """A file as a sliding window of bytes; ``end`` is known once it is reached."""

    def __init__(self, file):
        self.file, self.base, self.data, self.end = file, 0, bytearray(), None

    def upto(self, stop: int) -> None:
        """Load until ``stop`` or the file's end."""
        while self.end is None and self.base + len(self.data) < stop:
            more = self.file.read(max(CHUNK, stop - self.base - len(self.data)))
            if not more:
                self.end = self.base + len(self.data)
            self.data += more

    def peek(self, start: int, size: int) -> bytes:
        """Bytes further on, without loading those before them; the file can be read at any place."""
        if self.end is None and start + size > self.base + len(self.data):
            here = self.file.tell()
            self.file.seek(start)
            out = self.file.read(size)
            self.file.seek(here)
            return out
        return self.get(start, start + size)

    def get(self, start: int, stop: int) -> bytes:
        self.upto(stop)
        return bytes(self.data[start - self.base:stop - self.base])

    def forget(self, before: int) -> None:
        if before - self.base > (1 << 20):
            del self.data[:before - self.base]
            self.base = before


def records_at(src: Source, at: int) -> tuple[list[dict], int]:
    """The records of the member or the plain record at an offset, and where it ends."""
    start = src.get(at, at + len(MARK))
    if start.startswith(MAGIC):
        z, pos, out = zlib.decompressobj(31), at, []
        while not z.eof:
            chunk = src.get(pos, pos + CHUNK)
            if not chunk:
                raise Bad("truncated member")
            try:
                out.append(z.decompress(chunk))
            except zlib.error as e:
                raise Bad(f"gzip: {e}") from None
            pos += len(chunk)
        data, found, p = b"".join(out), [], 0
        while p < len(data):
            r, p = parse(data, p)
            found.append(r)
        if not found:
            raise Bad("empty member")
        return found, pos - len(z.unused_data)
    if not start.startswith(MARK):
        raise Bad("neither member nor version line")
    size = CHUNK
    while True:
        data = src.get(at, at + size)
        try:
            _, begin, length = header(data)
        except Cut:
            if size >= HEAD_BYTES or src.end is not None and at + size >= src.end:
                raise
            size *= 4
            continue
        mark = src.peek(at + begin + length, 4)
        if mark != b"\r\n\r\n":
            raise Bad("truncated" if len(mark) < 4 else "no end mark after the block")
        r, p = parse(src.get(at, at + begin + length + 4))
        return [r], at + p


def next_start(src: Source, at: int) -> int | None:
    """Where the next member or version line may begin, from ``at`` on."""
    while True:
        src.upto(at + CHUNK)
        hits = [h for h in (src.data.find(MAGIC, at - src.base), src.data.find(MARK, at - src.base)) if h >= 0]
        if hits:
            return src.base + min(hits)
        reached = src.base + len(src.data)
        if src.end is not None:
            return None
        at = max(at, reached - len(MARK) + 1)
        src.upto(reached + CHUNK)


def salvage(file) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(offset, length, record, None) for each record and (offset, length, None, reason) for each quarantined gap, in order."""
    src, at = Source(file), 0
    while True:
        src.forget(at)
        src.upto(at + 1)
        if src.end is not None and at >= src.end:
            return
        try:
            found, stop = records_at(src, at)
        except Bad as e:
            reason, q = str(e), at
            while True:
                q = next_start(src, q + 1)
                if q is None:
                    yield at, src.end - at, None, reason
                    return
                try:
                    found, stop = records_at(src, q)
                except Bad:
                    continue
                yield at, q - at, None, reason
                at = q
                break
        for r in found:
            yield at, stop - at, r, None
        at = stop


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """(page_id, url, html, sha1, size, refers_to): of records with equal payloads of at least ``least`` bytes, that with the largest key
    is kept, the others refer to it. Only payloads that occur more than once are joined; equal keys of the kept payload are all kept.

    A null html is an empty payload; a null url stays null and its record has no target; a row without a key is a record without a
    number that refers to nothing, nor is it referred to. Other columns are left out; an empty table gives no rows.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("html"))
    rows = rows.withColumns({"sha1": F.sha1("html"), "size": F.octet_length("html").cast("long")})
    again = stage(rows.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"), "warc-copies")
    return rows.join(again, ["sha1", "size"], "left").withColumn("refers_to", F.when(F.col("kept") > F.col("page_id"), F.col("kept"))).drop("kept")


def write(planned: DataFrame, folder: str) -> DataFrame:
    """Write the planned records, one gzip member each, into archives under a shared folder: (path, records, bytes) of each file.

    URLs may have any length; a null one is left out. A file gets its name when it is whole, and only files of tasks that succeeded are in the returned list, so a task that runs again
    does no harm.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, done, path, n, size = None, [], "", 0, 0

        def close():
            out.close()
            store.move(f"{root}/{path}.part", f"{root}/{path}")
            done.append((f"{folder}/{path}", n, size))

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    path, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{path}.part", compression=None)
                data = member(record(r["page_id"], r["url"], r["html"], digest_of_hex(r["sha1"]), r["size"], r["refers_to"]))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= FILE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([d[0] for d in done], pa.string()), "records": pa.array([d[1] for d in done], pa.int64()), "bytes": pa.array([d[2] for d in done], pa.int64())})

    return stage(planned.mapInArrow(run, "path string, records long, bytes long"), "warc-files")


FIELDS = "path string, offset long, length long, type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, gap string"


def read(files: DataFrame, payload: bool = True) -> DataFrame:
    """Records and gaps of the archives in column ``path``: gaps have a reason in ``gap``, records have none. An empty file has neither.

    One task reads a file from begin to end, since only that tells where members start.
    """
    n = max(1, files.count())
    kinds = {"offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(at) as f:
                    for offset, length, r, gap in salvage(f):
                        row = {"path": path, "offset": offset, "length": length, "gap": gap, **(r or {})}
                        if not payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row.get("payload") or b"") + 256
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pydict({c: pa.array([x.get(c) for x in rows], kinds.get(c, pa.string())) for c in names})
                            rows, held = [], 0
                yield pa.RecordBatch.from_pydict({c: pa.array([x.get(c) for x in rows], kinds.get(c, pa.string())) for c in names})

    return files.select("path").repartition(n).mapInArrow(run, FIELDS)


def archives(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes) of the archives that match a path pattern; contents aren't loaded."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"))


def page_of(reference: str | Column) -> Column:
    """The page number in a record's name; none for other names."""
    n = F.regexp_extract(reference, "^<urn:x-page:(-?[0-9]+)>$", 1)
    return F.when(n != "", n.cast("long"))
