"""Monolithic gzip normaliser for WARC files.

A file that is one gzip stream can't be read from the middle. It is inflated once, as a stream, in one
task; each record is rewritten as a gzip member of its own, and a sidecar index gives every member's
offset. Memory is bounded by one compressed record, one header and some buffers, whatever the file's size.

Files are written under a task's own name and then renamed, so a repeated task does no harm.

Defined results
* Null html: an empty payload; null url: no Target-URI; null page_id: none in the index.
* Empty payloads and very long ones, and urls of any length: records like any other. Repeated rows: a record each.
* A file without records (or an empty table): an empty output and no index rows.
* A record without a valid header, and what else stands between records: left out, with an index row of status
  "malformed"; the next record (a line that begins with WARC/) is read again.
* A stream that breaks off: records before are kept, and an index row with status "truncated" says so.
* Input that has members already is read across them. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .shared import bound_batches, new_path, write_shared

CHUNK = 1 << 18
LEVEL = 6
INDEX = "file string, record bigint, page_id bigint, uri string, offset bigint, length bigint, raw_length bigint, payload_sha1 string, status string"


def _open_out(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.tmp"
    return fs, own, path


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    body = (html or "").encode()
    head = ["WARC/1.0", "WARC-Type: resource"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_monolithic(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Pages as WARC files, each one gzip stream: what crawlers that compress afterwards leave. (path, records) of each."""
    bound_batches(pages.sparkSession)

    def run(batches):
        name = f"{folder}/part-{TaskContext.get().partitionId():05d}.warc.gz"
        out, gz, n = None, zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for batch in batches:
            for p, u, h in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs, own, path = _open_out(name)
                    out = fs.open_output_stream(own, compression=None)
                out.write(gz.compress(record(p, u, h)))
                n += 1
        if out is not None:
            out.write(gz.flush())
            out.close()
            fs.move(own, path)
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [n]})

    return pages.select("page_id", "url", "html").mapInArrow(run, "path string, records bigint")


def inflate(source) -> Iterator[bytes]:
    """The inflated bytes of a gzip stream, across members if it has several. Raises EOFError if it breaks off."""
    gz, fresh = zlib.decompressobj(31), True
    while data := source.read(CHUNK):
        while data:
            if gz.eof:
                gz, fresh = zlib.decompressobj(31), True
            out = gz.decompress(data, 4 * CHUNK)
            fresh = False
            if out:
                yield out
            data = gz.unused_data if gz.eof else gz.unconsumed_tail
    if not gz.eof and not fresh:
        raise EOFError("the gzip stream breaks off")


class _Reader:
    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.have = chunks, bytearray()

    def more(self) -> bool:
        chunk = next(self.chunks, None)
        if chunk is None:
            return False
        self.have += chunk
        return True

    def until(self, mark: bytes) -> bytes | None:
        """What is read up to the end of ``mark``, of any length; None if the stream ends before."""
        at = 0
        while (found := self.have.find(mark, at)) < 0:
            at = max(0, len(self.have) - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.have[: found + len(mark)])
        del self.have[: found + len(mark)]
        return out

    def skip_to(self, mark: bytes) -> bool:
        """Drops what comes before ``mark``; False if the stream ends first. Holds no more than a chunk of it."""
        while (found := self.have.find(mark)) < 0:
            del self.have[: max(0, len(self.have) - len(mark) + 1)]
            if not self.more():
                return False
        del self.have[:found]
        return True

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.have and not self.more():
                raise EOFError("a record breaks off")
            out = bytes(self.have[:n])
            del self.have[:n]
            n -= len(out)
            yield out


def split_members(source, write, level: int = LEVEL) -> Iterator[dict]:
    """Reads a WARC stream, writes each record as a gzip member, yields its index row."""
    reader = _Reader(inflate(source))
    offset, n = 0, 0
    while True:
        row = {"record": n, "page_id": None, "uri": None, "offset": offset, "length": 0, "raw_length": 0, "payload_sha1": None}
        try:
            while reader.have[:2] == b"\r\n" or (len(reader.have) < 2 and reader.more()):
                if reader.have[:2] == b"\r\n":
                    del reader.have[:2]
            if not reader.have:
                return
            while len(reader.have) < 5 and reader.more():
                pass
            head = reader.until(b"\r\n\r\n") if reader.have.startswith(b"WARC/") else None
            fields = {}
            for line in (head or b"").split(b"\r\n")[1:]:
                k, _, v = line.partition(b":")
                fields[k.strip().lower()] = v.strip()
            if head is None or not fields.get(b"content-length", b"").isdigit():
                yield row | {"status": "malformed"}
                if not reader.skip_to(b"\r\nWARC/"):
                    return
                continue
            gz, sha, size, held = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1(), 0, []
            held.append(gz.compress(head))
            pending = sum(map(len, held))
            for part in reader.take(int(fields[b"content-length"])):
                sha.update(part)
                held.append(gz.compress(part))
            held += [gz.compress(b"\r\n\r\n"), gz.flush()]
            pending = sum(map(len, held))
            for part in held:
                write(part)
            size = int(fields[b"content-length"])
            ident = fields.get(b"warc-record-id", b"").decode(errors="replace")
            number = ident[len("<urn:page:") : -1] if ident.startswith("<urn:page:") else ""
            yield row | {"page_id": int(number) if number.lstrip("-").isdigit() else None, "uri": fields[b"warc-target-uri"].decode(errors="replace") if b"warc-target-uri" in fields else None, "length": pending, "raw_length": len(head) + size + 4, "payload_sha1": sha.hexdigest(), "status": "ok"}
            offset += pending
            n += 1
        except (EOFError, zlib.error):
            yield row | {"status": "truncated"}
            return


def normalise(paths: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrites every file of ``paths`` (path) into ``folder``, with a sidecar ``.idx.jsonl``; returns all index rows."""

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                name = uri.rsplit("/", 1)[1]
                fs_in, at = pafs.FileSystem.from_uri(uri)
                fs, own, path = _open_out(f"{folder}/{name}")
                rows = []
                with fs_in.open_input_stream(at, compression=None) as source, fs.open_output_stream(own, compression=None) as out, fs.open_output_stream(own + ".idx", compression=None) as side:
                    for row in split_members(source, out.write, level):
                        row = {"file": name} | row
                        side.write((json.dumps(row, separators=(",", ":"), sort_keys=True) + "\n").encode())
                        rows.append(row)
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                            rows = []
                fs.move(own, path)
                fs.move(own + ".idx", path + ".idx.jsonl")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return paths.select("path").mapInArrow(run, INDEX)


_ARROW = pa.schema([("file", pa.string()), ("record", pa.int64()), ("page_id", pa.int64()), ("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("raw_length", pa.int64()), ("payload_sha1", pa.string()), ("status", pa.string())])


def normalise_pages(spark: SparkSession, pages: DataFrame, level: int = LEVEL) -> DataFrame:
    """Pages, packed into monolithic files in the shared folder, normalised there; one task a file."""
    files = write_shared(write_monolithic(pages, new_path(spark, "monolithic")), "manifest")
    return normalise(files.repartition(max(1, files.count())), new_path(spark, "members"), level)
