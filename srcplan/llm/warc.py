"""WARC files as a table of record chunks.

`read_warc` streams each file, plain or gzip with any number of members, and yields a payload as rows of at most
`chunk_bytes` with the record's id and a chunk number. No record is held whole: a worker has one chunk, a read buffer and
the rows of one small batch. Every row carries the SHA-256 of the payload up to its end, so that a reader can check any prefix and
resume after it. `write_warc` writes pages as resource records, a file for each partition, under a temporary name that is then renamed, so that
a task that is run again leaves whole files only. Paths may be of any file system that Arrow knows.

Defined results: an empty payload gives one row with an empty chunk. A null html is written as an empty payload, null id and url as empty headers;
repeated rows give records of their own. Header lines may have any length. A payload cut off by the end of its file ends in a row with `complete`
false, and so does one cut off where a gzip member can't be read. A header that can't be read gives such a row too, and reading goes on at the next line that begins like a record, after damaged
gzip at the next member; each gap gives one such row at least. Extra columns are ignored; an
empty table gives no file and no row.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from srcplan.llm import common as C

CHUNK_BYTES = 16384
READ_BYTES = 1 << 18
FILE_BYTES = 64 << 20
MARK = b"WARC/"
GZIP = b"\x1f\x8b\x08"
CHUNKS = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("warc_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("chunk_no", T.IntegerType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("end_offset", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("last", T.BooleanType()),
        T.StructField("complete", T.BooleanType()),
    ]
)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), unquote(urlparse(path).path)
    return pafs.FileSystem.from_uri(path)


class Bytes:
    """Reads a file as one stream of bytes, through gzip if it begins with its mark. gap: whether what follows is lost, torn: whether that begins within a member; go_on() then looks for the next gzip member."""

    def __init__(self, raw: Callable[[int], bytes]) -> None:
        self.raw, self.held, self.ended, self.gap, self.torn = raw, bytearray(), False, False, False
        first = raw(READ_BYTES)
        # a file whose first member is damaged is told by a mark further on
        self.gz = zlib.decompressobj(31) if GZIP in first and not first.lstrip(b"\r\n").startswith(MARK) or first[:2] == GZIP[:2] else None
        self.waiting, self.fresh = first, True

    def _more(self) -> bool:
        while not self.ended and not self.gap:
            data, self.waiting = self.waiting, b""
            data = data or self.raw(READ_BYTES)
            if not data:
                self.ended = True
                self.gap = self.torn = self.gz is not None and not self.fresh  # a member that the end of the file cuts off
                return False
            if self.gz is None:
                self.held += data
                return True
            try:
                out = self.gz.decompress(data, READ_BYTES)
            except zlib.error:
                # the mark of the member that failed is not taken for the next one
                self.waiting, self.gap, self.torn = data[self.fresh :], True, not self.fresh
                return False
            self.fresh = False
            if self.gz.eof:
                self.waiting = self.gz.unused_data
                self.gz, self.fresh = zlib.decompressobj(31), True
            else:
                self.waiting = self.gz.unconsumed_tail
            if out:
                self.held += out
                return True
        return False

    def go_on(self) -> None:
        """Past a gap: drops what is held and reads from the next mark of a gzip member."""
        self.held.clear()
        self.gap, self.torn, self.gz, self.fresh = False, False, zlib.decompressobj(31), True
        data = self.waiting
        while (at := data.find(GZIP)) < 0:
            more = self.raw(READ_BYTES)
            if not more:
                self.waiting, self.ended = b"", True
                return
            data = data[-len(GZIP) + 1 :] + more
        self.waiting = data[at:]

    def line(self) -> bytes | None:
        """The next line without its end, None at the end of the file."""
        at = 0
        while (end := self.held.find(b"\n", at)) < 0:
            at = len(self.held)
            if not self._more():
                return None
        out = bytes(self.held[:end]).rstrip(b"\r")
        del self.held[: end + 1]
        return out

    def begins(self) -> bool | None:
        """Whether a record begins here, after empty lines; None at the end of the file."""
        while True:
            while len(self.held) < len(MARK) and self._more():
                pass
            empty = len(self.held[:64]) - len(self.held[:64].lstrip(b"\r\n"))
            if not empty:
                return self.held.startswith(MARK) if self.held else None
            del self.held[:empty]

    def skip(self) -> bool:
        """Drops what comes before the next line that begins like a record, without holding it; False if there is none before the end or a gap."""
        if self.begins():
            return True
        while (at := self.held.find(b"\n" + MARK)) < 0:
            del self.held[: max(0, len(self.held) - len(MARK))]
            if not self._more():
                self.held.clear()
                return False
        del self.held[: at + 1]
        return True

    def sound(self) -> bool:
        """Whether the member of a record that was just read ends well, as far as its end follows here."""
        while len(self.held) < 5 and not self.fresh and self._more():
            pass
        return not self.torn or len(self.held) > 4

    def take(self, n: int) -> bytes:
        """n bytes, fewer at the end of the file."""
        while len(self.held) < n and self._more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def records(raw: Callable[[int], bytes], chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple]:
    """The rows of CHUNKS of one file."""
    src = Bytes(raw)
    while True:
        good = src.begins()
        if good is None:
            if not src.gap:
                return
            yield (None, None, None, 0, b"", 0, None, True, False)
            src.go_on()
            continue
        head: dict[str, str] = {}
        line = src.line() if good else b""
        while good and (line := src.line()) not in (None, b""):
            name, _, value = line.partition(b":")
            head[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
        size, ids = head.get("content-length", ""), tuple(head.get(f"warc-{x}") for x in ("record-id", "type", "target-uri"))
        if line is None or not (size.isascii() and size.isdigit()):
            yield (*ids, 0, b"", 0, None, True, False)
            if line is None and not src.gap:
                return
            if line is None or not src.skip():
                src.go_on() if src.gap else None
            continue
        left, done, k, digest = int(size), 0, 0, hashlib.sha256()
        while True:
            part = src.take(min(chunk_bytes, left))
            digest.update(part)
            done += len(part)
            short = len(part) < min(chunk_bytes, left)
            left -= len(part)
            yield (*ids, k, part, done, digest.hexdigest(), left == 0 or short, not short and (left > 0 or src.sound()))
            if left == 0 or short:
                break
            k += 1
        if short:
            if not src.gap:
                return
            src.go_on()


def read_warc(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row for each chunk of each record of the WARC files in a folder; a task reads one file at a time."""
    fs, local = filesystem(path)
    found = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(local, recursive=True, allow_not_found=True)) if x.is_file and x.path.rpartition(".")[2] in ("warc", "gz") and not x.base_name.startswith((".", "_")))
    prefix = path[: len(path) - len(local)] if path.endswith(local) else ""
    files = spark.createDataFrame([(f"{prefix}{p}",) for p in found], "path string").repartition(len(found)) if found else spark.createDataFrame([], "path string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column("path").to_pylist():
                fs, local = filesystem(p)
                with fs.open_input_stream(local, compression=None) as f:
                    rows, held = [], 0
                    for row in records(f.read, chunk_bytes):
                        rows.append(row)
                        held += len(row[4]) + sum(len(x or "") for x in row[:3]) + 200
                        if held > 2 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return files.transform(C.mapped, run, CHUNKS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=CHUNKS.names)


def write_warc(pages: DataFrame, path: str) -> int:
    """Writes page_id, url, html as gzip WARC resource records; returns the number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, local = filesystem(path)
        fs.create_dir(local, recursive=True)
        part, n, out, size, k = f"part-{task.partitionId():06d}", 0, None, 0, 0
        temp = f"{local}/_{part}-{task.taskAttemptId()}"

        def close() -> None:
            out.close()
            fs.move(temp, f"{local}/{part}-{k:04d}.warc.gz")

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                body = (html or "").encode()
                head = (
                    f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Target-URI: {' '.join((url or '').split())}\r\n"
                    f"WARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n"
                ).encode()
                if out is None:
                    out, size = fs.open_output_stream(temp, compression=None), 0
                gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                for piece in (head, *(body[i : i + READ_BYTES] for i in range(0, len(body), READ_BYTES)), b"\r\n\r\n"):
                    size += out.write(z) if (z := gz.compress(piece)) else 0
                size += out.write(gz.flush())
                n += 1
                if size > FILE_BYTES:
                    close()
                    out, k = None, k + 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return pages.select("page_id", "url", "html").transform(C.mapped, run, "n long").agg(F.sum("n")).first()[0] or 0


def page_chunks(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The pages written as WARC files to the shared folder and read back as chunks."""
    path = C.shared_path(pages.sparkSession, "warc")
    write_warc(pages, path)
    return read_warc(pages.sparkSession, path, chunk_bytes)


ORACLE = f"""
WITH p AS (SELECT page_id, url, hex(encode(html)) AS x FROM pages),
k AS (SELECT *, unnest(range(greatest(1, (length(x) + {2 * CHUNK_BYTES - 1}) // {2 * CHUNK_BYTES}))) AS k FROM p)
SELECT '<urn:page:' || page_id || '>' AS record_id, 'resource' AS warc_type, url AS target_uri, CAST(k AS INTEGER) AS chunk_no,
       unhex(substr(x, {2 * CHUNK_BYTES} * k + 1, {2 * CHUNK_BYTES})) AS payload, least(length(x) // 2, {CHUNK_BYTES} * (k + 1)) AS end_offset,
       sha256(unhex(substr(x, 1, {2 * CHUNK_BYTES} * (k + 1)))) AS digest, {CHUNK_BYTES} * (k + 1) >= length(x) // 2 AS last, true AS complete
FROM k
"""
