"""What the operators share: table access, the shared folder, and vectorised tokenising and hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Text taken at once by a worker; only bounds memory, results do not depend on it.
BLOCK_BYTES = 2 << 20


#: What Spark hands a worker at once, so that long texts and many rows fit in its memory; results do not depend on it.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


#: What operators hold in a worker beyond a task, by name, and how to drop it.
CACHES: dict[str, Callable[[], None]] = {}


def begin(keeps: str) -> None:
    """Drops what other operators left in this worker, which lives on from stage to stage."""
    pa.set_memory_pool(pa.system_memory_pool())  # gives back what a batch took
    left = [x for x in CACHES if x != keeps]
    for name in left:
        CACHES.pop(name)()
    if left:
        release()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, keeps: str = "") -> DataFrame:
    """df.mapInArrow with batches of bounded size, unless the session names a size of its own. keeps: the name of what run leaves in CACHES."""
    conf = df.sparkSession.conf
    if re.sub(r"\D", "", str(conf.get(BATCH))) == str(64 << 20):  # the default
        conf.set(BATCH, str(BATCH_BYTES))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(keeps)
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(bounded, schema)


def release() -> None:
    """Gives the memory that a task took back to the system, as workers live on; where the C library can't, it stays."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir.

    Only a local session may leave it unset; it then gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            path = jvm.get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            path = "file://" + tempfile.mkdtemp(prefix="srcplan-")
            spark.sparkContext.setCheckpointDir(path)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    elif spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


_roots: set[str] = set()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; everything this application wrote there is removed when it ends."""
    root = f"{shared_dir(spark)}/srcplan-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)

        def clean() -> None:
            try:
                jvm = spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(root)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
            except Exception:  # the JVM may have ended first; the folder is then left to its owner
                return

        atexit.register(clean)
    return f"{root}/{uuid.uuid4().hex[:12]}-{name}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: So many ids are sent to all workers to pick documents (about 32 bytes each); more are joined in a shuffle.
SMALL_IDS = 2_000_000


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose key, a long, is not among ids (one column)."""
    ids = saved(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= SMALL_IDS else ids, key, "left_anti")


# ---- hashing and tokens


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def _byte_table() -> np.ndarray:
    t = np.zeros(256, U64)
    kept = [*range(48, 58), *range(97, 123), 95, *range(128, 256)]
    t[kept] = mix(np.array(kept, U64) + U64(0x9E3779B97F4A7C15)) | U64(1)
    for c in range(65, 91):
        t[c] = t[c + 32]
    return t


#: Bytes that belong to words: ASCII letters, digits, underscore and every byte of a non-ASCII character.
_BYTE = _byte_table()
_IN = _BYTE != 0
_BASE = 0x8A5CD789635D2DFF
_INV = pow(_BASE, -1, 1 << 64)
_pow: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        m = max(n, 2 * len(_pow[0]), 1 << 16)
        for k, b in enumerate((_BASE, _INV)):
            p = np.full(m, b, U64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0], _pow[1]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other with a blank between, and where each begins (one more at the end). Nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()))
    if isinstance(joined, pa.ChunkedArray):
        joined = joined.combine_chunks()
    bufs = joined.buffers()
    off = np.frombuffer(bufs[1], np.int64, len(joined) + 1, joined.offset * 8)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and len(joined) else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text plus the total, first and last+1 byte of each word, bytes of the buffer's texts).

    A word is a maximal run of word bytes in the lower-cased text.
    """
    if lower:
        texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    data, off = buffer_of(texts)
    inside = _IN[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1 if len(data) else np.zeros(0, np.int64)
    if len(data) and inside[0]:
        edge = np.concatenate([[0], edge])
    # every text ends with a blank, so runs are closed
    start, end = edge[0::2], edge[1::2]
    return hash_spans(data, start, end, _BYTE), np.searchsorted(start, off), start, end, off


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span, by the table's value of each byte; spans ascend and do not overlap."""
    h = np.empty(len(start), U64)
    step = 1 << 19
    at = 0
    while at < len(start):  # in pieces, so that the powers stay in the cache
        lo = start[at]
        to = max(at + 1, int(np.searchsorted(end, lo + step, "right")))
        hi = end[to - 1]
        p, inv = _powers(int(hi - lo) + 1)
        acc = np.zeros(hi - lo + 1, U64)
        np.cumsum(table[data[lo:hi]] * p[: hi - lo], out=acc[1:])
        h[at:to] = (acc[end[at:to] - lo] - acc[start[at:to] - lo]) * inv[start[at:to] - lo]
        at = to
    return mix(h)


def kgrams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each window of k word hashes; windows run across texts, the caller leaves those out."""
    n = max(0, len(h) - k + 1)
    out = np.full(n, seed, U64)
    for j in range(k):
        out *= U64(0xC2B2AE3D27D4EB4F)
        out += h[j : j + n]
        out ^= out >> U64(29)
    return mix(out)


def with_text(batch: pa.RecordBatch, row: str = "row") -> pa.RecordBatch:
    """The batch with the text of its rows as a column of its own, which shares their memory."""
    return pa.RecordBatch.from_arrays([*batch.columns, batch.column(row).field("text")], names=[*batch.schema.names, "text"])


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES):
    """Slices of the batch of about `limit` bytes of text each; one text is never split."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from all values in a row and how many each row has."""
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values, kind))
