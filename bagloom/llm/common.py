"""Byte-level text kernels, blob packing and table hand-over shared by the operators.

Text is handled as Arrow buffers (one byte array and offsets for a whole batch), so the
kernels run in numpy without a Python object per word. Nulls count as empty texts unless
an operator says otherwise.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: bytes that separate words
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_K1, _K2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * _K1
        x = (x ^ (x >> U(27))) * _K2
    return x ^ (x >> U(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty. offsets start at 0."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words in each text). Words are runs of bytes outside SPACE and never cross texts."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    inside = ~SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    head = inside.copy()
    head[1:] &= ~inside[:-1] | first[1:n]
    tail = inside
    tail[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def padded(data: np.ndarray) -> np.ndarray:
    """A copy with 8 spare bytes, as windows8 needs."""
    out = np.zeros(len(data) + 8, np.uint8)
    out[: len(data)] = data
    return out


def windows8(buffer: np.ndarray) -> np.ndarray:
    """The 8-byte little-endian word that starts at each byte of a padded buffer."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer, 0, (1,))


def hash_spans(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of a padded buffer, eight bytes a round over all spans at once."""
    with np.errstate(over="ignore"):
        out = mix(lengths.astype(U) + U(0x9E3779B97F4A7C15) * U(seed + 1))
        view, live, at = windows8(buffer), np.arange(len(starts)), 0
        while len(live):
            left = lengths[live] - at
            if at or (left <= 0).any():
                live, left = live[left > 0], left[left > 0]
                if not len(live):
                    break
            got = view[starts[live] + at]
            short = left < 8
            got[short] &= (U(1) << (left[short].astype(U) * U(8))) - U(1)
            out[live] = mix(out[live] * U(0x9FB21C651E98DF25) + got)
            at += 8
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned or float arrays as one zstd frame, stored as byte planes, which compress well."""
    heads, parts = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        if a.dtype.kind in "ui" and len(a):
            top = int(a.max())
            wide = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
            a = a.astype(f"<u{wide}")
        heads.append((a.dtype.str, len(a)))
        parts.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
    head = ";".join(f"{d},{n}" for d, n in heads).encode()
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + n
    for item in raw[4:at].decode().split(";"):
        d, k = item.split(",")
        kind, k = np.dtype(d), int(k)
        size = k * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, k)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(k))
        at += size
    return out


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts have at most limit bytes together, one row at least."""
    _, offsets = utf8(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def shards(spark: SparkSession) -> int:
    """How many parts a hashed exchange has: the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Set here only where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jvm.get() if jvm.isDefined() else ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Tables:
    """Intermediate tables of one run, written below the shared folder so that no lost executor can take them along."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shared_path = path
        return out

    def sweep(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of plans that nothing holds any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, df: DataFrame) -> None:
        """Deletes a written table that nothing reads any more."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._shared_path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def release() -> None:
    """Gives freed memory back to the system; a Python worker outlives its tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """run (over batches, for mapInArrow) with its memory given back at the end of the task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def lean_group(run):
    """run (over one group, for applyInArrow) with its memory given back after each large group."""

    def wrapped(group):
        large = group.nbytes > 1 << 20
        try:
            return run(group)
        finally:
            if large:
                del group
                release()

    return wrapped


def crc_mod(column: str, modulus: int):
    """crc32 of the id's decimal text modulo modulus; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
