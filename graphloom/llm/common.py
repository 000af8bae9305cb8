"""Shared pieces of the training-data operators: session folders, Arrow buffers, word hashes.

Every operator reads only the columns it names, so further columns of the input, whatever they
are called, change nothing.  Texts travel as Arrow batches; numpy works on their byte buffers.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Bytes of text that numpy handles at once.
SLICE_BYTES = 1 << 20

_own_dir: dict[str, str] = {}

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or _own_dir.get(spark.sparkContext.applicationId)
    if not path:
        path = _own_dir[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    return path


def written(df: DataFrame, name: str, group_bytes: int = 16 << 20) -> DataFrame:
    """Writes df to a new table in the shared folder and reads it back: this cuts the lineage, and
    a lost executor costs no recomputation.  The table goes when the driver ends, unless dropped()
    before.  Small row groups: values may be large, and a writer holds a group; where one task may
    write a hot key's rows, smaller ones let many tasks read them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", group_bytes).parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._graphloom_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tuned(df: DataFrame) -> DataFrame:
    """Bounds the session's Arrow batches by bytes: texts may be long, and a worker holds a batch."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function over batches that gives freed memory back when its task ends: idle workers of earlier
    stages stay beside those of the next one."""

    @functools.wraps(run)
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # a C library without it
                ctypes.CDLL(None).malloc_trim(0)

    return own


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column, end to end, and the rows' offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows with about `limit` bytes of text, a longer text alone."""
    data, off = buffers(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start), data[off[start] : off[end]], off[start : end + 1] - off[start]
        start = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: xor-shifts and odd multipliers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW = powers(0x9E3779B97F4A7C15, 1 << 12)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ and, by row, the index of its first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    word = ~_SPACE[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = before[-1] = False
    before[1:-1] = word[:-1]
    before[off[:-1]] = False
    starts = np.flatnonzero(word & ~before[:-1])
    after = np.empty(len(data) + 1, bool)
    after[:-1] = word
    after[-1] = False
    after[off[1:]] = False
    ends = np.flatnonzero(word & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased first."""
    global _POW
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    if size.max() >= len(_POW):
        _POW = powers(0x9E3779B97F4A7C15, int(size.max()) * 2)
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    bytes_ = data[at + np.repeat(starts, size)]
    if lower:
        bytes_ = _LOWER[bytes_]
    return mix(np.add.reduceat((bytes_.astype(U64) + U64(1)) * _POW[at], first) ^ (size.astype(U64) << U64(56)))


def fold(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of each row, in order, and the rows' offsets; a row with
    fewer words has one run, of them all, and a row without words none."""
    n = np.diff(first)
    runs = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    off = np.concatenate([[0], np.cumsum(runs)])
    out = np.zeros(int(off[-1]), U64)
    full = n >= size
    if full.any():
        at = np.arange(int(runs[full].sum())) - np.repeat(np.cumsum(runs[full]) - runs[full], runs[full])
        src = at + np.repeat(first[:-1][full], runs[full])
        h = np.full(len(src), size, U64)
        for j in range(size):
            h = fold(h, words[src + j])
        out[at + np.repeat(off[:-1][full], runs[full])] = mix(h)
    for k in range(1, size):
        if (rows := np.flatnonzero(n == k)).size:
            h = np.full(len(rows), k, U64)
            for j in range(k):
                h = fold(h, words[first[rows] + j])
            out[off[rows]] = mix(h)
    return out, off


def text_shingles(data: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(data, off)
    return shingle_hashes(word_hashes(data, starts, ends), first, size)
