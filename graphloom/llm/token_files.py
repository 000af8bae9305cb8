"""Token ids in bit-plane files.

Ids of whole documents are collected into segments.  A segment is one binary value: blocks of
BLOCK ids, each transposed into byte planes (all lowest bytes, then all second ones, ...) or bit
planes and each plane compressed with zstandard, then an index of the chunks, then its length.  A
table of segments, one row each with the documents' ids and lengths, is the file set; Spark's
own writer puts it into a folder that all executors share, so a lost task leaves nothing half-written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, slices, tuned, written
from .tokenizer_files import piece_table

MAGIC = b"GLBP1"
#: Ids of a block, and ids of a segment beyond which no further document is added.
BLOCK, SEGMENT = 1 << 14, 1 << 19
LEVEL = 3


def write_planes(ids: np.ndarray, block: int = BLOCK, bits: bool = False, level: int = LEVEL) -> bytes:
    """Any array of unsigned 32-bit ids as one binary value."""
    ids = np.ascontiguousarray(ids, "<u4")
    pack = zstandard.ZstdCompressor(level=level)
    out, index = [MAGIC, struct.pack("<?IQ", bits, block, len(ids))], []
    for s in range(0, len(ids), block):
        own = ids[s : s + block]
        planes = own.view(np.uint8).reshape(-1, 4).T
        if bits:
            planes = np.packbits(np.unpackbits(own.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").T, axis=1, bitorder="little")
        chunks = [pack.compress(np.ascontiguousarray(p).tobytes()) if p.any() else b"" for p in planes]
        out += chunks
        index += [len(c) for c in chunks]
    out += [np.array(index, "<u4").tobytes(), struct.pack("<Q", len(index))]
    return b"".join(out)


def read_planes(raw: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first..last of a segment; only the blocks that hold them are decompressed."""
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a segment of token planes")
    head = struct.calcsize("<?IQ")
    bits, block, n = struct.unpack_from("<?IQ", raw, len(MAGIC))
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    (m,) = struct.unpack_from("<Q", raw, len(raw) - 8)
    sizes = np.frombuffer(raw, "<u4", m, len(raw) - 8 - 4 * m).astype(np.int64)
    starts = len(MAGIC) + head + np.concatenate([[0], np.cumsum(sizes)])
    per, unpack, out = 32 if bits else 4, zstandard.ZstdDecompressor(), []
    for b in range(first // block, -(-last // block)):
        count = min(block, n - b * block)
        width = -(-count // 8) if bits else count
        planes = np.zeros((per, width), np.uint8)
        for k in range(per):
            if size := sizes[b * per + k]:
                at = starts[b * per + k]
                planes[k] = np.frombuffer(unpack.decompress(raw[at : at + size], max_output_size=width), np.uint8)
        if bits:
            planes = np.packbits(np.unpackbits(planes, axis=1, bitorder="little")[:, :count].T, axis=1, bitorder="little").T
        out.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
    from_ = first // block * block
    return np.concatenate(out)[first - from_ : last - from_]


_KIND = "seq long, within long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, planes binary"


def _segments(path: str, end: int, bits: bool):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        docs, lengths, ids, held, seq, within = [], [], [], 0, 0, 0

        def out() -> pa.RecordBatch:
            row = [[seq], [within], [held], [docs], [lengths], [write_planes(np.concatenate(ids), bits=bits)]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], ["seq", "within", "n_ids", "doc_ids", "lengths", "planes"])

        for batch in batches:
            for part, _, _ in slices(batch):
                flat, off = table.encode([t or "" for t in part.column("text").to_pylist()], end)
                own = part.column("doc_id").to_pylist()
                begin = 0
                for i in range(len(own)):
                    docs.append(own[i])
                    lengths.append(int(off[i + 1] - off[i]))
                    held += lengths[-1]
                    if held >= SEGMENT:
                        ids.append(flat[off[begin] : off[i + 1]])
                        yield out()
                        docs, lengths, ids, held, seq, within, begin = [], [], [], 0, seq + 1, within + held, i + 1
                if begin < len(own):
                    ids.append(flat[off[begin] : off[-1]])
        if docs:
            yield out()

    return segments


def write_token_files(docs: DataFrame, tokenizer: str, end: int = 0, bits: bool = False, path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> the table of segments written to `path`, or to a new one in the shared
    folder: (shard, seq, within, n_ids, start, doc_ids, lengths, planes), in ascending doc_id by (shard, seq).

    Null and empty texts have the end id alone.  A null doc_id comes first; rows that repeat a doc_id
    stay, ordered by a hash of the text, then by it.  Documents of any length lie in one segment each.  No rows, no segments.
    """
    spark = docs.sparkSession
    rows = tuned(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # an id that many rows have is spread by a hash of their texts
    rows = rows.withColumn("_hash", F.xxhash64("text")).repartitionByRange(shuffle_partitions(spark), "doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")
    made = rows.select("doc_id", "text").mapInArrow(_segments(tokenizer, end, bits), _KIND).withColumn("shard", F.spark_partition_id())
    if path is None:
        table = written(made, "tokens")
    else:
        made.write.option("parquet.block.size", 16 << 20).parquet(path)
        table = spark.read.parquet(path)
    return _with_starts(table)


def read_token_files(spark, path: str) -> DataFrame:
    """The table of segments that write_token_files put into `path`."""
    return _with_starts(spark.read.parquet(path))


def _with_starts(table: DataFrame) -> DataFrame:
    """Adds the number of ids before each segment.  Only the shards' sums are joined, of which there
    are as many as partitions, whatever the data."""
    shards = table.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("_before"))
    return table.join(F.broadcast(shards), "shard").withColumn("start", F.col("_before") + F.col("within")).drop("_before")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = read_planes(batch.column("planes")[i].as_py())
            lengths = np.array(batch.column("lengths")[i].as_py(), np.int64)
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
            docs = batch.column("doc_ids")[i].values
            yield pa.RecordBatch.from_arrays([docs, pa.array(batch.column("start")[i].as_py() + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the segments."""
    return segments.select("start", "doc_ids", "lengths", "planes").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
