"""Packing into sequences by Karmarkar-Karp multiway differencing.

Documents stream through each partition.  The full windows of a long document go out at once; what
is left of each document, less than a window, is gathered into groups.  A group is dealt to k windows by
multiway differencing: of all partial partitions the two with the largest spread are merged, the
fullest window of one with the emptiest of the other, which gives near-equal windows.  k starts at what
the tokens need and rises whenever a window exceeds the capacity.  So only documents longer than a
window are cut, and nothing is shuffled.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, trimmed, tuned
from .tokenizer_files import piece_table

CAPACITY = 2048
#: Tokens of the remainders that are packed together.
GROUP_TOKENS = 1 << 18
#: Full windows of one document that are handed on together.
FULL_AT_ONCE = 256


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Divides the items into k parts of near-equal sums: each part as a list of item numbers.
    A partial partition is kept sparse, with its empty parts implied, so merging costs its items."""
    if k <= 0:
        return []
    # an entry: (-spread, order, parts as (sum, items) ascending by sum; k - len(parts) further ones are empty)
    heap = [(-n, i, [(n, [i])]) for i, n in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        # the fullest of one meets the emptiest of the other; where one has an empty part, nothing merges
        free = k - len(a) - len(b)
        if free >= 0:
            parts = a + b
        else:
            over = -free
            a, b = sorted(a, key=lambda p: p[0]), sorted(b, key=lambda p: p[0])
            # b descending is added to a ascending, both padded with empty parts to k
            low_a, low_b = a[:over], b[:over][::-1]
            joined = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(low_a, low_b)]
            parts = joined + a[over:] + b[over:]
        if len(parts) == k:
            least = min(p[0] for p in parts)
            if least > 0:  # only differences count from here on; the sums are found again at the end
                parts = [(s - least, items) for s, items in parts]
        spread = max(p[0] for p in parts) - (min(p[0] for p in parts) if len(parts) == k else 0)
        heapq.heappush(heap, (-spread, order, parts))
        order += 1
    parts = [items for _, items in heap[0][2]] if heap else []
    return parts + [[] for _ in range(k - len(parts))]


def pack(sizes: list[int], capacity: int = CAPACITY, spare: float = 0.0) -> list[list[int]]:
    """Windows of whole items, none larger than the capacity, as lists of item numbers.  `spare` is a
    share of windows beyond what the tokens need at which a caller expects to end up: it saves trials."""
    if not sizes:
        return []
    k = min(len(sizes), -(-sum(sizes) // capacity) + int(spare * sum(sizes) / capacity))
    while True:
        windows = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return [w for w in windows if w]
        k += max(1, k // 64)


def _packed(path: str, end: int, capacity: int, with_ids: bool, forget: bool = False):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    @trimmed
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path, bare=True)
        sequence = TaskContext.get().partitionId() << 36
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids
        held: list[tuple] = []  # what is left of documents: doc_id, start, ids, length of the whole
        rest, spare = 0, 0.0

        def out(windows: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal sequence
            cols: list[list] = [[] for _ in names]
            for window in windows:
                offset = 0
                for doc, start, own, whole in window:
                    for c, x in zip(cols, (doc, start, len(own), zlib.crc32(own.tobytes()), whole, sequence, offset, own)):
                        c.append(x)
                    offset += len(own)
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        def dealt() -> pa.RecordBatch:
            nonlocal spare
            windows = pack([len(x[2]) for x in held], capacity, spare)
            # the next group begins a step or two below the share that this one needed
            spare = max(0.0, len(windows) * capacity / rest - 1 - 2 / 64)
            return out([[held[i] for i in w] for w in windows])

        for batch in batches:
            for part, _, _ in slices(batch):
                flat, off = table.encode([t or "" for t in part.column("text").to_pylist()], end)
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    own, whole = flat[off[i] : off[i + 1]], int(off[i + 1] - off[i])
                    cut = whole // capacity * capacity
                    for s in range(0, cut, FULL_AT_ONCE * capacity):
                        yield out([[(doc, w, own[w : w + capacity], whole)] for w in range(s, min(cut, s + FULL_AT_ONCE * capacity), capacity)])
                    if cut < whole:
                        held.append((doc, cut, own[cut:].copy(), whole))  # a copy: the others' ids needn't stay
                        rest += whole - cut
                    if rest >= GROUP_TOKENS:
                        yield dealt()
                        held, rest = [], 0
        if held:
            yield dealt()
        if forget:
            table.forget()

    return packed


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY, with_ids: bool = False, forget: bool = False) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), and
    the pieces' ids with with_ids: one row for each piece.

    Null and empty texts have the end id alone; a document of any length is cut into full windows and a
    rest, and a shorter one stays whole; rows that repeat a
    doc_id, or have none, are documents of their own.  No rows, no pieces.  A task that runs again
    makes the same sequences, from the same rows in the same order.  With `forget` a worker drops the
    ids of the words it has met after each task: for jobs in which other stages share the workers.
    """
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<bigint>" * with_ids
    return tuned(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packed(tokenizer, end, capacity, with_ids, forget), kind)
