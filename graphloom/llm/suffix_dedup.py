"""Removal of repeated byte windows by a depth-limited radix sort of suffixes.

A byte goes when a 200-byte window over it also starts anywhere else.  Suffixes are ordered only
through their first 200 bytes, by most-significant-digit passes; windows that are still in one
group after the last pass are equal, and no others are.

The first pass is distributed: a window's bucket is the least of its hashed 32-byte grams, so equal
windows meet, and a run of windows with one least gram (an anchor) travels as one row of three
numbers without text.  An anchor with a hash of its own ends there.  Anchors whose whole regions,
the bytes that their windows cover, are equal repeat entirely and need no sort: two sums of 64 bits
each, over different hashes of all 32-byte grams of the region at their places, stand for its bytes.  Only differing regions around a common anchor fetch their text; the passes over 8-byte
digits run on their windows, and windows alone in their group drop out after each pass.  A gram of
more than SORT_WINDOWS windows would bring too many together: its windows take the whole content, as 128
bits of hashes, for one digit of the distributed pass, and neighbours in that order are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, buffers, dropped, fold, mix, powers, shuffle_partitions, slices, trimmed, tuned, written

GRAM = 32
WINDOW = 200
#: A gram whose differing regions have more windows has them dealt out by their whole content.
SORT_WINDOWS = 1 << 20

#: Windows that one radix sort in a task takes at once, and bytes of text hashed at once.
SORTED_AT_ONCE, _CHUNK = 1 << 18, 1 << 18
_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        base = 0xD1342543DE82EF95
        _TABLES.extend([powers(base, _CHUNK + 1024), powers(pow(base, -1, 1 << 64), _CHUNK + 1024)])
    return _TABLES[0], _TABLES[1]


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", np.ascontiguousarray(data), 0, (1,))


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum over key[i : i + width] for each i at which it is whole."""
    n = len(key) - width + 1
    pad = np.full(-len(key) % width, ~U64(0))
    blocks = np.concatenate([key, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, off: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Of rows of less than _CHUNK bytes in all: row, first and last window start (in the row), anchor
    position (in the row), anchor hash, two region hashes; one entry for each run of windows."""
    n = len(data) - window + 1
    size = np.diff(off)
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, U64),) * 3
    if n <= 0 or not (size >= window).any():
        return none
    u = _words(data)
    m = len(data) - GRAM + 1
    h = np.zeros(m, U64)
    for j, c in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)):
        w = u[8 * j : 8 * j + m] * U64(c)
        h += (w ^ (w >> U64(29))) * U64(2 * j + 0xFF51AFD7ED558CCD)
    h = mix(h)
    low = U64(_CHUNK - 1)
    key = (h & ~low) | np.arange(m, dtype=U64)
    at = (_least(key, window - GRAM + 1)[:n] & low).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)[:n]
    whole = np.arange(n) + window <= off[1:][row]
    starts = np.flatnonzero(whole)
    if not starts.size:
        return none
    own, anchor = row[starts], at[starts]
    new = np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(own) != 0)])
    lo = np.flatnonzero(new)
    hi = np.concatenate([lo[1:], [len(starts)]]) - 1
    first, last, own, anchor = starts[lo], starts[hi], own[lo], anchor[lo]
    pow_, inverse = _tables()
    shape = ((last - first).astype(U64) << U64(48)) ^ ((anchor - first).astype(U64) << U64(32))
    lanes = []
    for grams in (h, mix(h + U64(0x632BE59BD9B4E019))):  # the grams' hashes are no plain bytes: no pattern of a text cancels out
        total = np.concatenate([np.zeros(1, U64), np.cumsum(grams * pow_[:m])])
        lanes.append(mix((total[last + window - GRAM + 1] - total[first]) * inverse[first] ^ shape))
    return own, first - off[own], last - off[own], anchor - off[own], h[anchor], *lanes


def _chunks(part: pa.RecordBatch, data: np.ndarray, off: np.ndarray, window: int):
    """Rows together, or a long row in pieces that overlap by all but one byte of a window."""
    if len(data) < _CHUNK:
        yield np.arange(part.num_rows), np.zeros(part.num_rows, np.int64), data, off
        return
    for i in range(part.num_rows):
        text = data[off[i] : off[i + 1]]
        for start in range(0, max(1, len(text) - window + 1), _CHUNK - window):
            piece = text[start : start + _CHUNK - 1]
            yield np.array([i]), np.array([start]), piece, np.array([0, len(piece)])


def _anchor_rows(window: int):
    @trimmed
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, limit=_CHUNK - 1):
                for index, start, piece, ends in _chunks(part, data, off, window):
                    own, first, last, anchor, *hashes = anchors(piece, ends, window)
                    first, last, anchor = (x + start[own] for x in (first, last, anchor))
                    place = (first << 20) | ((last - first) << 10) | (anchor - first)
                    row = pa.array(index[own])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(row), part.column("version").take(row), pa.array(place), *(pa.array(x.view(np.int64)) for x in hashes)], ["doc_id", "version", "place", "gram", "region", "check"])

    return rows


def _lanes(u: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the `span` bytes from each position on."""
    one, two = np.full(len(at), span, U64), np.full(len(at), ~U64(span), U64)
    for j in [*range(0, span - 7, 8), *([span - 8] if span % 8 else [])]:
        word = u[at + j]
        one, two = fold(one, word), fold(two, word * U64(0xA0761D6478BD642F))
    return mix(one), mix(two)


def _dealt(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys to deal windows by, and which have an equal one here.  Of equal windows the first keeps
    its key and meets the others' firsts; the rest, judged already, go anywhere."""
    order = np.lexsort((two, one))
    same = (np.diff(one[order]) == 0) & (np.diff(two[order]) == 0)
    later, known = np.zeros(len(one), bool), np.zeros(len(one), bool)
    later[order[1:]] = same
    known[order[1:]] |= same
    known[order[:-1]] |= same
    return np.where(later, mix(one + np.arange(len(one), dtype=U64)), one), known


def _regions(window: int):
    """Rows (places of a document, its text) -> the bytes of each region; of a region around a gram
    with many windows, two hashes of each window instead, which are dealt out by content."""

    @trimmed
    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, off = buffers(batch.column("text"))
            lists = batch.column("probes")
            flat = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            ids, versions, owner_of = batch.column("doc_id"), batch.column("version"), owner
            wide = flat.field("many").to_numpy(zero_copy_only=False)
            for many, step in ((False, 4_000), (True, 1_000)):
                at = np.flatnonzero(wide == many)
                for s in range(0, len(at), step):
                    part, owner = flat.take(pa.array(at[s : s + step])), owner_of[at[s : s + step]]
                    place = part.field("place").to_numpy()
                    count = ((place >> 10) & 1023) + 1
                    n = count - 1 + window
                    first = np.cumsum(n) - n
                    out = data[np.arange(int(n.sum())) + np.repeat(off[owner] + (place >> 20) - first, n)]
                    if many:
                        own = np.repeat(np.arange(len(place)), count)
                        far = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
                        one, two = _lanes(_words(out), first[own] + far, window)
                        key, known = _dealt(one, two)
                        columns = [ids.take(pa.array(owner[own])), versions.take(pa.array(owner[own])), pa.array(((place >> 20)[own] + far) << 20), pa.array(key.view(np.int64)), pa.array(two.view(np.int64)), pa.array(known), part.field("covered").take(pa.array(own)), pa.nulls(len(own), pa.binary())]
                    else:
                        ends = np.concatenate([first, [n.sum()]]).astype(np.int32)
                        body = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(out))])
                        columns = [ids.take(pa.array(owner)), versions.take(pa.array(owner)), part.field("place"), part.field("gram"), pa.array(np.zeros(len(n), np.int64)), pa.array(np.zeros(len(n), bool)), part.field("covered"), body]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "version", "place", "key", "check", "known", "covered", "body"])

    return regions


def _judged(rows: pa.Table, window: int, last: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
    """Windows sorted by (key, check) -> intervals of those that repeat, and the last one, which the
    next rows may equal."""
    rows = rows.combine_chunks()
    key, check = rows.column("key").to_numpy(), rows.column("check").to_numpy()
    known = rows.column("known").to_numpy().copy()
    same = (np.diff(key) == 0) & (np.diff(check) == 0)
    known[1:] |= same
    known[:-1] |= same
    n = len(key) if last else len(key) - 1
    hit = np.flatnonzero(known[:n] & ~rows.column("covered").to_numpy()[:n])
    first = rows.column("place").to_numpy()[hit] >> 20
    ids = [rows.column(c).combine_chunks().take(pa.array(hit)) for c in ("doc_id", "version")]
    rest = None if last else rows.slice(n).set_column(rows.schema.get_field_index("known"), "known", pa.array(known[n:]))
    return pa.RecordBatch.from_arrays([*ids, pa.array(first), pa.array(first + window)], ["doc_id", "version", "first", "end"]), rest


def radix_groups(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Whether the window at each position has an equal one in its bucket: passes over digits of
    eight bytes, most significant first, and a last one of what is left."""
    hit = np.zeros(len(at), bool)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    u = _words(padded)
    alive = np.arange(len(at))
    for depth in range(0, window, 8):
        digit = u[at[alive] + depth]
        if depth + 8 > window:
            digit = digit & U64((1 << (8 * (window - depth))) - 1)
        order = np.lexsort((digit, bucket))
        digit, bucket, alive = digit[order], bucket[order], alive[order]
        new = np.concatenate([[True], (np.diff(bucket) != 0) | (digit[1:] != digit[:-1])]) if len(alive) else np.zeros(0, bool)
        bucket = np.cumsum(new)
        keep = ~(new & np.concatenate([new[1:], [True]])) if len(alive) else new
        alive, bucket = alive[keep], bucket[keep]
        if not len(alive):
            return hit
    hit[alive] = True
    return hit


def _sorted_windows(window: int):
    """Regions sorted by gram, and single windows sorted by their hashes -> intervals of windows that
    repeat, of regions not covered already."""

    def flush(rows: pa.Table) -> pa.RecordBatch:
        data, off = buffers(rows.column("body"))
        place = rows.column("place").to_numpy()
        gram = rows.column("key").to_numpy()
        group = np.cumsum(np.concatenate([[True], np.diff(gram) != 0]))
        count, back = ((place >> 10) & 1023) + 1, place & 1023
        hits = []
        far = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)  # window number in its region
        owner = np.repeat(np.arange(len(place)), count)
        distance = back[owner] - far + 1024  # from window start to anchor: equal windows agree on it
        parts = max(1, -(-len(owner) // SORTED_AT_ONCE))
        hit = np.zeros(len(owner), bool)
        for part in range(parts):
            own = np.flatnonzero(distance % parts == part) if parts > 1 else np.arange(len(owner))
            hit[own] = radix_groups(data, off[owner[own]] + far[own], group[owner[own]] * 4096 + distance[own], window)
        hit &= ~rows.column("covered").to_numpy()[owner]
        hits = np.flatnonzero(hit)
        if not hits.size:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, ["doc_id", "version", "first", "end"])
        new = np.concatenate([[True], (np.diff(hits) != 1) | (np.diff(owner[hits]) != 0)])
        lo = hits[new]
        hi = hits[np.concatenate([new[1:], [True]])]
        base = place[owner[lo]] >> 20
        ids = [rows.column(c).combine_chunks().take(pa.array(owner[lo])) for c in ("doc_id", "version")]
        return pa.RecordBatch.from_arrays([*ids, pa.array(base + far[lo]), pa.array(base + far[hi] + window)], ["doc_id", "version", "first", "end"])

    @trimmed
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held, window_held = [], 0, None
        for batch in batches:
            alone = pc.is_null(batch.column("body"))
            singles, batch = batch.filter(alone), batch.filter(pc.invert(alone))
            if singles.num_rows:
                rows = pa.Table.from_batches([singles])
                found, window_held = _judged(rows if window_held is None else pa.concat_tables([window_held, rows]), window, False)
                yield found
            if not batch.num_rows:
                continue
            held.append(batch)
            rows_held += batch.num_rows
            if rows_held * 80 < SORTED_AT_ONCE:
                continue
            rows = pa.Table.from_batches(held)
            gram = rows.column("key").to_numpy()
            cuts = np.flatnonzero(np.diff(gram))
            if not cuts.size:
                continue
            cut = int(cuts[-1]) + 1
            yield flush(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
            rows_held = len(gram) - cut
        if held:
            yield flush(pa.Table.from_batches(held))
        if window_held is not None:
            yield _judged(window_held, window, True)[0]

    return windows


#: What names a row of a table of documents.
KEY = ["doc_id", "version"]


def _versioned(docs: DataFrame, *carry: str) -> DataFrame:
    """docs with a bigint doc_id and a version that tells texts of one doc_id apart, nulls among them.
    Where no doc_id repeats, which one pass over the ids says, the version is a constant."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)
    unique = docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    version = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", version.alias("version"), "text", *carry)


def _same(a: DataFrame, b: DataFrame):
    return a.doc_id.eqNullSafe(b.doc_id) & (a.version == b.version)


def repeated_spans(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, version, text) -> (doc_id, version, first, end): byte intervals, perhaps overlapping,
    that together cover exactly the bytes of windows that start more than once.  doc_id and version
    name a text; rows with the same two are copies, and count as such.  `carry` names columns of docs
    that a caller sends along with its texts by that key: with them here, both use one exchange."""
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(*KEY, "text").mapInArrow(_anchor_rows(window), "doc_id long, version long, place long, gram long, region long, check long")
    # counts combine before they are dealt out; written, they meet the rows in merge joins of plain
    # exchanges, in which a hot gram or region is split over tasks
    differ = (F.min("region") != F.max("region")) | (F.min("check") != F.max("check"))
    grams = written(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("_n"), differ.alias("several")).where("_n > 1").select("gram", "several"), "grams")
    marked = written(rows.join(grams.hint("merge"), "gram"), "repeats", 2 << 20)
    dropped(grams)
    mixed = marked.where("several")
    of = ["gram", "region", "check"]
    one = [F.first(c).alias(c) for c in (*KEY, "place")]
    by_region = written(mixed.groupBy(*of).agg(*one, F.count(F.lit(1)).alias("_n")), "regions")
    wide = by_region.groupBy("gram").agg(F.sum(F.shiftright("place", 10).bitwiseAND(1023) + 1).alias("_windows")).where(F.col("_windows") > SORT_WINDOWS)
    wide = written(wide.select("gram", F.lit(True).alias("_many")), "wide")
    probes = by_region.join(wide.hint("merge"), "gram", "left").select(*KEY, F.struct("place", "gram", (F.col("_n") > 1).alias("covered"), F.coalesce("_many", F.lit(False)).alias("many")).alias("probe"))
    probes = probes.groupBy(*KEY).agg(F.collect_list("probe").alias("probes"))  # regions of one text, each once
    texts = docs.repartition(n, *KEY)
    regions = probes.join(texts, _same(probes, texts)).select(probes.doc_id, probes.version, "probes", "text", *carry)
    regions = regions.mapInArrow(_regions(window), "doc_id long, version long, place long, key long, check long, known boolean, covered boolean, body binary")
    found = regions.repartition("key").sortWithinPartitions("key", "check").mapInArrow(_sorted_windows(window), "doc_id long, version long, first long, end long")
    again = by_region.where("_n > 1").select(*of)
    whole = marked.where("not several").select(*KEY, "place").unionByName(mixed.join(again.hint("merge"), of).select(*KEY, "place"))
    first = F.shiftright("place", 20)
    whole = whole.select(*KEY, first.alias("first"), (first + F.shiftright("place", 10).bitwiseAND(1023) + window).alias("end"))
    return whole.unionByName(found)


def merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, ascending, non-touching union of intervals."""
    if not len(first):
        return first, end
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], first[1:] > end[:-1]])
    return first[new], end[np.concatenate([new[1:], [True]])]


def _cut(whole_characters: bool, keep: tuple[str, ...] = ()):
    @trimmed
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column("text"))
            spans = batch.column("spans")
            bounds = spans.offsets.to_numpy() if batch.num_rows else np.zeros(1, int)
            flat = spans.flatten()
            first, end = flat.field("first").to_numpy(zero_copy_only=False), flat.field("end").to_numpy(zero_copy_only=False)
            n, removed, runs, kept = [], [], [], []
            at = bounds - bounds[0]
            for i in range(batch.num_rows):
                text = data[off[i] : off[i + 1]]
                lo, hi = merged(first[at[i] : at[i + 1]], end[at[i] : at[i + 1]])
                if whole_characters and len(lo):  # a span never splits a character of what stays
                    head = np.concatenate([(text & 0xC0) != 0x80, [True]])
                    starts = np.flatnonzero(head)
                    lo, hi = starts[np.searchsorted(starts, lo)], starts[np.searchsorted(starts, hi, "right") - 1]
                    lo, hi = lo[hi > lo], hi[hi > lo]
                mask = np.ones(len(text) + 1, np.int8)
                if len(lo):
                    step = np.zeros(len(text) + 1, np.int8)
                    step[lo] += 1
                    step[hi] -= 1
                    mask = np.cumsum(step, dtype=np.int8) == 0
                kept.append(text[mask[:-1].astype(bool)].tobytes())
                n.append(len(text))
                removed.append(int((hi - lo).sum()))
                runs.append(len(lo))
            out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())]
            if whole_characters:
                out.append(pa.array(kept, pa.binary()).cast(pa.string()))
            else:
                out.append(pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
            out += [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text" if whole_characters else "kept_sha256", *keep])

    return cut


def _applied(docs: DataFrame, window: int, texts: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    docs = _versioned(tuned(docs), *keep)
    spans = repeated_spans(docs, window, keep)
    # a set: rows that are copies bring the same spans, and a text has no more than it has bytes
    of = spans.groupBy(*KEY).agg(F.collect_set(F.struct("first", "end")).alias("_spans"))
    rows = docs.repartition(shuffle_partitions(docs.sparkSession), *KEY)
    rows = rows.join(of, _same(rows, of), "left").select(rows.doc_id, "text", "_spans", *keep)
    none = F.expr("array()").cast("array<struct<first:bigint,end:bigint>>")
    rows = rows.select("doc_id", "text", F.coalesce("_spans", none).alias("spans"), *keep)
    last = "kept_text string" if texts else "kept_sha256 string"
    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep]
    return rows.mapInArrow(_cut(texts, keep), ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long", last, *kinds]))


def suffix_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row.

    Texts are UTF-8 bytes; a null text is empty; texts shorter than the window keep all.  Windows are
    judged on the input, matches stay within a document, and every copy goes, the first included.
    Each row is a document of its own, whether or not its doc_id, null or not, occurs again.  An empty
    table gives an empty result.
    """
    return _applied(docs, window, False)


def without_repeats(docs: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_text) and the columns in keep: the text that stays;
    a span that begins or ends inside a character is shortened to whole characters."""
    return _applied(docs, window, True, keep)
