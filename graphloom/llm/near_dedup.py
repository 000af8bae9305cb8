"""MinHash near-dedup by a chosen-path set similarity join.

Documents are sets of five-word shingles.  Each set gets a signature of minwise tokens.  A tree
node picks a few signature positions by its own hash, and a document goes to one child for each of
them, named by its token there; independent trees repeat this.  A pair of similarity s stays
together down any number of levels with at least the survival chance of a branching process with
Binomial(BRANCH, s) children: at 0.75 one tree of three branches misses 1.9 % and TREES = 4 of them
miss about 1e-7.  Nodes of up to NODE_LIMIT documents are compared exhaustively; larger ones
are collapsed first and branch again only where that leaves too many documents apart, so nothing is
capped.  Nothing but numbers and signatures moves down the trees.

Links are confirmed on the full sets.  Equal sets meet first, by a 128-bit digest, in an aggregation
that combines before its shuffle.  Then a spanning forest of each node's likely links is confirmed.
In a node that is too large its documents are dealt into blocks, each once; the roots of the blocks'
forests meet in further rounds.  So a group of near copies becomes one component at about the cost
of its size, and all that is left to compare is documents of different components: those outside a
node's largest component go to all blocks of it, it to none of its own.  What may link components
is gathered by clusters of such components, each document once, and compared on full sets there, again
the smaller part against blocks of the largest component.  No pairs of a group are written out and
no link between components is lost.  Only where more than NODE_LIMIT documents outside the largest
component stay together at MAX_DEPTH, all alike but not linked, do rows grow with chunks of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, dropped, mix, shuffle_partitions, slices, text_shingles, trimmed, tuned, written
from .components import connected_components

SIGNATURE = 128
TREES, BRANCH = 4, 3
NODE_LIMIT, MAX_DEPTH = 4096, 4
#: Equal signature bytes out of SIGNATURE: likely links, and the least that a link of 0.75 can show
#: (96 expected, standard deviation 4.9).
LIKELY, POSSIBLE = 90, 70
#: Shingles of a cluster that one task compares.
CLUSTER_SHINGLES = 4_000_000

_RNG = np.random.default_rng(7)
_XOR, _MUL = (_RNG.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64) for _ in range(2))
_MUL |= U64(1)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _binary_rows(a: np.ndarray) -> pa.Array:
    """The rows of a two-dimensional array as binary values."""
    width = a.shape[1] * a.itemsize
    off = np.arange(len(a) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(a))])


def _rows_binary(column: pa.Array, dtype) -> np.ndarray:
    from .common import buffers

    data, off = buffers(column)
    width = int(off[1] - off[0]) if len(off) > 1 else SIGNATURE * np.dtype(dtype).itemsize
    return np.ascontiguousarray(data).view(dtype).reshape(len(off) - 1, width // np.dtype(dtype).itemsize)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set, as 32-bit hashes of the 64-bit minima."""
    low = np.full(SIGNATURE, ~U64(0))
    for i in range(0, len(hashes), 2048):
        np.minimum(low, ((hashes[i : i + 2048, None] ^ _XOR) * _MUL).min(axis=0), out=low)
    return (mix(low) >> U64(32)).astype(np.uint32)


@trimmed
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, off in slices(batch):
            hashes, first = text_shingles(data, off)
            n, digest, sig = np.zeros(part.num_rows, np.int64), np.zeros((2, part.num_rows), U64), np.zeros((part.num_rows, SIGNATURE), np.uint32)
            for i in range(part.num_rows):
                if (own := np.unique(hashes[first[i] : first[i + 1]])).size:
                    n[i], sig[i] = len(own), signature(own)
                    digest[0, i], digest[1, i] = own.sum(), mix(own).sum()
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("version"), pa.array(n), _long(digest[0]), _long(digest[1]), _binary_rows(sig)], ["doc_id", "version", "n_shingles", "da", "db", "sig"])


def _children(keys: np.ndarray, sig: np.ndarray, tree: bool) -> tuple[np.ndarray, np.ndarray]:
    """Child keys of each row: BRANCH positions chosen by the node's key; index of the parent row."""
    out = []
    for b in range(TREES * BRANCH if tree else BRANCH):
        # different positions for the branches of a node, an arithmetic walk from a place the key picks
        seed = mix(keys ^ U64(0xA5A5A5A5)) if not tree else np.full(len(sig), (b // BRANCH) * 1_000_003 + 17, U64)
        seed = mix(seed) if tree else seed
        at = ((seed >> U64(33)) + U64(b % BRANCH) * ((seed & U64(62)) + U64(1))) % U64(SIGNATURE)
        token = sig[np.arange(len(sig)), at.astype(np.int64)].astype(U64)
        out.append(mix(mix(seed + U64(b)) ^ (token * U64(0x9E3779B97F4A7C15))))
    return np.concatenate(out), np.tile(np.arange(len(sig)), len(out))


def _grow(tree: bool):
    @trimmed
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sig = _rows_binary(batch.column("sig"), np.uint32)
                keys = np.zeros(len(sig), U64) if tree else batch.column("key").to_numpy(zero_copy_only=False).view(U64)
                child, parent = _children(keys, sig, tree)
                yield pa.RecordBatch.from_arrays([_long(child), batch.column("rep").take(pa.array(parent))], ["key", "rep"])

    return grow


@trimmed
def _bytes_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column("rep"), _binary_rows((_rows_binary(batch.column("sig"), np.uint32) >> 24).astype(np.uint8))], ["rep", "sig8"])


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict]:
    """Runs of equal (key, block) in sorted rows; runs may cross batches."""
    held: list[pa.RecordBatch] = []

    def out(rows: pa.Table) -> dict:
        return {n: rows.column(n) for n in names}

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("key").to_numpy(zero_copy_only=False)
        block = batch.column("block").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
        if held and (held[-1].column("key")[0].as_py(), held[-1].column("block")[0].as_py()) != (int(key[0]), int(block[0])):
            yield out(pa.Table.from_batches(held))
            held = []
        edges = [0, *cuts.tolist(), len(key)]
        for s, e in zip(edges[:-1], edges[1:]):
            if e < len(key):
                yield out(pa.Table.from_batches([*held, batch.slice(s, e - s)]))
                held = []
            else:
                held.append(batch.slice(s, e - s))
    if held:
        yield out(pa.Table.from_batches(held))


def _equal_bytes(sig: np.ndarray, row: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Equal signature bytes of one row and each of some others."""
    return (sig[among] == row).sum(axis=1, dtype=np.int16)


def _spanned(rep: np.ndarray, sig: np.ndarray, a: list, b: list) -> tuple[np.ndarray, list[int]]:
    """Appends links that span what is likely linked to a and b; which documents another one may be
    linked with, and the root of each tree.  Only documents that no link has reached yet are compared,
    and those that none reaches with all, so tight groups cost little more than their size."""
    m = len(rep)
    maybe, free, roots = np.zeros(m, bool), np.arange(m), []
    while free.size:  # ascending numbers: nodes of other trees choose the same roots
        root, free = int(free[0]), free[1:]
        roots.append(root)
        todo, alone = [root], True
        while todo and free.size:
            at = todo.pop()
            same = _equal_bytes(sig, sig[at], free)
            new = free[same >= LIKELY]
            free = free[same < LIKELY]
            if new.size:
                alone = False
                maybe[at] = maybe[new] = True
                todo += new.tolist()
                a.append(np.full(len(new), rep[at]))
                b.append(rep[new])
        if alone:
            close = _equal_bytes(sig, sig[root], np.arange(m)) >= POSSIBLE
            close[root] = False
            maybe[close] = True
            maybe[root] |= close.any()
    return maybe, roots


@trimmed
def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node: links (a, b), and (a, null) for each document that another one may be linked with."""
    a, b = [], []
    for group in _groups(batches, ["rep", "sig8"]):
        rep, sig = group["rep"].to_numpy(), _rows_binary(group["sig8"].combine_chunks(), np.uint8)
        if len(rep) > 1:
            maybe, _ = _spanned(rep, sig, a, b)
            a.append(rep[maybe])
            b.append(np.full(int(maybe.sum()), _NONE))
        if sum(map(len, a)) > 20_000:
            yield _pairs(a, b)
            a, b = [], []
    yield _pairs(a, b)


@trimmed
def _block_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block of a large node: links (key, a, b), and (key, a, null) for each root."""
    for group in _groups(batches, ["key", "rep", "sig8"]):
        rep, sig = group["rep"].to_numpy(), _rows_binary(group["sig8"].combine_chunks(), np.uint8)
        a, b = [], []
        _, roots = _spanned(rep, sig, a, b)
        out = _pairs([*a, rep[roots]], [*b, np.full(len(roots), _NONE)])
        yield out.add_column(0, pa.field("key", pa.int64()), pa.array(np.full(out.num_rows, group["key"][0].as_py())))


_NONE = -1 << 62


def _pairs(a: list, b: list) -> pa.RecordBatch:
    a, b = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=b == _NONE)], ["a", "b"])


def _compared(component: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows and the others that each is compared with, so that each pair of components meets: those of
    side 0 with those of side 1, or, if all are of one side, those outside the largest component."""
    if side.any():
        others = np.flatnonzero(side)
        for i in np.flatnonzero(~side):
            yield int(i), others
        return
    _, part, size = np.unique(component, return_inverse=True, return_counts=True)
    for i in np.flatnonzero(part != size.argmax()):
        yield int(i), np.flatnonzero(part != part[i])


@trimmed
def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node: (rep, null) for documents that may be linked with one of another component, and
    pairs of components that span these possible links: no more rows than documents."""
    a, b = [], []
    for group in _groups(batches, ["rep", "sig8", "component", "side"]):
        rep, component = group["rep"].to_numpy(), group["component"].to_numpy()
        if len(rep) > 1 and (component != component[0]).any():
            sig = _rows_binary(group["sig8"].combine_chunks(), np.uint8)
            values, part = np.unique(component, return_inverse=True)
            joined, flag = np.arange(len(values)), np.zeros(len(rep), bool)
            for i, others in _compared(component, group["side"].to_numpy()):
                close = others[_equal_bytes(sig, sig[i], others) >= POSSIBLE]
                if close.size:
                    flag[i] = flag[close] = True
                    for q in np.unique(part[close]):
                        if joined[q] != joined[part[i]]:
                            a.append(values[[q]])
                            b.append(values[[part[i]]])
                            joined[joined == joined[q]] = joined[part[i]]
            a.append(rep[flag])
            b.append(np.full(int(flag.sum()), _NONE))
        if sum(map(len, a)) > 20_000:
            yield _pairs(a, b)
            a, b = [], []
    yield _pairs(a, b)


@trimmed
def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each cluster, or pair of its blocks: links between different components, confirmed on the
    full sets, until none is left that would join two."""
    a, b = [], []
    for group in _groups(batches, ["rep", "component", "side", "sig8", "text"]):
        rep, component = group["rep"].to_numpy(), group["component"].to_numpy()
        joined = component.copy()
        sig = _rows_binary(group["sig8"].combine_chunks(), np.uint8)
        hashes, sizes = [], []
        for column in group["text"].chunks:
            rows = pa.RecordBatch.from_arrays([column], ["text"])
            for _, data, off in slices(rows):
                own, first = text_shingles(data, off)
                sets = [np.unique(own[s:e]) for s, e in zip(first[:-1], first[1:])]
                hashes += sets
                sizes += map(len, sets)
        if not hashes:
            continue
        ids = np.unique(np.concatenate(hashes), return_inverse=True)[1].astype(np.int32)
        sizes = np.array(sizes)
        ends = np.cumsum(sizes)
        mine = np.zeros(int(ids.max()) + 1, bool)
        for i, others in _compared(component, group["side"].to_numpy()):
            others = others[joined[others] != joined[i]]
            if others.size:
                others = others[_equal_bytes(sig, sig[i], others) >= POSSIBLE]
            if others.size:
                own = ids[ends[i] - sizes[i] : ends[i]]
                mine[own] = True
                n = sizes[others]
                first = np.cumsum(n) - n
                common = np.add.reduceat(mine[ids[np.arange(int(n.sum())) + np.repeat(ends[others] - n - first, n)]].astype(np.int64), first)
                mine[own] = False
                for j in others[100 * common >= 75 * (sizes[i] + n - common)]:
                    if joined[j] != joined[i]:
                        a.append(rep[[i]])
                        b.append(rep[[j]])
                        joined[joined == joined[j]] = joined[i]
        if len(a) > 20_000:
            yield _pairs(a, b)
            a, b = [], []
    yield _pairs(a, b)


def _dealt(rows: DataFrame, weight: Column, limit: int) -> DataFrame:
    """rows(key, component, rep, ...) with a block and a side, so that rows of different components of a
    key meet in a (key, block).  Keys of one component go.  A key that weighs no more than the limit is
    one block.  Else its largest component is cut into chunks, all others together into chunks of
    their own, and a block has a chunk of each, or two of the latter: where the others weigh no more
    than the limit, the largest component's rows stay single and theirs come to as much at most."""
    parts = rows.groupBy("key", "component").agg(F.sum(weight).alias("_w"))
    of = parts.groupBy("key").agg(F.sum("_w").alias("_total"), F.max(F.struct("_w", "component")).alias("_top"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    one = F.col("_total") <= limit
    chunks = lambda w: F.ceil(w / limit).cast("long")
    of = of.select("key", F.when(~one, F.col("_top.component")).alias("_largest"), F.when(one, 1).otherwise(chunks(F.col("_total") - F.col("_top._w"))).alias("_nr"), F.when(one, 0).otherwise(chunks(F.col("_top._w"))).alias("_nm"))
    rows = rows.join(of, "key").withColumn("side", F.col("component").eqNullSafe(F.col("_largest")))
    hashed = F.xxhash64("rep")
    rows = rows.withColumn("_own", F.when(F.col("side"), F.col("_nr") + F.pmod(hashed, F.greatest("_nm", F.lit(1)))).otherwise(F.pmod(hashed, F.col("_nr"))))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nr") + F.when(F.col("side"), 0).otherwise(F.col("_nm")) - 1)))
    block = F.least("_own", "_other") * (F.col("_nr") + F.col("_nm")) + F.greatest("_own", "_other")
    return rows.withColumn("block", block).drop("_largest", "_nr", "_nm", "_own", "_other")


def _together(rows: DataFrame, run, kind: str) -> DataFrame:
    """Runs over rows that are gathered by (key, block)."""
    n = shuffle_partitions(rows.sparkSession)
    return rows.repartition(n, "key", "block").sortWithinPartitions("key", "block", "rep").mapInArrow(run, kind)


@trimmed
def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose full sets have a Jaccard similarity of 0.75 or more."""
    from .common import buffers

    known: tuple = (None, None)
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        (da, oa), (db, ob) = buffers(batch.column("text_a")), buffers(batch.column("text_b"))
        ids = batch.column("a").to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            if known[0] != ids[i]:
                known = (ids[i], np.unique(text_shingles(da[oa[i] : oa[i + 1]], np.array([0, oa[i + 1] - oa[i]]))[0]))
            other = np.unique(text_shingles(db[ob[i] : ob[i + 1]], np.array([0, ob[i + 1] - ob[i]]))[0])
            common = len(np.intersect1d(known[1], other, assume_unique=True))
            keep[i] = common > 0 and 100 * common >= 75 * (len(known[1]) + len(other) - common)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    # merge joins: neither side's size is bounded, and adaptive execution splits a hot partner
    rows = (
        pairs.hint("merge").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
        .hint("merge").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return written(rows.mapInArrow(_confirm, "a long, b long"), "links")


def _texts(docs: DataFrame, reps: DataFrame, numbers: DataFrame) -> DataFrame:
    """(rep, text) of these numbers; each text once."""
    wanted = reps.select("rep", "doc_id", "version").join(numbers, "rep", "left_semi")
    # a merge join: neither side's size is bounded, and adaptive execution splits a hot partner
    found = docs.select("doc_id", "version", "text").hint("merge").join(wanted, ["doc_id", "version"])
    return written(found.groupBy("doc_id", "version").agg(F.first("rep").alias("rep"), F.first("text").alias("text")).select("rep", "text"), "texts")


def _collapsed(large: DataFrame, sig8: DataFrame) -> DataFrame:
    """large(key, rep): links (a, b) that span what is likely linked in each of these nodes.  Each round
    deals a node's rows into blocks, each row once; the blocks' roots go on while they become fewer."""
    links, rows, turn = None, large, 0
    while True:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
        dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(turn)), F.ceil(F.col("m") / NODE_LIMIT)))
        out = written(_together(dealt.select("key", "block", "rep").join(sig8, "rep"), _block_forest, "key long, a long, b long"), "forest")
        own = out.where("b is not null").select("a", "b")
        links = own if links is None else links.unionByName(own)
        left = out.where("b is null").select("key", F.col("a").alias("rep"))
        fewer = left.groupBy("key").agg(F.count(F.lit(1)).alias("_left")).join(sizes.where(f"m > {NODE_LIMIT}"), "key").where("2 * _left <= m and _left > 1").select("key")
        rows, turn = written(left.join(fewer, "key", "left_semi"), "roots"), turn + 1
        if rows.isEmpty():
            return links.distinct()


def _nodes(docs: DataFrame, reps: DataFrame, sig8: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """The tree nodes of 2 to NODE_LIMIT documents (key, rep); those that stay larger, and the
    confirmed links that span them, where there are any."""
    small, big, links = None, None, None
    level = reps.mapInArrow(_grow(True), "key long, rep long").distinct()
    for depth in range(MAX_DEPTH + 1):
        sizes = level.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        shared = written(level.join(sizes, "key"), "nodes")
        few = shared.where(f"m <= {NODE_LIMIT}").select("key", "rep")
        small = few if small is None else small.unionByName(few)
        large = shared.where(f"m > {NODE_LIMIT}").select("key", "rep")
        if large.isEmpty():
            break
        pairs = written(_collapsed(large, sig8), "candidates")
        texts = _texts(docs, reps, _ends(pairs))
        own = _confirmed(pairs, texts)
        dropped(texts)
        links = own if links is None else links.unionByName(own)
        known = written(connected_components(links), "components").withColumnRenamed("id", "rep")
        parts = large.join(known, "rep", "left").groupBy("key", F.coalesce("component", "rep").alias("component")).agg(F.count(F.lit(1)).alias("n"))
        apart = parts.groupBy("key").agg((F.sum("n") - F.max("n")).alias("apart"))
        apart = written(apart.select("key", ((F.col("apart") <= NODE_LIMIT) | F.lit(depth == MAX_DEPTH)).alias("done")), "apart")
        stay = written(large.join(apart.where("done"), "key", "left_semi"), "large")
        big = stay if big is None else big.unionByName(stay)
        more = large.join(apart.where("not done"), "key", "left_semi")
        if depth == MAX_DEPTH or apart.where("not done").isEmpty():
            break
        level = more.join(reps.select("rep", "sig"), "rep").select("key", "rep", "sig").mapInArrow(_grow(False), "key long, rep long").distinct()
    return small, big, links


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rep")).unionByName(pairs.where("b is not null").select(F.col("b").alias("rep"))).distinct()


def _judged(docs: DataFrame) -> DataFrame:
    """near_duplicates' rows with their text's version and the number of their group, null without shingles."""
    docs = tuned(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
    sketch = written(docs.mapInArrow(_sketch, "doc_id long, version long, n_shingles long, da long, db long, sig binary"), "sketch")
    sets = sketch.where("n_shingles > 0 and doc_id is not null")
    of = ["n_shingles", "da", "db"]
    reps = sets.groupBy(*of).agg(F.min("doc_id").alias("doc_id"), F.min_by("version", "doc_id").alias("version"), F.first("sig").alias("sig"))
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")  # a set's number holds from here on
    sig8 = reps.mapInArrow(_bytes_only, "rep long, sig8 binary")
    nodes, big, links = _nodes(docs, reps, sig8)
    members = nodes.withColumn("block", F.lit(0)).join(sig8, "rep")
    found = written(_together(members, _forest, "a long, b long").distinct(), "candidates")
    involved = _ends(found) if big is None else _ends(found).unionByName(big.select("rep")).distinct()
    texts = _texts(docs, reps, involved)
    own = _confirmed(found.where("b is not null"), texts)
    links = own if links is None else links.unionByName(own)
    first = written(connected_components(links), "components")
    # what may link components that this leaves apart
    labelled = nodes.join(involved, "rep", "left_semi") if big is None else nodes.join(involved, "rep", "left_semi").unionByName(big)
    labelled = labelled.join(first.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    rest = written(_together(_dealt(labelled, F.lit(1), NODE_LIMIT).join(sig8, "rep"), _rest, "a long, b long").distinct(), "rest")
    last = first
    if not rest.isEmpty():
        clusters = connected_components(rest.where("b is not null")).withColumnRenamed("component", "key").withColumnRenamed("id", "component")
        open_ = rest.where("b is null").select(F.col("a").alias("rep")).join(first.withColumnRenamed("id", "rep"), "rep", "left")
        open_ = open_.select("rep", F.coalesce("component", "rep").alias("component")).join(clusters, "component")
        open_ = written(open_.join(reps.select("rep", "n_shingles"), "rep"), "open")
        rows = _dealt(open_, F.col("n_shingles"), CLUSTER_SHINGLES).drop("n_shingles").join(sig8, "rep").join(texts, "rep")
        more = written(_together(rows, _exact, "a long, b long"), "more")
        if not more.isEmpty():
            last = written(connected_components(links.unionByName(more)), "components")
        dropped(open_)
    dropped(found, texts, rest)
    last = last.withColumnRenamed("id", "rep")
    least = last.join(reps.select("rep", "doc_id"), "rep").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = last.join(least, "component").select("rep", "component", "component_id")
    classes = reps.select(*of, "rep", "doc_id").join(named, "rep", "left").select(*of, F.coalesce("component", "rep").alias("group"), F.coalesce("component_id", "doc_id").alias("component_id"))
    out = sketch.select("doc_id", "version", *of).join(classes, of, "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "version", "group").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id, kept), one row for each input row.

    A-Z are lower-cased; words are runs of other characters than space and \\x09-\\x0D; fewer than
    five words make one shingle.  Null, empty and blank texts have no shingle and no link; they are
    their own component.  Rows that repeat a doc_id are linked by their own texts, not by the id.  A
    null doc_id is never linked: its component is null and it is kept.  An empty table gives an empty
    result.
    """
    return _judged(docs).select("doc_id", "n_shingles", "component_id", "kept")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates keeps: of each group one row, of the least doc_id.  Rows
    without words and rows with a null doc_id stay."""
    kept = _judged(docs).where("kept")
    if docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty():
        return docs.join(kept.select(F.col("doc_id").alias("_kept_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi")
    # a row of an id that repeats is told by its text, and of a group's rows one stays
    own = docs.where("doc_id is not null").withColumn("_version", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = kept.where("doc_id is not null").select(F.col("doc_id").alias("_kept_id"), F.col("version").alias("_kept_version"), F.col("group").alias("_group")).distinct()
    stay = own.join(kept, (F.col("doc_id") == F.col("_kept_id")) & (F.col("_version") == F.col("_kept_version")))
    one = stay.where("_group is not null").dropDuplicates(["doc_id", "_group"]).unionByName(stay.where("_group is null"))
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))
