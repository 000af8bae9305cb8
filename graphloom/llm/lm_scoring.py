"""Language-model scoring with a hashed maximum-entropy model.

The vocabulary is what the training texts hold: its most frequent words one by one, all others and
unseen words in buckets by hash, a number that grows with the vocabulary.  Words and buckets, by
frequency, are divided into WIDTH classes of near-equal weight, those again, down to single words: so
frequent words have short paths and each token costs a few softmaxes of WIDTH outputs.  The softmax of
each class is given hashed features of the words before (the last one, the last two, the one before
the last) and a bias; only within a bucket do words follow their smoothed counts.  So all words'
probabilities sum to one.  Buckets and hash rows grow with the root of the vocabulary.

Training: in each of ROUNDS rounds the tasks take gradient steps over their shares of a part of the
training texts, from the weights of the round before; the tasks' weights are averaged row by row, by
how often each task has used the row.  All training texts are used once.  Scoring looks the rows up
in sparse numpy batches.  Counts of frequent words, about HEAD of them, are at hand there; the counts
of rarer words are joined by their hash, after a sum for each document and word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, shuffle_partitions, slices, trimmed, tuned, word_hashes, word_spans, written

#: Words whose counts are sent to all tasks: about this number, 16 bytes each.
HEAD = 1 << 18
#: Classes of a class.
WIDTH = 8
#: Least hash rows; for each root of the vocabulary: hash rows, and buckets of rare words.
LEAST_ROWS, ROOT_ROWS, ROOT_BUCKETS = 1 << 14, 128, 16
#: Features with hash rows; the bias comes on top.
FEATURES = 3
ROUNDS = 2
#: Step of the gradients, the squares that a row begins with, tokens of a step.
STEP, SQUARES, BATCH = 0.12, 0.1, 1 << 12
CLIP = 30.0
#: The bias of an output that doesn't exist.
_CLOSED = np.float32(-1e4)
#: Weight rows of a record on the way between tasks.
BLOCK = 1 << 9
#: Tasks of a round at most, each of which hands its model on; more parts of the input are put together.
TRAINERS = 1 << 15
#: Rows whose weights are moved at once, so that they stay in the processor's cache.
MOVED = 1 << 13
#: Words kept between counts that are handed on.
COUNTED = 1 << 20

END = U64(1)
_BEFORE = U64(2)


def _power(x: float) -> int:
    """The least power of two that is x or more."""
    return 1 << max(0, int(np.ceil(x)) - 1).bit_length()


def _bucket_count(beyond: int) -> int:
    """Buckets for so many words that aren't at hand."""
    return _power(ROOT_BUCKETS * beyond**0.5)


def _buckets(words: np.ndarray, n: int) -> np.ndarray:
    return ((words >> U64(20)) & U64(n - 1)).astype(np.int64)


class Tree:
    """Paths from the root to the leaves, whose weights are given in descending order: of leaf i the
    nodes node[off[i] : off[i + 1]] and in each the output pick[...]; biases[node]: logarithms of the
    outputs' weights."""

    def __init__(self, weight: np.ndarray):
        before = np.concatenate([[0.0], np.cumsum(weight, dtype=np.float64)])
        leaf = np.arange(len(weight))
        low, high = np.zeros(len(weight), np.int64), np.full(len(weight), len(weight))
        number = np.zeros(len(weight), np.int64)  # of the node that a leaf is in
        leaves, nodes, picks, biases, made = [], [], [], [], 1
        while leaf.size and len(weight) > 1:
            few = high - low <= WIDTH
            share = (before[leaf] - before[low]) / (before[high] - before[low])
            part = np.where(few, leaf - low, np.minimum((share * WIDTH).astype(np.int64), WIDTH - 1))
            new_node = np.concatenate([[True], number[1:] != number[:-1]])
            new = new_node | np.concatenate([[True], part[1:] != part[:-1]])
            run = np.cumsum(new) - 1  # of children, over all nodes of the level
            pick = run - run[new_node][np.cumsum(new_node) - 1]
            leaves.append(leaf)
            nodes.append(number)
            picks.append(pick.astype(np.int8))
            starts = np.flatnonzero(new)
            ends = np.concatenate([starts[1:], [len(leaf)]])
            child_low, child_high = leaf[starts], leaf[ends - 1] + 1
            own = np.full((int(new_node.sum()), WIDTH), _CLOSED, np.float32)
            own[np.cumsum(new_node)[starts] - 1, pick[starts]] = np.log(before[child_high] - before[child_low])
            biases.append(own - own.max(axis=1, keepdims=True))
            inner = child_high - child_low > 1
            numbers = made + np.cumsum(inner) - 1
            made += int(inner.sum())
            stay = inner[run]
            leaf, low, high, number = leaf[stay], child_low[run][stay], child_high[run][stay], numbers[run][stay]
        self.biases = np.concatenate(biases) if biases else np.zeros((1, WIDTH), np.float32)
        self.biases[self.biases < _CLOSED / 2] = _CLOSED
        every = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.off = np.concatenate([[0], np.cumsum(np.bincount(every, minlength=len(weight)))])
        self.node = np.concatenate(nodes)[order].astype(np.int32) if nodes else np.zeros(0, np.int32)
        self.pick = np.concatenate(picks)[order] if picks else np.zeros(0, np.int8)

    def paths(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index into leaf, node and output of each step, leaf by leaf."""
        begin = self.off[leaf]
        n = self.off[leaf + 1] - begin
        begin -= np.cumsum(n) - n
        at = np.repeat(begin, n)
        at += np.arange(len(at))
        return np.repeat(np.arange(len(leaf)), n), self.node[at], self.pick[at]


@dataclass
class Counts:
    """words: hashes of the most frequent training tokens, ascending; rest: of each bucket of other
    words the smoothed count, one for the unseen included.  Tables that follow from these are made
    where they are used, not sent."""

    words: np.ndarray
    n: np.ndarray
    tokens: int
    distinct: int
    rest: np.ndarray
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": {}}

    @property
    def rows(self) -> int:
        """Hash rows."""
        return max(LEAST_ROWS, _power(ROOT_ROWS * self.distinct**0.5))

    def _tables(self) -> dict:
        if not self._made:
            weight = np.concatenate([self.n + 1, self.rest])
            order = np.argsort(-weight, kind="stable")
            leaf = np.empty(len(weight), np.int64)
            leaf[order] = np.arange(len(weight))
            slots = np.zeros(1 << 20, np.int64)
            often = np.argsort(self.n, kind="stable")  # of words in one slot the most frequent stays
            slots[((self.words[often] >> U64(40)) & U64(len(slots) - 1)).astype(np.int64)] = often
            self._made.update(tree=Tree(weight[order]), leaf=leaf, slots=slots)
        return self._made

    @property
    def tree(self) -> Tree:
        return self._tables()["tree"]

    def place(self, tokens: np.ndarray) -> np.ndarray:
        """The number of each token's word; len(words) where it isn't at hand."""
        m = len(self.words)
        if not m:
            return np.zeros(len(tokens), np.int64)
        # a direct table finds most tokens; those that share a slot with a more frequent word are searched
        slots = self._tables()["slots"]
        at = slots[(tokens >> U64(40)) & U64(len(slots) - 1)]
        if (rest := np.flatnonzero(self.words[at] != tokens)).size:
            own = np.searchsorted(self.words, tokens[rest])
            own[own == m] = 0
            own[self.words[own] != tokens[rest]] = m
            at[rest] = own
        return at

    def leaves(self, tokens: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The leaf of each token: its word's or its bucket's."""
        m = len(self.words)
        return self._tables()["leaf"][np.where(place < m, place, m + _buckets(tokens, len(self.rest)))]

    def rest_of(self, tokens: np.ndarray) -> np.ndarray:
        return self.rest[_buckets(tokens, len(self.rest))]

    def weights(self) -> np.ndarray:
        """Weights to begin with: the biases follow the smoothed counts, all else is zero."""
        return np.concatenate([self.tree.biases, np.zeros((self.rows, WIDTH), np.float32)])


def _documents_tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each row's end token included, and the rows' offsets."""
    starts, ends, first = word_spans(data, off)
    words = word_hashes(data, starts, ends)
    return np.insert(words, first[1:], END), first + np.arange(len(first))


@trimmed
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, n = np.zeros(0, U64), np.zeros(0, np.int64)
    held, size = [], 0

    def merged() -> None:
        nonlocal words, n, held, size
        # the new tokens are sorted alone, then looked up: cheaper than an argsort of all
        value, times = np.unique(np.concatenate([words[:0], *held]), return_counts=True)
        at = np.searchsorted(words, value)
        known = at < len(words)
        known[known] = words[at[known]] == value[known]
        n[at[known]] += times[known]
        words, n = np.insert(words, at[~known], value[~known]), np.insert(n, at[~known], times[~known])
        held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in batches:
        for _, data, off in slices(batch):
            own, _ = _documents_tokens(data, off)
            held.append(own)
            size += len(own)
            if size > COUNTED:
                merged()
                if len(words) > COUNTED:
                    yield out()
                    words, n = np.zeros(0, U64), np.zeros(0, np.int64)
    merged()
    yield out()


def count_words(training: DataFrame) -> DataFrame:
    """training(text) -> (word, n): how often each token's hash occurs; a null text is empty."""
    return training.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_counts(counts: DataFrame) -> Counts:
    """The counts for all tasks.  A histogram of counts, of bounded size, says from which count on words
    are among the HEAD most frequent; of those at the boundary a share is taken by hash."""
    total = counts.agg(F.sum("n"), F.count("*")).first()
    tokens, distinct = int(total[0] or 0), int(total[1])
    # ten leading bits of a count: steps of a thousandth
    low = F.greatest(F.floor(F.log2(F.col("n"))) - 9, F.lit(0)).cast("int")
    level = F.expr("shiftright(n, _low)") + F.col("_low") * 1024
    levelled = counts.withColumn("_low", low).withColumn("_level", level)
    have, least, share = 0, 0, 1.0
    for r in levelled.groupBy("_level").count().orderBy(F.desc("_level")).collect():
        if have + r["count"] > HEAD:
            least, share = r["_level"], (HEAD - have) / r["count"]
            break
        have += r["count"]
    taken = (F.col("_level") > least) | ((F.col("_level") == least) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))))
    top = levelled.where(taken).select("word", "n").toArrow()
    word, n = top.column("word").to_numpy().view(U64), top.column("n").to_numpy()
    order = np.argsort(word)
    word, n = word[order], n[order]
    rest = np.ones(_bucket_count(distinct - len(word)), np.int64)
    if len(rest) > 1:
        bucket = F.shiftrightunsigned("word", 20).bitwiseAND(F.lit(len(rest) - 1))
        sums = counts.groupBy(bucket.alias("bucket")).agg(F.sum(F.col("n") + 1).alias("n")).toArrow()
        rest[sums.column("bucket").to_numpy()] += sums.column("n").to_numpy()
    else:
        rest += tokens + distinct
    np.subtract.at(rest, _buckets(word, len(rest)), n + 1)
    return Counts(word, n, tokens, distinct, rest)


def _features(tokens: np.ndarray, off: np.ndarray) -> np.ndarray:
    """FEATURES rows of hashes, a column for each token; the words before a text's first are a fixed one."""
    place = np.arange(len(tokens)) - np.repeat(off[:-1], np.diff(off))
    one = np.concatenate([[_BEFORE], tokens[:-1]])
    two = np.concatenate([[_BEFORE], one[:-1]])
    one, two = np.where(place >= 1, one, _BEFORE), np.where(place >= 2, two, _BEFORE)
    return np.stack([mix(one + U64(11)), mix(one * U64(3) ^ mix(two + U64(12))), mix(two + U64(13))])


def _hash_rows(features: np.ndarray, at: np.ndarray, node: np.ndarray, counts: Counts) -> np.ndarray:
    """The weight rows of each step's features."""
    own = node.astype(U64) * U64(0x9E3779B97F4A7C15)
    shift = U64(64 - (counts.rows.bit_length() - 1))
    rows = np.take(features, at, axis=1)
    rows += own
    rows *= U64(0xD6E8FEB86659FD93)
    rows >>= shift
    rows = rows.view(np.int64)
    rows += len(counts.tree.biases)
    return rows


def _exponentials(table: np.ndarray, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """exp of each output's logit.  The features' part is clipped, so that none overflows."""
    z = np.take(table, rows[0], axis=0)
    for own in rows[1:]:
        z += np.take(table, own, axis=0)
    np.clip(z, -CLIP, CLIP, out=z)
    z += np.take(table, node, axis=0)
    return np.exp(z, out=z)


_ONES = np.ones(WIDTH, np.float32)


def _whole(rows: np.ndarray) -> np.ndarray:
    """Weight rows as one value each: numpy puts those faster than rows of a matrix."""
    return rows.view(f"V{rows.itemsize * WIDTH}").ravel()


def _scaled(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """x, its rows multiplied in place; one long loop instead of one of WIDTH steps a row."""
    x *= np.repeat(by, WIDTH).reshape(x.shape)
    return x


def _row_gradients(rows: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of weights in rows, ascending, how often each occurs and the mean of its gradients;
    gradient[i] is that of all rows[:, i]."""
    # one sort of row and place together, which is faster than a stable argsort
    key = rows << 32
    key |= np.arange(len(gradient))
    key = key.ravel()
    key.sort()
    place = key & 0xFFFFFFFF
    key >>= 32
    new = np.ones(len(key) + 1, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:-1])
    first = np.flatnonzero(new)
    n = np.diff(first)
    first = first[:-1]
    # most rows have one gradient, most others two; a sum of runs costs more than a copy
    mean = np.take(gradient, place[first], axis=0)
    if (two := np.flatnonzero(n == 2)).size:
        sums = np.take(mean, two, axis=0)
        sums += np.take(gradient, place[first[two] + 1], axis=0)
        sums *= np.float32(0.5)
        np.put(_whole(mean), two, _whole(sums))
    if (many := np.flatnonzero(n > 2)).size:
        m = n[many]
        start = np.cumsum(m) - m
        at = np.repeat(first[many] - start, m)
        at += np.arange(len(at))
        # complex numbers, so as to add two columns at once
        sums = np.add.reduceat(np.take(gradient, place[at], axis=0).view(np.complex64), start, axis=0).view(np.float32)
        np.put(_whole(mean), many, _whole(_scaled(sums, 1 / m.astype(np.float32))))
    return key[first], n, mean


class Trainer:
    """Weights of one task; AdaGrad steps over batches of tokens.  state: of each row the sum of squares,
    as float32, and how often it was used, as uint32, in eight bytes that are read and put at once."""

    def __init__(self, counts: Counts, weights: np.ndarray | None = None):
        self.counts = counts
        self.weights = counts.weights() if weights is None else weights.copy()
        self.state = np.zeros(len(self.weights), np.int64)
        self.state.view(np.float32)[::2] = SQUARES

    @property
    def uses(self) -> np.ndarray:
        return self.state.view(np.uint32)[1::2].astype(np.int64)

    def learn(self, tokens: np.ndarray, off: np.ndarray) -> None:
        counts = self.counts
        leaf = counts.leaves(tokens, counts.place(tokens))
        features = _features(tokens, off)
        for s in range(0, len(tokens), BATCH):
            at, node, pick = counts.tree.paths(leaf[s : s + BATCH])
            if at.size:
                rows = _hash_rows(features[:, s : s + BATCH], at, node, counts)
                gradient = _exponentials(self.weights, node, rows)
                _scaled(gradient, 1 / (gradient @ _ONES))
                gradient.ravel()[np.arange(0, gradient.size, WIDTH) + pick] -= 1
                self._move(np.concatenate([node[None, :], rows]), gradient)

    def _move(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        """A step of each row along the mean of its gradients; rows[k] has those of one feature."""
        row, n, mean = _row_gradients(rows, gradient)
        for s in range(0, len(row), MOVED):
            own, step = row[s : s + MOVED], mean[s : s + MOVED]
            state = np.take(self.state, own)
            squares, uses = state.view(np.float32)[::2], state.view(np.uint32)[1::2]
            squares += (step * step) @ _ONES / WIDTH
            uses += n[s : s + MOVED].astype(np.uint32)
            np.put(self.state, own, state)
            _scaled(step, np.float32(-STEP / (FEATURES + 1) ** 0.5) / np.sqrt(squares))
            step += np.take(self.weights, own, axis=0)
            np.put(_whole(self.weights), own, _whole(step))


_KIND = "block long, rows binary, uses binary, weights binary"


def _rows_out(weights: np.ndarray, uses: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows that were used, a record for each block of the table."""
    for block in range(-(-len(weights) // BLOCK)):
        own = uses[block * BLOCK : (block + 1) * BLOCK]
        if (used := np.flatnonzero(own)).size:
            body = weights[block * BLOCK : (block + 1) * BLOCK][used].astype("<f4")
            yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([x.tobytes()], pa.binary()) for x in (used.astype("<u2"), own[used].astype("<i8"), body))], ["block", "rows", "uses", "weights"])


@trimmed
def _row_means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records sorted by block -> one record for each, its rows the means by use."""
    now, total, uses = None, np.zeros((BLOCK, WIDTH)), np.zeros(BLOCK, np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for batch in _rows_out(total / np.maximum(uses, 1)[:, None], uses):
            yield batch.set_column(0, "block", pa.array([now]))

    for batch in batches:
        for i in range(batch.num_rows):
            block, rows, n, body = (c[i].as_py() for c in batch.columns)
            if block != now:
                if now is not None:
                    yield from out()
                now, total, uses = block, np.zeros((BLOCK, WIDTH)), np.zeros(BLOCK, np.int64)
            rows, n = np.frombuffer(rows, "<u2"), np.frombuffer(n, "<i8")
            total[rows] += np.frombuffer(body, "<f4").reshape(-1, WIDTH) * n[:, None]
            uses[rows] += n
    if now is not None:
        yield from out()


@dataclass
class Model:
    counts: Counts
    weights: np.ndarray

    def token_scores(self, tokens: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token, without the count of a word that isn't at hand; the number
        of its word."""
        counts = self.counts
        place = counts.place(tokens)
        leaf = counts.leaves(tokens, place)
        features = _features(tokens, off)
        out = np.zeros(len(tokens))
        for s in range(0, len(tokens), BATCH):
            own = leaf[s : s + BATCH]
            at, node, pick = counts.tree.paths(own)
            if at.size:
                e = _exponentials(self.weights, node, _hash_rows(features[:, s : s + BATCH], at, node, counts))
                logs = np.log(np.take(e, np.arange(0, e.size, WIDTH) + pick) / (e @ _ONES))
                out[s : s + BATCH] = np.bincount(at, logs, len(own))
        out /= np.log(10)
        return out - np.where(place < len(counts.words), 0.0, np.log10(counts.rest_of(tokens))), place


def train(training: DataFrame, counts: Counts, rounds: int = ROUNDS) -> Model:
    """Gradient steps over all of training(doc_id, text), in each round over one part of it."""
    spark, table = training.sparkSession, counts.weights()
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast((counts, table))

        @trimmed
        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(*sent.value)
            for batch in batches:
                for _, data, off in slices(batch):
                    trainer.learn(*_documents_tokens(data, off))
            yield from _rows_out(trainer.weights, trainer.uses)

        rows = training.where(part == turn).select("text").coalesce(TRAINERS).mapInArrow(learn, _KIND)
        means = rows.repartition(shuffle_partitions(spark), "block").sortWithinPartitions("block").mapInArrow(_row_means, _KIND).toArrow()
        for block, used, body in zip(*(means.column(c).to_pylist() for c in ("block", "rows", "weights"))):
            table[block * BLOCK + np.frombuffer(used, "<u2").astype(np.int64)] = np.frombuffer(body, "<f4").reshape(-1, WIDTH)
        sent.destroy()
    return Model(counts, table)


def score(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, held_out, text) -> (doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score), a row for each row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    @trimmed
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, number = sent.value, TaskContext.get().partitionId() << 36
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "times"]
        for batch in batches:
            for part, data, off in slices(batch):
                tokens, first = _documents_tokens(data, off)
                scores, place = model.token_scores(tokens, first)
                at_hand = place < len(model.counts.words)
                n = np.concatenate([model.counts.n, [0]])[place]
                row = number + np.arange(part.num_rows)
                number += part.num_rows
                sums = lambda x: pa.array(np.add.reduceat(x, first[:-1]))  # noqa: E731  every row has its end token
                base = np.where(at_hand, np.log10(n + 1.0), 0.0)
                none = lambda k, m: pa.nulls(m, k)
                m = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(row), part.column("doc_id"), part.column("held_out"), pa.array(np.diff(first)), sums((n > 0).astype(np.int64)), sums(base), sums(scores), none(pa.int64(), m), none(pa.int64(), m)], names)
                rare = np.flatnonzero(~at_hand)
                if rare.size:
                    owner = (np.searchsorted(first, rare, "right") - 1).astype(np.int64)
                    order = np.lexsort((tokens[rare], owner))
                    owner, word = owner[order], tokens[rare][order]
                    begin = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (word[1:] != word[:-1])]))
                    times = np.diff(np.concatenate([begin, [len(word)]]))
                    m = len(begin)
                    yield pa.RecordBatch.from_arrays([pa.array(row[owner[begin]]), none(pa.int64(), m), none(pa.bool_(), m), none(pa.int64(), m), none(pa.int64(), m), none(pa.float64(), m), none(pa.float64(), m), pa.array(word[begin].view(np.int64)), pa.array(times)], names)

    kind = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word long, times long"
    made = written(docs.mapInArrow(parts, kind), "scores")
    rare = made.where("word is not null").select("row", "word", "times").join(counts, "word")
    more = rare.groupBy("row").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_more"))
    own = made.where("word is null").join(more, "row", "left")
    total = model.counts.tokens + model.counts.distinct + 1
    extra = F.coalesce("_more", F.lit(0.0))
    return own.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(model.counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * float(np.log10(total))).alias("base_score"),
        (F.col("score") + extra).alias("score"),
    )


def score_documents(docs: DataFrame, held_out: Column) -> DataFrame:
    """docs(doc_id, text): counts and trains on the rows where held_out is false, scores all rows.

    A null text is empty and has its end token alone; a null held_out is false; with no training row
    every token is unseen; repeated rows are scored one by one.  An empty table gives no rows.
    """
    rows = tuned(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    training = rows.where("not held_out")
    counts = written(count_words(training), "counts")
    head = head_counts(counts)
    return score(rows, counts, train(training, head))
