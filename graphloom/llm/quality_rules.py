"""Quality rules with risk-controlled thresholds.

Each rule is a badness of a document.  Its cutoff in a stratum (a language) is chosen on labelled
holdouts: cutoffs are tried from the most lenient on, and one is certified while the exact binomial
upper bound on the share of good documents beyond it stays below the rule's share of RISK.  This
fixed sequence needs no correction among a rule's cutoffs; among strata and rules the level is
divided (Bonferroni).  So with confidence 1 - LEVEL no stratum loses more than RISK of its good
documents to the rules.  Of the certified cutoffs the one with the best balance of bad and good
documents beyond it is used; a rule without a certified or useful cutoff rejects nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shingle_hashes, slices, trimmed, tuned, word_hashes, word_spans, written

RISK, LEVEL = 0.01, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT, RUN = 10, 20, 5
#: Cutoffs tried for each rule: grid steps from 0 to the rule's end.
GRID = 64

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


@trimmed
def _metrics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "stratum", *METRICS]
    for batch in batches:
        for part, data, off in slices(batch):
            starts, ends, first = word_spans(data, off)
            sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])[off]
            word = np.zeros(len(data), bool)
            if len(starts):
                size = ends - starts
                word[np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)] = True
            chars, symbols = np.diff(sums(word & ((data & 0xC0) != 0x80))), np.diff(sums(_SYMBOL[data]))
            capitals = np.diff(sums((data >= 65) & (data <= 90)))
            runs, run_off = shingle_hashes(word_hashes(data, starts, ends, lower=False), first, RUN)
            n = np.diff(first)
            repeated, lines = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            raw = data.tobytes()
            for i in range(part.num_rows):
                if n[i] > RUN:
                    _, at, count = np.unique(runs[run_off[i] : run_off[i + 1]], return_inverse=True, return_counts=True)
                    if (hit := np.flatnonzero(count[at] > 1)).size:
                        step = np.zeros(n[i] + 1, np.int64)
                        step[hit] += 1
                        np.subtract.at(step, hit + RUN, 1)
                        repeated[i] = (np.cumsum(step)[:-1] > 0).sum()
                own = Counter(x for x in raw[off[i] : off[i + 1]].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r"))
                lines[i] = own.total() - len(own)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("stratum"), *(pa.array(x.astype(np.int64)) for x in (n, chars, symbols, lines, repeated, capitals))], names)


def quality_metrics(docs: DataFrame, stratum: Column | None = None) -> DataFrame:
    """(doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals) of
    docs(doc_id, text), a row for each row; a null text has no words."""
    rows = tuned(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(stratum if stratum is not None else F.lit(""), F.lit("")).alias("stratum"), "text")
    return rows.mapInArrow(_metrics, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_capitals long")


def with_metrics(docs: DataFrame, stratum: Column | None = None) -> DataFrame:
    """The rows of docs with the metrics and the stratum as further columns; columns of docs that
    have such a name give way."""
    own = [c for c in docs.columns if c not in ("stratum", *METRICS)]
    rows = tuned(docs).withColumn("stratum", F.coalesce(stratum if stratum is not None else F.lit(""), F.lit("")))
    rows = rows.select(*own, "stratum")
    kind = rows.withColumns({m: F.lit(0).cast("long") for m in METRICS}).schema

    @trimmed
    def metrics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = list(_metrics(iter([batch])))
            for i, m in enumerate(METRICS):
                column = pa.chunked_array([d.column(m) for d in done], pa.int64()).combine_chunks()
                batch = batch.append_column(pa.field(m, pa.int64()), column)
            yield batch

    return rows.mapInArrow(metrics, kind)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rules() -> dict[str, tuple[Column, float]]:
    """Badness of each rule and the end of its grid."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbols": (F.col("n_symbols") / chars, 0.5),
        "repeats": (F.col("n_repeat_words") / words, 0.25),
        "capitals": (F.col("n_capitals") / chars, 1.0),
        "lines": (F.col("n_dup_lines") / words, 0.25),
    }


def upper_bound(bad: int, n: int, level: float) -> float:
    """Exact (Clopper-Pearson) upper confidence bound of a binomial share, by bisection."""
    if n == 0 or bad >= n:
        return 1.0

    def tail(p: float) -> float:  # P(X <= bad)
        terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(bad + 1)]
        top = max(terms)
        return math.exp(top) * sum(math.exp(t - top) for t in terms)

    low, high = bad / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mid <= 0 or tail(mid) > level else (low, mid)
    return high


def choose_cutoffs(counts: dict[tuple[str, str], np.ndarray], strata: int, risk: float = RISK, level: float = LEVEL) -> dict[tuple[str, str], int]:
    """counts[stratum, rule]: 2 x (GRID + 1) good and bad documents by grid step.  -> the least step
    that is rejected, where there is one."""
    n_rules = len({r for _, r in counts})
    out = {}
    for key, (good, bad) in counts.items():
        n, best, chosen = int(good.sum()), 0, None
        for step in range(GRID, 0, -1):
            lost = int(good[step:].sum())
            if lost > risk / n_rules * n or upper_bound(lost, n, level / (strata * n_rules)) > risk / n_rules:
                break
            if (gain := int(bad[step:].sum()) - lost) > best:
                best, chosen = gain, step
        if chosen is not None:
            out[key] = chosen
    return out


def _step(badness: Column, end: float) -> Column:
    return F.least(F.ceil(badness / end * GRID), F.lit(GRID)).cast("int")


def fit_cutoffs(metrics: DataFrame, labels: DataFrame) -> dict[tuple[str, str], int]:
    """metrics, labels(doc_id, quality: 1 good, 0 bad) -> cutoffs.  All labelled documents that
    don't fail the base rules count; of several labels the least holds, null labels are left out.
    The driver gets GRID + 1 counts for each rule, in strata large enough to certify anything."""
    held = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    by = rules()
    rows = metrics.where(~base_failed()).join(held, "doc_id")
    steps = rows.select("stratum", "quality", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), _step(*v).alias("step")) for k, v in by.items()])).alias("_s"))
    table = steps.groupBy("stratum", "_s.rule", "_s.step").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad"))
    least = math.log(LEVEL) / math.log1p(-RISK / len(by))  # fewer good documents certify nothing
    enough = rows.groupBy("stratum").agg(F.count_if(F.col("quality") == 1).alias("_n")).where(F.col("_n") >= least).select("stratum")
    counts: dict[tuple[str, str], np.ndarray] = {}
    for r in table.join(enough, "stratum").collect():
        own = counts.setdefault((r.stratum, r.rule), np.zeros((2, GRID + 1), np.int64))
        own[:, r.step] += (r.good, r.bad)
    return choose_cutoffs(counts, max(1, len({s for s, _ in counts})))


def with_verdict(metrics: DataFrame, cutoffs: dict[tuple[str, str], int]) -> DataFrame:
    """Adds base_failed and kept."""
    beyond = F.lit(False)
    for (stratum, rule), step in sorted(cutoffs.items()):
        beyond = beyond | ((F.col("stratum") == stratum) & (_step(*rules()[rule]) >= step))
    return metrics.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~beyond)


def judge_quality(docs: DataFrame, labels: DataFrame, stratum: Column | None = None) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> metrics, base_failed and kept, a row for each row.

    Null and empty texts fail the base rules.  Without labels, or with too few, only the base rules
    reject.  A null doc_id has no label; rows that repeat a doc_id are judged by their own text.
    """
    metrics = written(quality_metrics(docs, stratum), "metrics")
    return with_verdict(metrics, fit_cutoffs(metrics, labels))
