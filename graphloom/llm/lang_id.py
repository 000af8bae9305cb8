"""Language identification by rank-order profiles.

A profile lists a language's most frequent letter n-grams (one to three letters, words padded) by
rank.  A document's own most frequent n-grams are compared with each profile: the distance is the
sum of how far each n-gram's ranks lie apart, with a fixed penalty for n-grams that the profile
lacks; the least distance wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, buffers, slices, trimmed, tuned

#: N-grams of a profile and of a document that are compared.
PROFILE = 400
#: Scores are counted in steps of one in so many where a cutoff is fitted.
SCORE_STEPS = 10000
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> lower-cased code point of a letter, or 1 (no letter)."""
    if not _LETTER:
        table = np.ones(0x110000, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTER.append(table)
    return _LETTER[0]


def _ngrams(raw: bytes) -> np.ndarray:
    """All n-grams of a text, as 21 bits a letter; 1 stands for the end of a word."""
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    code = _letters()[points]
    code = np.concatenate([[1], code, [1]]).astype(U64)
    code = code[np.concatenate([[True], (code[1:] != 1) | (code[:-1] != 1)])]
    if len(code) < 3:
        return np.zeros(0, U64)
    one = code[code != 1]
    two = code[:-1] | (code[1:] << U64(21))
    three = code[:-2] | (code[1:-1] << U64(21)) | (code[2:] << U64(42))
    return np.concatenate([one, two, three[code[1:-1] != 1]])


def _ranked(grams: np.ndarray, limit: int) -> np.ndarray:
    """The most frequent n-grams, ties by value."""
    value, count = np.unique(grams, return_counts=True)
    if len(value) > limit:
        least = np.partition(count, len(count) - limit)[len(count) - limit]
        value, count = value[count >= least], count[count >= least]
    return value[np.lexsort((value, -count))][:limit]


@dataclass
class Profiles:
    """grams: all profiles' n-grams, sorted; ranks: languages x n-grams, PROFILE where lacking."""

    langs: list[str]
    grams: np.ndarray
    ranks: np.ndarray

    def predict(self, raw: bytes) -> tuple[str, float]:
        own = _ranked(_ngrams(raw), PROFILE)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        rank = np.arange(len(own))
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == own
        far = np.full(len(self.langs), float((~known).sum() * PROFILE))
        if known.any():
            theirs = self.ranks[:, at[known]]
            far += np.where(theirs < PROFILE, np.minimum(np.abs(theirs - rank[known]), PROFILE), PROFILE).sum(axis=1)
        best = int(far.argmin())
        return self.langs[best], float(1 - far[best] / (PROFILE * len(own)))


@trimmed
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> n-gram counts, summed over a batch."""
    for batch in batches:
        for part, data, off in slices(batch):
            yield from _slice_counts(part, data, off)


def _slice_counts(part: pa.RecordBatch, data: np.ndarray, off: np.ndarray) -> Iterator[pa.RecordBatch]:
    by: dict[str, list[np.ndarray]] = {}
    for i, lang in enumerate(part.column("lang").to_pylist()):
        by.setdefault(lang, []).append(_ngrams(data[off[i] : off[i + 1]].tobytes()))
    for lang, parts in by.items():
        value, count = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(count)], ["lang", "gram", "n"])


def _fit_texts(labelled: DataFrame, fit_rows: int | None) -> DataFrame:
    """(doc_id, lang, text) of all rows with both.  Only where a caller asks for it, about fit_rows rows
    of each language, all where it has no more: those whose hash is below a threshold that follows from
    the language's number of rows.  The driver gets this number for each language with more rows; no
    language's rows meet in one task."""
    rows = tuned(labelled).where("text is not null and lang is not null").select("doc_id", "lang", "text")
    if fit_rows is None:
        return rows
    many = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > fit_rows).collect()
    if not many:
        return rows
    share = F.create_map(*[F.lit(x) for r in many for x in (r.lang, fit_rows / r.n)])[F.col("lang")]
    return rows.where(F.xxhash64("doc_id", "text") / F.lit(2.0**64) + 0.5 < F.coalesce(share, F.lit(1.0)))


def fit_profiles(labelled: DataFrame, fit_rows: int | None = None) -> Profiles:
    """labelled(doc_id, text, lang) -> profiles of all rows, those with null text or lang left out; with
    fit_rows, of about as many of each language.  The driver gets PROFILE rows a language."""
    counts = _fit_texts(labelled, fit_rows).select("lang", "text").mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # of each language every task keeps PROFILE rows before they meet
    top = counts.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("_r") <= PROFILE)
    found = top.select("lang", "gram", "_r").collect()
    langs = sorted({r.lang for r in found})
    grams = np.unique(np.array([r.gram for r in found], np.int64).view(U64)) if found else np.zeros(1, U64)
    ranks = np.full((len(langs), len(grams)), PROFILE, np.int64)
    for r in found:
        ranks[langs.index(r.lang), np.searchsorted(grams, np.array([r.gram], np.int64).view(U64))[0]] = r._r - 1
    return Profiles(langs, grams, ranks)


def predict_languages(docs: DataFrame, profiles: Profiles, *keep: str) -> DataFrame:
    """Adds lang_pred and score (0 to 1, one for equal ranks) to doc_id and the columns in keep.
    Null texts and texts without a letter are UNKNOWN with score 0; repeated rows stay."""
    rows = tuned(docs).select("doc_id", *keep, F.col("text").alias("_text"))
    kind = rows.drop("_text").withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema

    @trimmed
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = buffers(batch.column("_text"))
            found = [profiles.predict(data[off[i] : off[i + 1]].tobytes()) for i in range(batch.num_rows)]
            own = batch.drop_columns(["_text"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*own.schema.names, "lang_pred", "score"])

    return rows.mapInArrow(predict, kind)


def fit_cutoffs(labelled: DataFrame, profiles: Profiles, quantile: float, margin: float, least_rows: int, fit_rows: int | None = None) -> dict[str, float]:
    """Language -> score below which a text isn't in it: a quantile of the scores of the rows that the
    profiles are fitted on, to a step of SCORE_STEPS below, less a margin.  Scores are counted by steps,
    so that all rows count and their order doesn't.  Rows that are nearer to another language than their
    label's are left out; a language with fewer than least_rows others has no cutoff."""
    judged = predict_languages(_fit_texts(labelled, fit_rows), profiles, "lang").where("lang_pred = lang")
    steps = judged.groupBy("lang", F.floor(F.col("score") * SCORE_STEPS).alias("step")).agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("lang")
    upto = steps.select("lang", "step", F.sum("_n").over(own.orderBy("step")).alias("upto"), F.sum("_n").over(own).alias("n"))
    found = upto.where(F.col("upto") >= F.col("n") * quantile).groupBy("lang").agg(F.min("step").alias("step"), F.first("n").alias("n")).collect()
    return {r.lang: r.step / SCORE_STEPS - margin for r in found if r.n >= least_rows}
