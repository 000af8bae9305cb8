"""Document fingerprints: sets of shingle hashes, by DataFrame functions only.

A sketch keeps the hash of every five-word shingle (or, with a greater scale, those below a fixed
fraction of the hash range).  Sketches of one scale merge by union, and the shares of their hashes
give the containment and the likeness of the documents, however unequal these are in length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

SHINGLE = 5
#: One hash in SCALE is kept: all of them, so that short texts are told apart.
SCALE = 1

_WORDS = "[\\x20\\x09-\\x0D]+"


def sketch(text: Column, scale: int = SCALE) -> Column:
    """array<bigint>, ascending: hashes of the text's shingles below the threshold.  A-Z and other
    letters are lower-cased; fewer words than a shingle has are one shingle; null is as empty.  A
    lambda binds the word hashes once, so that they are not computed again for each shingle."""
    limit = -(1 << 63) + (1 << 64) // scale - 1  # the greatest hash that is kept
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _WORDS), lambda w: w != "")

    def shingles(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[h[i + j] for j in range(SHINGLE)]))
        short = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) >= SHINGLE, runs).otherwise(short)

    bound = F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), lambda h: F.sort_array(F.array_distinct(F.filter(shingles(h), lambda x: x <= limit) if scale > 1 else shingles(h))))
    return bound[0]


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sketches; two without a hash, of texts without a word at SCALE 1, are alike."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def containment(a: Column, b: Column) -> Column:
    """Share of a's shingles that b has; of a sketch without a hash, 1."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents together."""
    return F.sort_array(F.array_union(a, b))


def as_string(s: Column) -> Column:
    """A sketch as text: its scale and the hashes in hexadecimal digits, ascending."""
    return F.concat(F.lit(f"{SCALE}:"), F.array_join(F.transform(s, lambda x: F.lower(F.hex(x))), ","))


def with_next(docs: DataFrame, *columns: str, prefix: str = "next_") -> DataFrame:
    """Adds each column of the next document in descending doc_id; after the last comes the first.

    Only ranges of rows meet in a window, bounded by quantiles of doc_id (a number of them that the
    partitions fix, not the data); a doc_id that fills several ranges, and null, which is the lowest,
    are cut further by a hash of `columns`.  The last row of each range, one row a range, is joined to
    the range above it.  Rows that repeat a doc_id follow each other by that hash, then by `columns`.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark) * 8
    seen = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("cuts"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.count(F.lit(1)).alias("n")).first()
    cuts = sorted(set(seen.cuts or []))
    often = {c: k for c in cuts if (k := seen.cuts.count(c)) > 1}
    share = F.xxhash64(*columns) / F.lit(2.0**64) + 0.5  # ascending in the hash
    part = lambda k: F.least(F.floor(share * k), F.lit(k - 1)).cast("int")
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    parts = F.lit(0)
    for c, k in often.items():
        parts = F.when(F.col("doc_id") == c, 1 + part(k)).otherwise(parts)
    lowest = max(1, -(-seen.nulls * n // max(seen.n, 1)))
    range_ = F.when(F.col("doc_id").isNull(), F.struct(F.lit(-1).alias("a"), part(lowest).alias("b"))).otherwise(F.struct(F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))).alias("a"), parts.alias("b")))
    rows = docs.withColumns({"_range": range_, "_hash": F.xxhash64(*columns)})
    order = Window.partitionBy("_range").orderBy("doc_id", "_hash", *columns)
    rows = rows.withColumns({f"_{c}": F.lag(c).over(order) for c in columns} | {"_first": F.row_number().over(order) == 1})
    # the greatest row of each range: its id and hash first, so that only these rows are computed again
    narrow = docs.select("doc_id", range_.alias("_range"), F.xxhash64(*columns).alias("_hash"))
    ids = narrow.groupBy("_range").agg(F.max(F.struct("doc_id", "_hash")).alias("_id")).select("_range", F.col("_id.doc_id").alias("_top_id"), F.col("_id._hash").alias("_top_hash"))
    tops = docs.withColumns({"_range": range_, "_hash": F.xxhash64(*columns)})
    # a row for each range: as many as n and the parts of null, whatever the data
    tops = tops.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("_top_id")) & (F.col("_hash") == F.col("_top_hash")), "left_semi")
    top = tops.groupBy("_range").agg(F.max(F.struct("doc_id", "_hash", *columns)).alias("_top"))
    # only the ranges' names are put in order; the rows themselves are joined
    names = ids.select("_range").withColumn("_lower", F.lag("_range").over(Window.orderBy("_range")))
    names = names.crossJoin(F.broadcast(ids.agg(F.max("_range").alias("_highest"))))
    names = names.select("_range", F.coalesce("_lower", "_highest").alias("_lower"))
    last = names.join(top.select(F.col("_range").alias("_lower"), F.col("_top").alias("_n")), "_lower").select("_range", "_n")
    out = rows.join(last, "_range")
    return out.select(*docs.columns, *[F.when(F.col("_first"), F.col(f"_n.{c}")).otherwise(F.col(f"_{c}")).alias(prefix + c) for c in columns])
