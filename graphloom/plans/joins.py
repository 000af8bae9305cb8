"""Joins and sorts whose rows outgrow their input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import stored

#: Parts into which the left rows of one key are dealt; the right rows are copied to each.
PARTS = 8
#: Copies of a row that one array stands for.
_RUN = 4096


def tasks(spark: SparkSession) -> int:
    """Partitions for rows that outgrow their shuffled bytes: a fixed number, which isn't lowered by them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], on: Column | None = None, keep: bool = False) -> DataFrame:
    """An inner join on columns that both sides name alike, and on a further condition.  A few frequent
    keys don't end in a few tasks: left rows are dealt by a hash of the columns `by`.  keep: the keys stay."""
    n = tasks(left.sparkSession)
    dealt = left.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int")).repartition(n, *keys, "_part")
    copied = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).repartition(n, *keys, "_part")
    joined = dealt.join(copied, [*keys, "_part"])
    return (joined if on is None else joined.where(on)).drop("_part", *([] if keep else keys))


def placed(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column], on: Column | None = None) -> DataFrame:
    """An inner join on columns that both sides name alike, its partitions in `order`, columns of the left
    side: that side is dealt out in order and right rows are copied to where their keys are, so that pairs
    needn't be moved to be sorted."""
    n = tasks(left.sparkSession)
    dealt = stored(left.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "placed")
    parts = dealt.groupBy(*keys).agg(F.collect_set("_part").alias("_parts"))
    copied = right.join(parts, keys).withColumn("_part", F.explode("_parts")).drop("_parts")
    joined = dealt.repartitionById(n, "_part").hint("merge").join(copied.repartitionById(n, "_part").hint("merge"), ["_part", *keys])
    return (joined if on is None else joined.where(on)).drop("_part", *keys)


def repeated(rows: DataFrame, times: str, order: list[Column]) -> DataFrame:
    """Each row as often as its column `times` says, in order where there is one: rows are sorted before
    they are copied."""
    n = tasks(rows.sparkSession)
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order) if order else rows.repartition(n)
    names = [F.col(f"`{c}`") for c in rows.columns if c != times]
    runs = placed.select(*names, times, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({times} - 1) div {_RUN}"))).alias("_run"))
    return runs.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_RUN).cast("long"), F.col(times) - F.col("_run") * _RUN))).alias("_copy")).select(*names)
