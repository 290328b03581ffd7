"""Global ranks, running sums and neighbours without a task that sees all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.durable import durable


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number all rows from 1 in the given total order (its last column should be unique).

    Rows are dealt by ranges of the order and written with the number of their
    range; ranks inside a range are offset by the sizes of the ranges before it,
    one row per range.
    """
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), [], order, "_one", out).drop("_one")


def ranged(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``df`` dealt by ranges of key and order, written with the number of each row's range: a key with many rows has many ranges."""
    return durable(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))


def running_sum(df: DataFrame, by: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to each row of its key, itself included, in the given total order.

    Sums inside a range are offset by those of the key's ranges before it, two rows a range
    at most. Null keys are a key of their own.
    """
    dealt = ranged(df, by, order)
    inside = F.sum(value).over(Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = lambda names: [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(by, names)]
    keys, of = F.struct(*[F.col(k) for k in by], F.lit(0).alias("z")), [f"_key{n}" for n in range(len(by))]
    # Only keys at a border of ranges go on from one to the next, so two of a range need offsets at most.
    ends = durable(dealt.groupBy("_range").agg(F.min(keys).alias("_first"), F.max(keys).alias("_last")))
    border = ends.select(F.explode(F.array("_first", "_last")).alias("_b")).distinct().select(*[F.col(f"_b.`{k}`").alias(n) for k, n in zip(by, of)])
    held = dealt.join(F.broadcast(border), same(of)) if by else dealt
    before = F.sum("_sum").over(Window.partitionBy(*of).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))
    offsets = held.groupBy(F.col("_range").alias("_of"), *of).agg(F.sum(value).alias("_sum")).select("_of", *of, before.alias("_before"))
    joined = dealt.withColumn("_inside", inside).join(F.broadcast(durable(offsets)), [F.col("_range") == F.col("_of"), *same(of)], "left")
    return joined.withColumn(out, F.coalesce("_before", F.lit(0)) + F.col("_inside")).drop("_range", "_of", "_inside", "_before", *of)


def shifted(df: DataFrame, by: list[str], order: list[Column], value: str, before: str | None = None, after: str | None = None) -> DataFrame:
    """``df`` with the value of the row before and the row after in its key's total order; null at the ends.

    At the ends of a range it comes from the key's neighbouring range, by its first or last row.
    """
    dealt = ranged(df, by, order)
    inside, across = Window.partitionBy("_range", *by).orderBy(*order), Window.partitionBy(*by).orderBy("_range")
    ends = dealt.withColumn("_n", F.row_number().over(inside)).groupBy("_range", *by).agg(F.min_by(value, "_n").alias("_first"), F.max_by(value, "_n").alias("_last"))
    ends = ends.select(F.col("_range").alias("_of"), *[F.col(k).alias(f"_key{n}") for n, k in enumerate(by)], F.lag("_last").over(across).alias("_left"), F.lead("_first").over(across).alias("_right"))
    rows = dealt.withColumn("_n", F.row_number().over(inside)).withColumn("_lag", F.lag(value).over(inside)).withColumn("_lead", F.lead(value).over(inside)).withColumn("_back", F.lead(F.lit(1)).over(inside))
    joined = rows.join(ends, [F.col("_range") == F.col("_of"), *[F.col(k).eqNullSafe(F.col(f"_key{n}")) for n, k in enumerate(by)]], "left")
    if before:
        joined = joined.withColumn(before, F.when(F.col("_n") == 1, F.col("_left")).otherwise(F.col("_lag")))
    if after:
        joined = joined.withColumn(after, F.when(F.col("_back").isNull(), F.col("_right")).otherwise(F.col("_lead")))
    return joined.drop("_range", "_of", "_n", "_lag", "_lead", "_back", "_left", "_right", *[f"_key{n}" for n in range(len(by))])


def stretches(df: DataFrame, by: str, order: list[Column], value: str, gap: float, out: str) -> DataFrame:
    """``df`` with a number from 1 for each stretch of a key's rows, in the given total (ascending) order, in which ``value`` grows by ``gap`` at most from row to row.

    Rows are dealt by ranges once. What a range needs of those before it is one row a
    range, the last one, and how many stretches its first key had begun by then; only
    keys at a border of ranges can go on, so the table of those stays small. Null keys are a key of their own; a null value begins a stretch.
    """
    dealt = ranged(df, [by], order)
    here = F.struct(F.col(by).alias("k"), F.col(value).alias("v"))
    ends = dealt.groupBy("_range").agg(F.min(F.struct(F.col(by).alias("k"))).alias("_first"), F.max_by(here, F.struct(F.col(by), *order)).alias("_end"))
    ranges = Window.partitionBy(F.lit(0)).orderBy("_range")  # one row a range
    entry = durable(ends.select(F.col("_range").alias("_of"), "_first", "_end", F.lag("_end").over(ranges).alias("_entry")))
    inside = Window.partitionBy("_range").orderBy(by, *order)
    back = F.coalesce(F.lag(here).over(inside), F.col("_entry"))
    goes_on = back["k"].eqNullSafe(F.col(by)) & (F.col(value) - back["v"] <= gap)
    rows = dealt.join(entry.select("_of", "_entry"), F.col("_range") == F.col("_of")).withColumn("_starts", F.when(goes_on, 0).otherwise(1).cast("long")).drop("_of", "_entry")
    border = entry.select(F.explode(F.array("_first.k", "_end.k")).alias("_key")).distinct()
    begun = rows.groupBy("_range", by).agg(F.sum("_starts").alias("_sum")).join(border, F.col(by).eqNullSafe(F.col("_key"))).select(F.col("_range").alias("_of"), "_key", "_sum")
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    offsets = begun.select("_of", "_key", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    counted = rows.withColumn("_inside", F.sum("_starts").over(Window.partitionBy("_range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    joined = counted.join(offsets, (F.col("_range") == F.col("_of")) & F.col(by).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(out, F.coalesce("_before", F.lit(0)) + F.col("_inside")).drop("_range", "_of", "_key", "_starts", "_inside", "_before")
