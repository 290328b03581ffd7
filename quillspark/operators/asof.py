"""As-of join: each row with the newest earlier row of its key, for any number of keys and times in one plan.

Both sides are united and dealt by ranges of key and time, so a key with many rows is
spread over many tasks; inside a range the last right row is carried forward, and across
ranges one row a range says what was carried so far. Neither side is broadcast, nothing is paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.ranking import ranged


def asof_join(
    left: DataFrame, right: DataFrame, by: dict[str, str], left_time: str, right_time: str, values: dict[str, str], tie: list[str] | None = None, allow_equal: bool = False,
) -> DataFrame:
    """``left`` with columns ``values`` (new name: right column) of the newest right row of the same key and an earlier time.

    ``by`` maps left keys to right keys; none means one key. With ``allow_equal`` a right
    row of the same time counts too. Of right rows with equal key and time the last by the
    columns ``tie`` counts. A null key or time matches nothing; left rows without a match keep
    nulls, and repeated left rows stay.
    """
    keys = [f"_k{n}" for n in range(len(by))]
    carried = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    kept, found = F.struct(*[F.col(c) for c in left.columns]), right.where(F.col(right_time).isNotNull())
    for k in by.values():
        found = found.where(F.col(k).isNotNull())
    order_by = tie or []
    later = found.select(
        *[F.col(c).alias(k) for k, c in zip(keys, by.values())], F.col(right_time).alias("_time"), F.lit(0 if allow_equal else 1).alias("_side"),
        F.struct(F.lit(0).alias("z"), *[F.col(c) for c in order_by]).alias("_tie"), F.lit(None).cast(left.select(kept.alias("x")).schema[0].dataType).alias("_left"), carried.alias("_right"),
    )
    asked = left.select(
        *[F.col(c).alias(k) for k, c in zip(keys, by)], F.col(left_time).alias("_time"), F.lit(1 if allow_equal else 0).alias("_side"),
        F.lit(None).cast(later.schema["_tie"].dataType).alias("_tie"), kept.alias("_left"), F.lit(None).cast(later.schema["_right"].dataType).alias("_right"),
    )
    order: list[Column] = [F.col("_time"), F.col("_side"), F.col("_tie")]
    dealt = ranged(asked.unionByName(later), keys, order)
    # A right row with its key, so that what is carried into the next key is known as not its own.
    own = F.struct(*[F.col(k) for k in keys], F.lit(0).alias("z"))
    last = F.when(F.col("_right").isNotNull(), F.struct(own.alias("key"), F.col("_right").alias("row")))
    place = F.struct(*[F.col(k) for k in keys], *order)
    ends = dealt.where(F.col("_right").isNotNull()).groupBy("_range").agg(F.max_by(last, place).alias("_end"))
    every = dealt.select("_range").distinct().join(ends, "_range", "left")
    # One row a range, so this window over all ranges is small.
    before = every.select(F.col("_range").alias("_of"), F.last("_end", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*keys, *order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.withColumn("_inside", F.last(last, ignorenulls=True).over(inside)).where(F.col("_left").isNotNull())
    joined = rows.join(before, F.col("_range") == F.col("_of"), "left").withColumn("_match", F.coalesce("_inside", "_before"))
    usable = F.col("_time").isNotNull() & (F.col("_match.key") == own)  # a null key equals none
    return joined.select("_left.*", *[F.when(usable, F.col("_match.row")[n]).alias(n) for n in values])
