"""Joins that no key's share of the rows can slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows; so at most 1 / HOT_SHARE keys are hot,
#: which bounds every broadcast made here.
HOT_SHARE = 1 / 1000


def hot_split_join(left: DataFrame, right: DataFrame, key: str, rows_col: str, total: int) -> DataFrame:
    """Left join of left with right (a row a key; rows_col: how many rows of left have it).

    Rows of hot keys meet a broadcast, all others a shuffle by the key.
    """
    least = max(1.0, total * HOT_SHARE)
    hot = F.broadcast(right.filter(F.col(rows_col) > least).drop(rows_col))
    rest = right.filter(F.col(rows_col) <= least).drop(rows_col)
    taken = {c.lower() for c in (*left.columns, *right.columns)}
    mark = "_hot"
    while mark in taken:
        mark = "_" + mark
    marks = F.broadcast(right.filter(F.col(rows_col) > least).select(key, F.lit(True).alias(mark)))
    marked = left.join(marks, key, "left")
    return marked.filter(F.col(mark)).drop(mark).join(hot, key, "left").unionByName(marked.filter(F.col(mark).isNull()).drop(mark).join(rest, key, "left"))


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str], blocks: int = 64) -> DataFrame:
    """left with `columns` of the row of right that has its key and the greatest time not after its own;
    null where there is none.

    Both sides are one table in order of time; the last row of right is carried forward within ranges of
    time, and from range to range by a row a key and range, so a hot key is ordered in `blocks` parts at
    least. Of rows of right with equal key and time the greatest by `columns` counts; null keys meet null
    keys, rows of left without a time meet none.
    """
    rows = left.select(key, time, F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*columns).alias("s")).schema["s"].dataType).alias("_right"), F.lit(1).alias("_side"))
    marks = right.filter(F.col(time).isNotNull()).select(key, time, F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_left"), F.struct(*columns).alias("_right"), F.lit(0).alias("_side"))
    both = rows.unionByName(marks)
    cuts = both.agg(F.percentile_approx(time, [n / blocks for n in range(1, blocks)], 1_000)).first()[0] or []
    edges = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array()
    both = both.withColumn("_block", F.coalesce(F.size(F.filter(edges, lambda e: e < F.col(time))), F.lit(-1)) if cuts else F.lit(0))
    inside = Window.partitionBy(key, "_block").orderBy(F.col(time).asc_nulls_first(), "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_here", F.last("_right", ignorenulls=True).over(inside)).filter("_side = 1")
    ends = both.groupBy(key, "_block").agg(F.max(F.when(F.col("_side") == 0, F.struct(time, "_right"))).alias("_end"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select(F.col(key).alias("_key"), F.col("_block").alias("_of"), F.last("_end", ignorenulls=True).over(before)["_right"].alias("_before"))
    met = carried.join(earlier, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_block") == F.col("_of")), "left")
    found = met.select("_left", F.when(F.col("_left")[time].isNotNull(), F.coalesce("_here", "_before")).alias("_right"))
    return found.select("_left.*", *[F.col(f"_right.{c}").alias(c) for c in columns])
