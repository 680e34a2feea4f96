"""Ordered computations over a whole table without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def ranged(rows: DataFrame, order: list) -> DataFrame:
    """rows dealt into sorted ranges, the range's number in _range. They are written: the bounds are sampled, so a second computation could deal otherwise."""
    return durable(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def running(rows: DataFrame, order: list[str | Column], value: str, pick=F.last, before: bool = False) -> DataFrame:
    """Adds `run`: an aggregate (last, min, max) of the non-null values in order up to each row (before: of the rows before it).

    Each range has its own aggregate, and what the ranges before it have together; a row for each range goes through one task.
    """
    keyed = rows.withColumns({f"_o{i}": o if isinstance(o, Column) else F.col(o) for i, o in enumerate(order)})
    names = [f"_o{i}" for i in range(len(order))]
    chosen = (lambda c: F.last(c, ignorenulls=True)) if pick is F.last else pick
    dealt = ranged(keyed, names)
    inside = Window.partitionBy("_range").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    own = dealt.withColumn("_own", chosen(value).over(inside))
    whole = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*names))) if pick is F.last else pick(value)
    ends = dealt.groupBy("_range").agg(whole.alias("_end"))
    carried = ends.select("_range", chosen("_end").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    both = F.coalesce("_own", "_carried") if pick is F.last else (F.least if pick is F.min else F.greatest)("_own", "_carried")
    out = own.join(F.broadcast(carried), "_range", "left").withColumn("run", both)
    return out.drop("_range", "_own", "_carried", *names)


def assign_lsn(rows: DataFrame, order: list[str], base: int) -> DataFrame:
    """Adds lsn = base + 1, base + 2, ... in order: rows are numbered in sorted ranges, and each range starts after the ones before it."""
    dealt = ranged(rows, order)
    inside = Window.partitionBy("_range").orderBy(*order)
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", (F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + base).alias("_start"))
    numbered = dealt.withColumn("_row", F.row_number().over(inside)).join(F.broadcast(starts), "_range")
    return numbered.withColumn("lsn", (F.col("_start") + F.col("_row")).cast("long")).drop("_range", "_row", "_start")
