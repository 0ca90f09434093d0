"""Ranks and running sums over a whole order, however many rows one key has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.frames import staged

#: Rows of a key that one task may number.
KEY_ROWS = 50_000


def running_sum(rows: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """`rows` with the sum of `value` over the rows of the same `keys` up to each one in `order`, which has to be total.

    Rows are dealt out by ranges of keys and order and written down; a task adds up its own range, and what the
    ranges before it have of a key, one row for each range and key, is added to that.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("_part", *keys).agg(F.sum(value).alias("_n")).select("_part", *keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    summed = dealt.withColumn(name, F.sum(value).over(own)).join(before.hint("merge"), ["_part", *keys])
    return summed.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def frequent(rows: DataFrame, keys: list[str], most: int = KEY_ROWS) -> DataFrame | None:
    """The keys of more than `most` rows, written down; None if there are none."""
    often = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*keys), "frequent")
    return often if often.limit(1).count() else None


def numbered(rows: DataFrame, keys: list[str], order: list[Column], often: DataFrame | None, name: str = "_n") -> DataFrame:
    """`rows` with their number within a key, from 1. Keys in `often` are numbered range by range, the others each in a task."""
    few = rows if often is None else rows.join(often.hint("merge"), keys, "left_anti")
    out = few.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    if often is None:
        return out
    return out.unionByName(running_sum(rows.join(often.hint("merge"), keys, "left_semi"), keys, order, F.lit(1), name))


def exact_percentile(rows: DataFrame, value: Column, share: float, bins: int = 1024) -> float | None:
    """The value below which `share` of all values lie, between two values in proportion; null values do not count, and without any it is None.

    The range around each of the two is counted by bins and narrowed to the one that holds it, down to one value. What comes to the
    driver is one count for each bin.
    """
    values = rows.select(value.cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    all_ = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()
    if not all_.n:
        return None

    def at(rank: int) -> float:
        low, high, below = all_.low, all_.high, 0
        while low < high:
            # In halves, so that the width of a range of very large values stays a number.
            place = F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * bins)
            counts = values.where(F.col("v").between(low, high)).groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
            for c in sorted(counts, key=lambda c: c.low):
                if below + c.n > rank:
                    low, high = c.low, c.high
                    break
                below += c.n
        return low

    place = share * (all_.n - 1)
    first = at(int(place))
    return first if place == int(place) else first + (at(int(place) + 1) - first) * (place - int(place))
