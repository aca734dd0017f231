"""Join of points in time with intervals that hold them.

Each interval is cut into aligned cells of a width that fits its length (over an
eighth and at most half of it, so nine cells at most), and each point is
looked up in the cell of every width that its key's intervals use. So a point
meets no interval that lies more than a cell away from it, and no key or day is
gathered in one task: work is dealt by key, width and cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 1000  # microseconds of an interval that still gets cells of its own width


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time.cast("timestamp_ntz"))


def _cell(us: Column, level: Column) -> Column:
    """Number of the cell of width 2 ** level; rounds down before 1970 too."""
    return F.call_function("shiftright", us, level)


def interval_join(points: DataFrame, intervals: DataFrame, key: str, ts: str, start: str, end: str) -> DataFrame:
    """All columns of both sides where the keys are equal and start <= ts < end.

    Empty intervals and nulls in key or times match nothing; repeated rows on
    either side match as often as they are there. ``_level``, ``_cell``, ``_levels``,
    ``_lo`` and ``_hi`` are reserved. Points of keys without intervals, or outside of all
    of a key's intervals, are dropped before they are dealt.
    """
    length = micros(F.col(end)) - micros(F.col(start))
    level = (2 * F.floor((F.log2(F.greatest(length, F.lit(LEAST)).cast("double")) - 1) / 2)).cast("int")
    wanted = intervals.where(F.col(start) < F.col(end)).withColumn("_level", level)
    cells = F.sequence(_cell(micros(F.col(start)), F.col("_level")), _cell(micros(F.col(end)) - 1, F.col("_level")))
    asked = wanted.withColumn("_cell", F.explode(cells))
    # a row for each key, with as many levels as powers of four lie between the lengths
    used = wanted.groupBy(key).agg(F.collect_set("_level").alias("_levels"), F.min(start).alias("_lo"), F.max(end).alias("_hi"))
    near = points.join(used, key).where((F.col(ts) >= F.col("_lo")) & (F.col(ts) < F.col("_hi")))
    spread = near.withColumn("_level", F.explode("_levels")).withColumn("_cell", _cell(micros(F.col(ts)), F.col("_level"))).drop("_levels", "_lo", "_hi")
    met = spread.join(asked, [key, "_level", "_cell"])
    return met.where((F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end))).drop("_level", "_cell")
