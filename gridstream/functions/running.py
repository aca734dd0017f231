"""Running values per key in arrival order, without gathering a key in one task.

Running maxima and last known values are associative: arrivals are cut into
buckets, each bucket is ordered by itself, and what the buckets before it hand
on is found from one small row per key and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 20  # of a bucket, in units of the order column


def with_running(df: DataFrame, keys: list[str], order: str, width: int | None = None, then: list[str] | None = None, **wanted: tuple[str, Column]) -> DataFrame:
    """Add columns ``name=(kind, value)``: ``max_before``, the largest value of all
    earlier rows of the key; ``last_before`` and ``last``, the newest value that is
    not null of the earlier rows, or with the row itself; ``first_after``, the next
    value that is not null of the later rows. Any ``width`` gives the same result. ``then``
    orders rows that are equal in ``order``. ``_bucket`` is reserved."""
    cut = df.withColumn("_bucket", F.floor(F.col(order) / (width or WIDTH)))
    places = [order, *(then or [])]
    inside, over = Window.partitionBy(*keys, "_bucket").orderBy(*places), Window.partitionBy(*keys).orderBy("_bucket")
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    # what follows is what comes before in the opposite order: Spark works off a frame that
    # ends at the last row anew for each row, and one that begins at the first row once
    backwards = Window.partitionBy(*keys, "_bucket").orderBy(*[F.desc(c) for c in places]).rowsBetween(Window.unboundedPreceding, -1)
    coming = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    until = {"last": 0, "last_before": -1, "max_before": -1}
    sums, carries, here, both = [], [], {}, {}
    for name, (kind, value) in wanted.items():
        place = F.when(value.isNotNull(), F.struct(*places))
        if kind == "first_after":
            sums.append(F.min_by(value, place).alias(f"_{name}"))
            carries.append(F.last(f"_{name}", ignorenulls=True).over(coming).alias(f"_past_{name}"))
            here[name] = F.last(value, ignorenulls=True).over(backwards)
            both[name] = F.coalesce(name, f"_past_{name}")
            continue
        rows = inside.rowsBetween(Window.unboundedPreceding, until[kind])
        if kind == "max_before":
            sums.append(F.max(value).alias(f"_{name}"))
            carries.append(F.max(f"_{name}").over(past).alias(f"_past_{name}"))
            here[name] = F.max(value).over(rows)
            both[name] = F.greatest(name, f"_past_{name}")
        else:
            sums.append(F.max_by(value, place).alias(f"_{name}"))
            carries.append(F.last(f"_{name}", ignorenulls=True).over(past).alias(f"_past_{name}"))
            here[name] = F.last(value, ignorenulls=True).over(rows)
            both[name] = F.coalesce(name, f"_past_{name}")
    handed = cut.groupBy(*keys, "_bucket").agg(*sums).select(*keys, "_bucket", *carries)
    joined = cut.withColumns(here).join(handed, [*keys, "_bucket"], "left")
    kept = [c for c in df.columns if c not in wanted]
    return joined.select(*kept, *[both[n].alias(n) for n in wanted])
