"""Aggregations and reads behind dashboards and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstream.functions.columns import EXPORT_NAMESPACE, finite, numeric_value, uuid5
from gridstream.functions.exact import array_mean, hex_text
from gridstream.functions.intervals import micros
from gridstream.functions.running import with_running
from gridstream.operators.qualify import quality_ok
from gridstream.schema import QUALITY


COUNTER_WIDTH = 7 * 86_400 * 1_000_000  # microseconds of a bucket of samples


def second_of(ts: str | Column) -> Column:
    return F.date_trunc("second", F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")


def export_targets(mapping: DataFrame) -> DataFrame:
    """Where each mrid's exports go: common_address, object_address and cause; 0, 0 and 3 where the mapping has no such column."""
    for name, value in (("common_address", 0), ("object_address", 0), ("cause", 3)):
        mapping = mapping if name in mapping.columns else mapping.withColumn(name, F.lit(value))
    return mapping


def export_id() -> Column:
    """Identity of an export row: what it says, where to, why, and its flags."""
    flag = lambda c: F.col(c).cast("int").cast("string")
    parts = [F.col("mrid"), F.unix_seconds(F.col("second").cast("timestamp")).cast("string"), hex_text(F.col("mean")), *[F.col(c).cast("string") for c in ("common_address", "object_address", "cause")]]
    flags = [flag(f"quality_{f}") for f in ("operator_blocked", "old_data", "overflow", "substituted")]
    return uuid5(EXPORT_NAMESPACE, F.concat_ws("\0", *parts, *flags))


def second_mean_export(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Event-second means per mapped mrid, with OR-ed quality flags and ``export_id``.

    mapping: mrid, and what ``export_targets`` reads.
    A second closes when a later valid second of the same mrid has arrived; rows
    of an earlier second than the newest seen are dropped, and the newest
    second of each mrid stays open. Any finite values have a mean.
    """
    ok = quality_ok("explicit_valid") & (F.col("value_type") == "double") & finite(F.col("double_value")) & F.col("kafka_key").eqNullSafe(F.col("mrid")) & F.col("timestamp_field").isNotNull()
    where = export_targets(mapping)
    rows = df.where(ok).join(where, "mrid").withColumn("second", second_of("timestamp_field"))
    kept = with_running(rows, ["mrid"], "arrival_seq", _run=("max_before", F.col("second"))).where(F.col("_run").isNull() | (F.col("second") >= F.col("_run")))
    flags = [F.bool_or(F.coalesce(q, F.lit(False))).alias(q) for q in QUALITY[1:]]
    cells = kept.groupBy("mrid", "second", *[c for c in where.columns if c != "mrid"]).agg(F.collect_list("double_value").alias("_values"), F.count(F.lit(1)).alias("n"), *flags)
    newest = rows.groupBy("mrid").agg(F.max("second").alias("_newest"))  # a sum for each signal, not an order of its seconds
    closed = cells.join(newest, "mrid").where(F.col("second") < F.col("_newest")).withColumn("mean", array_mean(df.sparkSession, F.col("_values")))
    return closed.withColumn("export_id", export_id()).drop("_newest", "_values")


def dedupe_inputs(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per input id (topic, partition, offset) and key."""
    return df.dropDuplicates([*keys, "topic", "partition", "offset"])


def session_coverage(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Per session and requested mrid the row count, zero included, the session's
    total, and COMPLETE when every mrid has a row, else PARTIAL."""
    wanted = requests.select("session_id", F.explode("mrids").alias("mrid"))
    counts = rows.groupBy("session_id", "mrid").agg(F.count(F.lit(1)).alias("n"))
    per = wanted.join(counts, ["session_id", "mrid"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    w = Window.partitionBy("session_id")
    status = F.when(F.min("n").over(w) > 0, "COMPLETE").otherwise("PARTIAL")
    return per.withColumn("total", F.sum("n").over(w)).withColumn("status", status)


def latest_by(df: DataFrame, keys: list[str], value: str = "double_value", ts: str = "timestamp_mccs") -> DataFrame:
    """Newest non-null value per key, ties by arrival, and its time."""
    some = df.where(F.col(value).isNotNull())
    return some.groupBy(*keys).agg(F.max_by(value, F.struct(ts, "arrival_seq")).alias(value), F.max(ts).alias(ts))


def series_1s(df: DataFrame, mrids: list[str] | None = None) -> DataFrame:
    """Newest double per second and signal."""
    some = df if mrids is None else df.where(F.col("mrid").isin(mrids))
    rows = some.where(F.col("double_value").isNotNull()).withColumn("second", second_of("timestamp_mccs"))
    return rows.groupBy("second", "mrid").agg(F.max_by("double_value", F.struct("timestamp_mccs", "arrival_seq")).alias("value"))


def quality_series_1s(df: DataFrame, mrids: list[str] | None = None) -> DataFrame:
    """Newest five flags per second and signal as 1, 0 or null."""
    some = df if mrids is None else df.where(F.col("mrid").isin(mrids))
    rows = some.withColumn("second", second_of("timestamp_mccs"))
    newest = F.max_by(F.struct(*[F.col(q).cast("int").alias(q) for q in QUALITY]), F.struct("timestamp_mccs", "arrival_seq"))
    return rows.groupBy("second", "mrid").agg(newest.alias("f")).select("second", "mrid", "f.*")


def freshness(df: DataFrame) -> DataFrame:
    """Newest time of each signal that has a double."""
    return df.where(F.col("double_value").isNotNull()).groupBy("mrid").agg(F.max("timestamp_mccs").alias("newest"))


def distinct_signals(df: DataFrame, like: str) -> DataFrame:
    """Number of distinct mrids that match a LIKE pattern, by value type."""
    return df.where(F.col("mrid").like(like)).groupBy("value_type").agg(F.countDistinct("mrid").alias("signals"))


def blob_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("blob_id", "session_id").agg(F.count(F.lit(1)).alias("n"))


def counter_rate(df: DataFrame, series: list[str], by: list[str], ts: str = "ts", order: list[str] | None = None, value: str = "value", width: int | None = None) -> DataFrame:
    """Rate of counters between consecutive samples of a series, summed by label and
    sample time. After a reset (a smaller value) the new value is the increase. Samples
    without a time or value do not count; ``order`` tells apart those of one time. A series is
    worked off in buckets of time (``width`` microseconds), not in one task."""
    known = df.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).withColumn("_us", micros(F.col(ts)))
    sample = F.struct(F.col(value).alias("v"), F.col("_us").alias("us"))
    rows = with_running(known, series, "_us", width or COUNTER_WIDTH, then=order, _was=("last_before", sample))
    before, seconds = F.col("_was.v"), (F.col("_us") - F.col("_was.us")) / 1_000_000
    grown = F.when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    some = rows.withColumn("_inc", grown).withColumn("_s", seconds).where(F.col("_s") > 0)
    return some.groupBy(*dict.fromkeys([*by, ts])).agg(F.sum(F.col("_inc") / F.col("_s")).alias("rate"))


def gauge_rollup(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """sum, avg, min, max and count of a gauge by label."""
    return df.groupBy(*by).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))


def usage_ratio(df: DataFrame, by: list[str], part: str, whole: str) -> DataFrame:
    """100 * (1 - part / whole) of the label sums; null where the whole is zero."""
    sums = df.groupBy(*by).agg(F.sum(part).alias("part"), F.sum(whole).alias("whole"))
    return sums.withColumn("used_pct", F.when(F.col("whole") != 0, 100 * (1 - F.col("part") / F.col("whole"))))


def session_order(df: DataFrame, *before: str) -> DataFrame:
    """The artifact's total order inside partitions: time, mrid, type, value text, times, flags; ``before`` those the columns named."""
    value = F.coalesce(F.col("double_value").cast("string"), F.col("int_value").cast("string"), F.col("uint_value").cast("string"), F.col("bool_value").cast("string"), F.col("string_value"), F.col("timestamp_value").cast("string"))
    return df.sortWithinPartitions(*before, "timestamp_mccs", "mrid", "value_type", value, "timestamp_field", "timestamp_gateway", *QUALITY)


def latest_records(df: DataFrame, mrids: list[str] | None = None, n: int = 32) -> DataFrame:
    """The n newest rows, ties by arrival."""
    some = df if mrids is None else df.where(F.col("mrid").isin(mrids))
    return some.orderBy(F.desc("timestamp_mccs"), F.desc("arrival_seq")).limit(n)


def latest_per_signal(df: DataFrame) -> DataFrame:
    """Newest row of every mrid."""
    return df.groupBy(F.col("mrid").alias("_k")).agg(F.max_by(F.struct(*df.columns), F.struct("timestamp_mccs", "arrival_seq")).alias("r")).select("r.*")


def selection_export(df: DataFrame, mrids: list[str], types: list[str], start: Column, end: Column) -> DataFrame:
    """CSV rows (time, mrid, value_type, value) of numeric types in a closed range."""
    ts = F.col("timestamp_mccs")
    rows = df.where(F.col("mrid").isin(mrids) & F.col("value_type").isin([t for t in types if t in ("double", "int", "uint")]) & (ts >= start) & (ts <= end))
    return rows.select(ts.alias("time"), "mrid", "value_type", numeric_value().alias("value")).orderBy("time", "mrid", "value_type", "value")
