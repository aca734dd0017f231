"""Preferred frequency from several measurement units, second by second."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstream.functions.columns import finite
from gridstream.operators.qualify import rejection_reasons

BAD, GOOD, VERY_GOOD = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    """Band, limits and classes of the evaluation."""

    low: float = 10.0
    high: float = 60.0
    nominal_voltage: float = 40.0
    count_bad_max: int = 0
    count_very_good_min: int = 2
    voltage_very_good: float = 10.0
    voltage_good: float = 25.0
    close_delay_ms: int = 600
    max_future_s: int = 1
    nominal_frequency: float = 50.0
    tie: str = "lower"


def _ms(ts: str) -> Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def accepted_inputs(df: DataFrame, units: DataFrame, s: Settings) -> DataFrame:
    """Rows of configured signals with their unit, kind, second, ``refused`` (time
    or repetition) and ``reasons`` (value and status).

    units: pmu, frequency_mrid, voltage_mrid. Late means that the second had
    been closed when the row was received, which its two times tell alone.
    """
    signals = units.select("pmu", F.inline(F.array(F.struct(F.col("frequency_mrid").alias("mrid"), F.lit("frequency").alias("kind")), F.struct(F.col("voltage_mrid").alias("mrid"), F.lit("voltage").alias("kind")))))
    rows = df.join(signals, "mrid")
    second = F.floor(_ms("timestamp_field") / 1000)
    received = _ms("received_at")
    closed = F.floor((received - s.close_delay_ms) / 1000) - 1
    refused = F.when(F.col("timestamp_field").isNull(), "missing_timestamp").when(second > F.floor(received / 1000) + s.max_future_s, "future_timestamp").when(second <= closed, "late_after_close")
    value = F.col("double_value")
    frequency = rejection_reasons(s.low, s.high)
    voltage = rejection_reasons(float("-inf"), float("inf"))
    out = rows.withColumn("second", second).withColumn("refused", refused).withColumn("reasons", F.when(F.col("kind") == "frequency", frequency).otherwise(voltage))
    return out.withColumn("good", (F.size("reasons") == 0) & finite(value))


def pmu_second(inputs: DataFrame, units: DataFrame, s: Settings) -> DataFrame:
    """Per unit and second: means, counts and rejections. A second with any row
    lists all configured units; frequency rows count even when bad."""
    # dealt by what both the repetitions and the sums are grouped by, so there is one shuffle
    rows = inputs.where(F.col("refused").isNull()).repartition("pmu", "second").dropDuplicates(["pmu", "second", "topic", "partition", "offset"])
    f, v = F.col("kind") == "frequency", F.col("kind") == "voltage"
    per = rows.groupBy("pmu", "second").agg(
        F.avg(F.when(f & F.col("good"), F.col("double_value"))).alias("mean_frequency"), F.avg(F.when(v & F.col("good"), F.col("double_value"))).alias("mean_voltage"),
        F.count_if(f & F.col("good")).alias("good"), F.count_if(f).alias("total"), F.sum(F.size("reasons")).alias("rejections"),
    )
    columns = ["pmu", "mean_frequency", "mean_voltage", "good", "total", "rejections"]
    kinds = dict(per.dtypes)
    met = per.groupBy("second").agg(F.collect_list(F.struct(*columns)).alias("_met"))
    both = met.crossJoin(units.agg(F.collect_set("pmu").alias("_all")))  # one row: the configured units
    lacking = F.transform(F.array_except("_all", F.transform("_met", lambda u: u["pmu"])), lambda p: F.struct(p.alias("pmu"), *[F.lit(None if c.startswith("mean") else 0).cast(kinds[c]).alias(c) for c in columns[1:]]))
    out = both.select("second", F.inline(F.concat("_met", lacking)))
    share = F.when(F.col("total") > 0, F.col("good") / F.col("total")).otherwise(F.lit(0.0))
    whole = lambda c: F.col(c).cast("long").alias(c)
    return out.select("pmu", "second", "mean_frequency", "mean_voltage", whole("good"), whole("total"), whole("rejections"), share.alias("availability"))


def classify_pmu(seconds: DataFrame, s: Settings) -> DataFrame:
    """Add count_class, voltage_class and quality, the worse of the two; BAD without a mean."""
    count = F.when(F.col("good") <= s.count_bad_max, BAD).when(F.col("good") >= s.count_very_good_min, VERY_GOOD).otherwise(GOOD)
    off = F.abs(F.col("mean_voltage") - s.nominal_voltage)
    voltage = F.when(off < s.voltage_very_good, VERY_GOOD).when(off <= s.voltage_good, GOOD).otherwise(BAD)
    both = seconds.withColumn("count_class", count).withColumn("voltage_class", voltage)
    return both.withColumn("quality", F.when(F.col("mean_frequency").isNull(), BAD).otherwise(F.least("count_class", "voltage_class")))


def preferred_frequency(classified: DataFrame, s: Settings) -> DataFrame:
    """Per second the median of the best class that is not BAD, never averaged: of
    the two middle values the one farther from nominal, then the configured one.
    ``selected`` names the units (``pmu``) of that class, sorted."""
    best = classified.where(F.col("quality") > BAD).withColumn("_best", F.max("quality").over(Window.partitionBy("second"))).where(F.col("quality") == F.col("_best"))
    named = F.array_sort(F.collect_list("pmu")) if "pmu" in classified.columns else F.lit(None).cast("array<string>")
    of_best = [F.array_sort(F.collect_list("mean_frequency")).alias("_v"), named.alias("selected")]
    lists = best.groupBy("second").agg(F.max("quality").alias("quality"), *of_best)
    n = F.size("_v")
    low, high = F.element_at("_v", F.floor((n + 1) / 2).cast("int")), F.element_at("_v", F.floor(n / 2).cast("int") + 1)
    off = lambda c: F.abs(c - s.nominal_frequency)
    tied = low if s.tie == "lower" else high
    chosen = F.when(off(low) > off(high), low).when(off(high) > off(low), high).otherwise(tied)
    return lists.select("second", "quality", chosen.alias("frequency"), n.alias("units"), "selected")


def publications(preferred: DataFrame, output_mrid: str, s: Settings) -> DataFrame:
    """Measurements to publish: field time is the end of the second, mccs the closing time, and an id of mrid and second."""
    at = lambda ms: F.timestamp_millis(ms).cast("timestamp_ntz")
    return preferred.select(
        F.lit(output_mrid).alias("mrid"), F.concat(F.lit(output_mrid), F.lit(":"), F.col("second").cast("string")).alias("publication_id"), F.col("frequency").alias("double_value"),
        at((F.col("second") + 1) * 1000).alias("timestamp_field"), at((F.col("second") + 1) * 1000 + s.close_delay_ms).alias("timestamp_mccs"), F.lit(True).alias("quality_valid"),
    )


def outbox(pending: DataFrame, sent: DataFrame) -> DataFrame:
    """Publications that were not sent yet, each once."""
    return pending.join(sent.select("publication_id"), "publication_id", "left_anti").dropDuplicates(["publication_id"])


def refusal_counts(inputs: DataFrame) -> DataFrame:
    """How many rows were refused, by reason."""
    return inputs.where(F.col("refused").isNotNull()).groupBy("refused").agg(F.count(F.lit(1)).alias("n"))


