"""Registered streaming queries; each replays a table and reads what the job wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstream.operators import alarms
from gridstream.operators import sessions as S
from gridstream.operators.catalogs import joined_reasons
from gridstream.plans import aggregates, episodes, sessions
from gridstream.plans.qualification import rules
from gridstream.sources import storage
from gridstream.sources.fixtures import measurements, session_requests
from gridstream.streaming import jobs


def _stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = storage.scratch(spark, name)
    jobs.run_to_end(df, path)
    return spark.read.schema(df.schema).parquet(path)


def _time(c: str) -> F.Column:
    return F.timestamp_micros(F.col(c)).cast("timestamp_ntz")


def _live(spark: SparkSession, d: str) -> DataFrame:
    return jobs.replayed(spark, measurements(spark, d), "live", "arrival_seq")


def s69_formula(spark: SparkSession, d: str) -> DataFrame:
    out = alarms.formula(_live(spark, d), "urn:grid:site:03:view", "urn:grid:site:03:view-m", F.col("double_value") * 1000)
    return _stored(spark, out, "formula").select("arrival_seq", "mrid", "timestamp_mccs", "quality_valid", F.round("double_value", 6).alias("double_value"))


def o70_stream_latest(spark: SparkSession, d: str) -> DataFrame:
    names = ["click", "view", "error"]
    out = _stored(spark, jobs.stream_latest_values(_live(spark, d), episodes._site_inputs(spark, d, names), names, 30.0, "received_at"), "latest")
    return out.select("group", "arrival_seq", _time("newest_us").alias("newest"), F.round(F.get("inputs", F.lit(0)) + F.get("inputs", F.lit(1)) - F.get("inputs", F.lit(2)), 6).alias("value"))


def o71_stream_alarm(spark: SparkSession, d: str) -> DataFrame:
    events = alarms.union_events(measurements(spark, d), episodes.members(spark, d))
    out = _stored(spark, jobs.stream_alarm(jobs.replayed(spark, events, "live", "arrival_seq"), rules(spark)), "alarms")
    return out.select("alarm_key", "arrival_seq", "action", "episode_id", _time("activated_us").alias("activated_at"))


def o72_stream_capture(spark: SparkSession, d: str) -> DataFrame:
    policies = episodes.policies(spark, d)
    out = _stored(spark, jobs.stream_capture(_live(spark, d), policies), "captures")
    return out.select("mrid", _time("onset_us").alias("onset"), _time("cleared_us").alias("cleared_at"))


def o73_stream_export(spark: SparkSession, d: str) -> DataFrame:
    out = _stored(spark, jobs.stream_export(_live(spark, d), aggregates._mapping(spark, d)), "exports")
    return out.select("mrid", _time("second_us").alias("second"), "n", F.round("mean", 6).alias("mean"), F.col("blocked").alias("quality_operator_blocked"), F.col("overflow").alias("quality_overflow"), F.col("not_topical").alias("quality_old_data"), F.col("substituted").alias("quality_substituted"), "export_id")


def o74_stream_lfr(spark: SparkSession, d: str) -> DataFrame:
    path, s = storage.scratch(spark, "lfr"), aggregates.SETTINGS
    stored = jobs.with_last_tick(measurements(spark, d, aggregates.DENSE_MS), s)
    cells = jobs.stream_lfr(jobs.replayed(spark, stored, "live", "arrival_seq"), aggregates._units(spark, d), s)
    jobs.run_to_end(cells, path, jobs.publish_lfr(path, "urn:lfr:preferred", s))
    schema = "publication_id string, mrid string, double_value double, timestamp_field timestamp_ntz, timestamp_mccs timestamp_ntz, quality_valid boolean"
    return spark.read.schema(schema).parquet(f"{path}/sent").select("publication_id", F.round("double_value", 6).alias("double_value"), "timestamp_field")


def o77_materialize(spark: SparkSession, d: str) -> DataFrame:
    path = storage.scratch(spark, "sessions")
    storage.write_live_store(measurements(spark, d), f"{path}-live")
    requests = jobs.replayed(spark, session_requests(spark, d), "requests")
    jobs.run_to_end(requests, path, jobs.extract_sessions(spark.read.parquet(f"{path}-live"), path))
    evidence = S.validate_blobmeta(spark.read.schema(jobs.EVIDENCE).parquet(f"{path}/published"))
    return evidence.select("session_id", "status", "measurement_count", "rejection_reason", F.size(F.coalesce("coverage", F.array())).alias("signals"), joined_reasons())


QUERIES = {f.__name__: f for f in (s69_formula, o70_stream_latest, o71_stream_alarm, o72_stream_capture, o73_stream_export, o74_stream_lfr, o77_materialize)}

_cut = "SELECT * EXCLUDE (common_address, object_address) FROM ("
ORACLES = {
    "s69_formula": episodes.ORACLES["o69_formula"],
    "o70_stream_latest": episodes.ORACLES["o24_latest_values"],
    "o71_stream_alarm": episodes.ORACLES["o52_transitions"],
    "o72_stream_capture": f"SELECT mrid, onset, cleared_at FROM ({episodes.ORACLES['o55_capture']})",
    "o73_stream_export": f"{_cut}{aggregates.ORACLES['o39_second_mean']})",
    "o74_stream_lfr": f"{aggregates._LFR} SELECT 'urn:lfr:preferred:' || second AS publication_id, round(frequency, 6) AS double_value, to_timestamp(second + 1)::TIMESTAMP AS timestamp_field FROM f",
    "o77_materialize": f"""{sessions._R} SELECT session_id, CASE WHEN min(n) > 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS status, sum(n)::BIGINT AS measurement_count, NULL AS rejection_reason, count(*)::INT AS signals, '' AS reasons FROM c GROUP BY session_id
UNION ALL SELECT session_id, 'REJECTED', 0, CASE fault WHEN 7 THEN 'interval_too_long' WHEN 11 THEN 'mrids_unsorted' WHEN 13 THEN 'metadata_unsorted' WHEN 17 THEN 'metadata_key' ELSE 'metadata_value' END, 0, '' FROM requests WHERE fault IN (7, 11, 13, 17, 19)""",
}
