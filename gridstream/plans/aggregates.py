"""Registered queries of aggregations, dashboards and preferred frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstream.operators import aggregate as A
from gridstream.operators import lfr as L
from gridstream.plans.base import DENSE, M, uuid5
from gridstream.sources.fixtures import measurements, metric_samples, read

SETTINGS = L.Settings()
DENSE_MS = 5


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "nation").where("n_nationkey < 20").selectExpr("concat('urn:grid:site:', lpad(CAST(n_nationkey AS STRING), 2, '0'), ':click') AS mrid", "n_nationkey + 1 AS common_address", "100 + n_nationkey AS object_address")


def o39_second_mean(spark: SparkSession, d: str) -> DataFrame:
    out = A.second_mean_export(measurements(spark, d), _mapping(spark, d))
    return out.select("mrid", "second", "common_address", "object_address", "n", F.round("mean", 6).alias("mean"), *A.QUALITY[1:], "export_id")


def _units(spark: SparkSession, d: str) -> DataFrame:
    site = "concat('urn:grid:site:', lpad(CAST(n_nationkey AS STRING), 2, '0'))"
    return read(spark, d, "nation").where("n_nationkey < 20").selectExpr("concat('pmu-', n_nationkey) AS pmu", f"concat({site}, ':click') AS frequency_mrid", f"concat({site}, ':view') AS voltage_mrid")


def _seconds(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d)
    return L.pmu_second(L.accepted_inputs(measurements(spark, d, DENSE_MS), units, SETTINGS), units, SETTINGS)


def o40_pmu_second(spark: SparkSession, d: str) -> DataFrame:
    return _seconds(spark, d).select("pmu", "second", F.round("mean_frequency", 6).alias("mean_frequency"), F.round("mean_voltage", 6).alias("mean_voltage"), "good", "total", "rejections", F.round("availability", 6).alias("availability"))


def o41_classify(spark: SparkSession, d: str) -> DataFrame:
    return L.classify_pmu(_seconds(spark, d), SETTINGS).select("pmu", "second", "count_class", "voltage_class", "quality")


def _preferred(spark: SparkSession, d: str) -> DataFrame:
    return L.preferred_frequency(L.classify_pmu(_seconds(spark, d), SETTINGS), SETTINGS)


def o42_preferred(spark: SparkSession, d: str) -> DataFrame:
    return _preferred(spark, d).select("second", "quality", F.round("frequency", 6).alias("frequency"), "units", F.array_join("selected", ",").alias("selected"))


def o44_latest_by(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_by(measurements(spark, d), ["mrid"])


def o45_series_1s(spark: SparkSession, d: str) -> DataFrame:
    return A.series_1s(measurements(spark, d))


def o46_quality_series(spark: SparkSession, d: str) -> DataFrame:
    return A.quality_series_1s(measurements(spark, d))


def o47_freshness(spark: SparkSession, d: str) -> DataFrame:
    return A.freshness(measurements(spark, d))


def o48_distinct_signals(spark: SparkSession, d: str) -> DataFrame:
    return A.distinct_signals(measurements(spark, d), "urn:grid:site:0%")


def o49_blob_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.blob_counts(read(spark, d, "lineitem").selectExpr("concat('blob-', l_suppkey) AS blob_id", "concat('session-', l_partkey % 50) AS session_id"))


def o50_counter_rate(spark: SparkSession, d: str) -> DataFrame:
    s = metric_samples(spark, d)
    per = s.groupBy("flag", "instance", "ts").agg(F.sum("quantity").alias("q"))
    w = A.Window.partitionBy("flag", "instance", F.year("ts")).orderBy("ts").rowsBetween(A.Window.unboundedPreceding, 0)
    counters = per.withColumn("value", F.sum("q").over(w))
    rate = A.counter_rate(counters, ["flag", "instance"], ["flag"])
    return rate.select("flag", "ts", F.round("rate", 9).alias("rate"))


def o51_gauge_rollup(spark: SparkSession, d: str) -> DataFrame:
    s = metric_samples(spark, d)
    g = A.gauge_rollup(s, ["flag", "instance"], "used")
    u = A.usage_ratio(s, ["flag", "instance"], "idle", "quantity")
    return g.join(u, ["flag", "instance"]).select("flag", "instance", *[F.round(c, 6).alias(c) for c in ("total", "mean", "least", "most", "used_pct")], "n")


def o58_latest_records(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_records(measurements(spark, d)).select("arrival_seq", "mrid", "timestamp_mccs", "double_value")


def o59_latest_per_signal(spark: SparkSession, d: str) -> DataFrame:
    return A.latest_per_signal(measurements(spark, d)).select("mrid", "arrival_seq", "timestamp_mccs", "double_value", "int_value")


def o75_dedupe(spark: SparkSession, d: str) -> DataFrame:
    m = measurements(spark, d)
    twice = m.unionByName(m.where("arrival_seq % 3 = 0")).withColumn("second", A.second_of("timestamp_field"))
    return A.dedupe_inputs(twice, ["second", "mrid"]).groupBy("mrid").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("offset").alias("offsets"))


def o76_outbox(spark: SparkSession, d: str) -> DataFrame:
    pending = L.publications(_preferred(spark, d), "urn:lfr:preferred", SETTINGS)
    sent = pending.where(F.second("timestamp_field") % 5 == 0)
    out = L.outbox(pending.unionByName(pending), sent)
    return out.select("publication_id", "mrid", F.round("double_value", 6).alias("double_value"), "timestamp_field", "timestamp_mccs")


QUERIES = {f.__name__: f for f in (
    o39_second_mean, o40_pmu_second, o41_classify, o42_preferred, o44_latest_by, o45_series_1s, o46_quality_series, o47_freshness, o48_distinct_signals,
    o49_blob_counts, o50_counter_rate, o51_gauge_rollup, o58_latest_records, o59_latest_per_signal, o75_dedupe, o76_outbox,
)}

_flags = ", ".join(f"CAST(arg_max(coalesce({q}::INT, -1), k) AS INT) AS {q}" for q in ("quality_valid", "quality_substituted", "quality_operator_blocked", "quality_overflow", "quality_old_data"))
_LFR = f"""{DENSE}, u AS (SELECT 'pmu-' || n_nationkey AS pmu, 'urn:grid:site:' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS site FROM nation WHERE n_nationkey < 20),
i AS (SELECT pmu, mrid LIKE '%:click' AS is_f, double_value AS v, "offset", floor(epoch_ms(timestamp_field) / 1000)::BIGINT AS second, floor(epoch_ms(received_at) / 1000)::BIGINT AS rs,
  floor((epoch_ms(received_at) - 600) / 1000)::BIGINT - 1 AS closed,
  (quality_valid IS NULL)::INT + (quality_valid IS FALSE)::INT + coalesce(quality_substituted, false)::INT + coalesce(quality_old_data, false)::INT + (double_value IS NULL)::INT
   + (mrid LIKE '%:click' AND coalesce(double_value < 10 OR double_value > 60, false))::INT AS bad
  FROM m JOIN u ON mrid = site || ':click' OR mrid = site || ':view'),
k AS (SELECT * FROM i WHERE second <= rs + 1 AND second > closed),
p AS (SELECT pmu, second, avg(v) FILTER (WHERE is_f AND bad = 0) AS mf, avg(v) FILTER (WHERE NOT is_f AND bad = 0) AS mv, count(*) FILTER (WHERE is_f AND bad = 0) AS good, count(*) FILTER (WHERE is_f) AS total, sum(bad) AS rej FROM k GROUP BY ALL),
s AS (SELECT u.pmu, g.second, mf, mv, coalesce(good, 0) AS good, coalesce(total, 0) AS total, coalesce(rej, 0)::BIGINT AS rejections, CASE WHEN coalesce(total, 0) > 0 THEN good / total ELSE 0.0 END AS availability
  FROM (SELECT DISTINCT second FROM k) g CROSS JOIN u LEFT JOIN p ON p.pmu = u.pmu AND p.second = g.second),
c AS (SELECT *, CASE WHEN good <= 0 THEN 0 WHEN good >= 2 THEN 2 ELSE 1 END AS count_class, CASE WHEN abs(mv - 40) < 10 THEN 2 WHEN abs(mv - 40) <= 25 THEN 1 ELSE 0 END AS voltage_class FROM s),
q AS (SELECT *, CASE WHEN mf IS NULL THEN 0 ELSE least(count_class, voltage_class) END AS quality FROM c),
b0 AS (SELECT second, quality, list_sort(list(mf)) AS v, string_agg(pmu, ',' ORDER BY pmu) AS selected FROM q WHERE quality > 0 GROUP BY ALL), b AS (SELECT * FROM b0 QUALIFY quality = max(quality) OVER (PARTITION BY second)),
r AS (SELECT second, quality, selected, len(v) AS units, v[(len(v) + 1) // 2] AS lo, v[len(v) // 2 + 1] AS hi FROM b),
f AS (SELECT second, quality, selected, units, CASE WHEN abs(lo - 50) > abs(hi - 50) THEN lo WHEN abs(hi - 50) > abs(lo - 50) THEN hi ELSE lo END AS frequency FROM r)"""

_or = ", ".join(f"bool_or(coalesce(quality_{q}, false)) AS quality_{q}" for q in ("substituted", "operator_blocked", "overflow", "old_data"))
_seed = ["mrid", "epoch(second)::BIGINT", "CASE WHEN exact = 0 THEN '0x0.0p+0' ELSE format('{:.13a}', exact) END", "common_address", "object_address", "3", *(f"quality_{q}::INT" for q in ("operator_blocked", "old_data", "overflow", "substituted"))]
_XID = uuid5("f39fc794-f7e9-4d59-9c2a-5bb1d84af1b2", "(" + " || chr(0) || ".join(f"CAST({x} AS VARCHAR)" for x in _seed) + ")")

ORACLES = {
    "o39_second_mean": f"""{M}, g AS (SELECT m.*, n_nationkey + 1 AS common_address, 100 + n_nationkey AS object_address, date_trunc('second', timestamp_field) AS second
  FROM m JOIN nation ON n_nationkey < 20 AND mrid = 'urn:grid:site:' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || ':click' WHERE quality_valid IS TRUE AND double_value IS NOT NULL AND kafka_key = mrid),
r AS (SELECT *, max(second) OVER (PARTITION BY mrid ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM g),
w AS (SELECT mrid, second, common_address, object_address, max(abs(double_value)) AS scale, list(double_value) AS vs, count(*) AS n, {_or} FROM r WHERE run IS NULL OR second >= run GROUP BY ALL),
x AS (SELECT *, CASE WHEN scale = 0 THEN 0.0 ELSE scale * (list_sum(list_transform(list_sort(vs), lambda v: v / scale)) / n) + 0.0 END AS exact FROM w),
y AS (SELECT *, {_XID} AS export_id FROM x QUALIFY second < max(second) OVER (PARTITION BY mrid))
SELECT mrid, second, common_address, object_address, n, round(exact, 6) AS mean, quality_substituted, quality_operator_blocked, quality_overflow, quality_old_data, export_id FROM y""",
    "o40_pmu_second": f"{_LFR} SELECT pmu, second, round(mf, 6) AS mean_frequency, round(mv, 6) AS mean_voltage, good, total, rejections, round(availability, 6) AS availability FROM s",
    "o41_classify": f"{_LFR} SELECT pmu, second, count_class, voltage_class, quality FROM q",
    "o42_preferred": f"{_LFR} SELECT second, quality, round(frequency, 6) AS frequency, CAST(units AS INT) AS units, selected FROM f",
    "o44_latest_by": f"{M} SELECT mrid, arg_max(double_value, (timestamp_mccs, arrival_seq)) AS double_value, max(timestamp_mccs) AS timestamp_mccs FROM m WHERE double_value IS NOT NULL GROUP BY mrid",
    "o45_series_1s": f"{M} SELECT date_trunc('second', timestamp_mccs) AS second, mrid, arg_max(double_value, (timestamp_mccs, arrival_seq)) AS value FROM m WHERE double_value IS NOT NULL GROUP BY ALL",
    "o46_quality_series": f"{M}, x AS (SELECT *, date_trunc('second', timestamp_mccs) AS second, (timestamp_mccs, arrival_seq) AS k FROM m), y AS (SELECT second, mrid, {_flags} FROM x GROUP BY ALL) SELECT second, mrid, "
    + ", ".join(f"CASE WHEN {q} >= 0 THEN {q} END AS {q}" for q in ("quality_valid", "quality_substituted", "quality_operator_blocked", "quality_overflow", "quality_old_data"))
    + " FROM y",
    "o47_freshness": f"{M} SELECT mrid, max(timestamp_mccs) AS newest FROM m WHERE double_value IS NOT NULL GROUP BY mrid",
    "o48_distinct_signals": f"{M} SELECT value_type, count(DISTINCT mrid) AS signals FROM m WHERE mrid LIKE 'urn:grid:site:0%' GROUP BY value_type",
    "o49_blob_counts": "SELECT 'blob-' || l_suppkey AS blob_id, 'session-' || (l_partkey % 50) AS session_id, count(*) AS n FROM lineitem GROUP BY ALL",
    "o50_counter_rate": """WITH p AS (SELECT l_returnflag AS flag, l_suppkey AS instance, l_shipdate AS ts, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(q) OVER (PARTITION BY flag, instance, year(ts) ORDER BY ts) AS v FROM p),
d AS (SELECT flag, ts, v, lag(v) OVER w AS pv, epoch(ts) - epoch(lag(ts) OVER w) AS s FROM c WINDOW w AS (PARTITION BY flag, instance ORDER BY ts))
SELECT flag, ts, round(sum(CASE WHEN v < pv THEN v ELSE v - pv END / s), 9) AS rate FROM d WHERE s > 0 GROUP BY ALL""",
    "o51_gauge_rollup": """WITH g AS (SELECT l_returnflag AS flag, l_suppkey AS instance, sum(l_tax) AS total, avg(l_tax) AS mean, min(l_tax) AS least, max(l_tax) AS most, count(l_tax) AS n, sum(l_discount) AS part, sum(l_quantity) AS whole
FROM lineitem GROUP BY ALL)
SELECT flag, instance, round(total, 6) AS total, round(mean, 6) AS mean, round(least, 6) AS least, round(most, 6) AS most, round(CASE WHEN whole <> 0 THEN 100 * (1 - part / whole) END, 6) AS used_pct, n FROM g""",
    "o58_latest_records": f"{M} SELECT arrival_seq, mrid, timestamp_mccs, double_value FROM m ORDER BY timestamp_mccs DESC, arrival_seq DESC LIMIT 32",
    "o59_latest_per_signal": f"{M} SELECT mrid, arrival_seq, timestamp_mccs, double_value, int_value FROM m QUALIFY row_number() OVER (PARTITION BY mrid ORDER BY timestamp_mccs DESC, arrival_seq DESC) = 1",
    "o76_outbox": f"""{_LFR} SELECT 'urn:lfr:preferred:' || second AS publication_id, 'urn:lfr:preferred' AS mrid, round(frequency, 6) AS double_value,
  make_timestamp((second + 1) * 1000000) AS timestamp_field, make_timestamp((second + 1) * 1000000 + 600000) AS timestamp_mccs FROM f WHERE (second + 1) % 60 % 5 <> 0""",
    "o75_dedupe": f"{M} SELECT mrid, count(*) AS n, count(DISTINCT \"offset\") AS offsets FROM m GROUP BY mrid",
}

