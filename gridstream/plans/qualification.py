"""Registered queries of scans, projections and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstream.functions import columns as C
from gridstream.operators import qualify as Q
from gridstream.plans.base import FINE, LOG, STRICT, M
from gridstream.sources.fixtures import fine_measurements, measurements, membership_log, read
from gridstream.sources.topics import read_measurements

SHORT = "arrival_seq, mrid, timestamp_mccs, value_type, double_value, quality_valid"
_short = [c.strip() for c in SHORT.split(",")]
RULES = [("purchase-high", "urn:grid:site:*:purchase", 50.1, "warning"), ("error-critical", "urn:grid:site:*:error", 60.0, "critical")]
_rules_sql = "rules(rule, pattern, threshold, severity) AS (VALUES " + ", ".join(f"('{r}', '{g}', CAST({t} AS DOUBLE), '{s}')" for r, g, t, s in RULES) + ")"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "rule string, glob string, threshold double, severity string")


def o1_read_measurements(spark: SparkSession, d: str) -> DataFrame:
    return read_measurements(measurements(spark, d)).select(*_short)


def o2_flatten(spark: SparkSession, d: str) -> DataFrame:
    m = measurements(spark, d)
    value = F.struct(*[F.col(c).alias(k) for k, c in Q.VALUE_COLUMNS.items()])
    flags = F.struct(*[F.col(q).alias(f) for f, q in zip(Q.FLAGS, Q.QUALITY, strict=True)])
    nested = m.select("arrival_seq", F.struct("mrid", "timestamp_field", "timestamp_gateway", "timestamp_mccs", value.alias("value"), flags.alias("quality")).alias("message"))
    return Q.flatten_measurement(nested).select(*_short, "int_value", "quality_old_data")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").selectExpr(
        "event_id AS arrival_seq", "CASE WHEN event_id % 37 = 0 THEN '' ELSE concat('urn:', event_type) END AS mrid",
        "CASE WHEN event_id % 5 <> 1 THEN CAST(CAST(value * 100 AS INT) AS STRING) END AS double_value",
        "CASE WHEN event_id % 31 = 0 THEN '7' WHEN event_id % 41 = 0 THEN 'x' END AS int_value",
        "CASE WHEN event_id % 5 = 1 THEN CAST(user_id - 3 AS STRING) END AS uint_value",
        "CAST(NULL AS STRING) AS bool_value", "CAST(NULL AS STRING) AS string_value", "CAST(NULL AS STRING) AS timestamp_value",
        "CASE WHEN event_id % 43 = 0 THEN '2024-01-01T00:00:00' ELSE '2024-01-01T00:00:00Z' END AS timestamp_mccs",
        "CAST(NULL AS STRING) AS timestamp_field", "CAST(NULL AS STRING) AS timestamp_gateway",
        "CASE WHEN event_id % 47 = 0 THEN 'yes' WHEN event_id % 2 = 0 THEN 'True' END AS quality_valid",
        *[f"CAST(NULL AS STRING) AS {q}" for q in Q.QUALITY[1:]],
    )


def o4_parse_scalar_row(spark: SparkSession, d: str) -> DataFrame:
    out = Q.parse_scalar_row(_texts(spark, d))
    return out.select("arrival_seq", "value_type", "double_value", "int_value", "uint_value", "timestamp_mccs", "quality_valid", F.array_join("reasons", ",").alias("reasons"))


def o9_weather(spark: SparkSession, d: str) -> DataFrame:
    wide = read(spark, d, "events").selectExpr("concat(CAST(event_id AS STRING)) AS site", "ts", "value AS temperature", "CASE WHEN event_id % 3 = 0 THEN double('NaN') ELSE value / 8 END AS wind_speed", "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(user_id % 360 AS DOUBLE) END AS wind_direction")
    return Q.weather_to_measurements(wide)


def o10_compact(spark: SparkSession, d: str) -> DataFrame:
    return Q.compact(membership_log(spark, d), "source", ["arrival_seq"], "value").select("source", "value", "arrival_seq")


def o11_qualify_key(spark: SparkSession, d: str) -> DataFrame:
    return Q.qualify_key(measurements(spark, d)).select(*_short)


def o12_qualify_quality(spark: SparkSession, d: str) -> DataFrame:
    m = measurements(spark, d)
    parts = [Q.qualify_quality(m, p).select(F.lit(p).alias("profile"), "arrival_seq", "mrid") for p in ("any", "explicit_valid", "strict")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("profile", "mrid").agg(F.count(F.lit(1)).alias("n"), F.max("arrival_seq").alias("last"))


def o13_qualify_double(spark: SparkSession, d: str) -> DataFrame:
    return Q.qualify_double(measurements(spark, d)).select(*_short)


def o14_freshness(spark: SparkSession, d: str) -> DataFrame:
    return Q.freshness_filter(measurements(spark, d)).select(*_short)


def o15_newer_only(spark: SparkSession, d: str) -> DataFrame:
    return Q.newer_only(measurements(spark, d), ["mrid"]).select(*_short)


def o15_exact_time(spark: SparkSession, d: str) -> DataFrame:
    return Q.newer_only(fine_measurements(spark, d), ["mrid"]).select(*_short)


def o16_match_glob(spark: SparkSession, d: str) -> DataFrame:
    return Q.match_mrid_glob(measurements(spark, d), rules(spark)).select("arrival_seq", "mrid", "rule", "threshold")


def o17_select_signals(spark: SparkSession, d: str) -> DataFrame:
    m, t = measurements(spark, d), lambda x: F.lit(x).cast("timestamp_ntz")
    mrids = ["urn:grid:site:03:view", "urn:grid:site:04:click"]
    parts = [Q.select_signals(m, mrids, t("2024-01-01 01:01:00"), t("2024-01-01 01:10:00"), b).withColumn("bounds", F.lit(b)) for b in ("half_open", "closed")]
    return parts[0].unionByName(parts[1]).select("bounds", *_short)


def o18_numeric_value(spark: SparkSession, d: str) -> DataFrame:
    return measurements(spark, d).select("arrival_seq", C.numeric_value().alias("value"))


def o19_label_signals(spark: SparkSession, d: str) -> DataFrame:
    signals = read(spark, d, "nation").selectExpr("concat('urn:grid:site:', lpad(CAST(n_nationkey AS STRING), 2, '0'), ':view') AS mrid", "n_name AS site", "CAST(n_nationkey AS DOUBLE) + 40 AS latitude", "CAST(n_regionkey AS DOUBLE) AS longitude", "'view' AS metric")
    return Q.label_signals(measurements(spark, d), signals).select("arrival_seq", "site", "latitude", "longitude", "metric", "double_value")


def o20_flag_rejections(spark: SparkSession, d: str) -> DataFrame:
    return Q.flag_rejections(measurements(spark, d), 10.0, 60.0).select("arrival_seq", F.array_join("reasons", ",").alias("reasons"))


def o21_stat_quality(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").selectExpr("event_id", "CAST(pmod(event_id * 7919, 65536) AS INT) * CAST(event_id % 4 <> 0 AS INT) AS stat")
    g, o = Q.stat_quality(F.col("stat"), "gateway"), Q.stat_quality(F.col("stat"), "onboarding")
    return e.select("event_id", "stat", g["valid"].alias("g_valid"), g["substituted"].alias("g_subst"), o["valid"].alias("o_valid"), o["substituted"].alias("o_subst"))


def _frames(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    frames = read(spark, d, "events").selectExpr(
        "concat('pmu-', CAST(user_id % 20 AS STRING)) AS source_id", "event_id", "1704070800 + CAST(floor(event_id / 8) AS BIGINT) AS soc",
        "CAST((event_id % 8) * 124999 AS BIGINT) AS fracsec", "CAST(1000000 AS BIGINT) AS time_base", "CAST(CASE WHEN event_id % 6 = 0 THEN 512 ELSE 0 END AS INT) AS stat",
        "(1704070800 + CAST(floor(event_id / 8) AS BIGINT)) * 1000000 + CASE WHEN event_id % 9 = 0 THEN -1000000 ELSE 900000 END AS gateway_us",
        "value AS frequency", "CASE WHEN event_id % 10 = 0 THEN double('NaN') ELSE value / 100 END AS rocof", "map('VA', value * 4, 'VB', value * 5) AS phasors",
    )
    numbers = read(spark, d, "nation").where("n_nationkey < 20").selectExpr("concat('pmu-', CAST(n_nationkey AS STRING)) AS source_id")
    kinds = F.inline(F.array(*[F.struct(F.lit(a).alias("selector"), F.lit(b).alias("channel")) for a, b in (("frequency", "FREQ"), ("rocof", "DFREQ"), ("phasor", "VA"), ("phasor", "VC"))]))
    signals = numbers.select("source_id", kinds).withColumn("mrid", F.concat(F.lit("urn:"), "source_id", F.lit(":"), "channel"))
    return frames, signals


def o22_normalize_frames(spark: SparkSession, d: str) -> DataFrame:
    frames, signals = _frames(spark, d)
    parts = [Q.normalize_frames(frames, signals, v).withColumn("variant", F.lit(v)) for v in ("gateway", "onboarding")]
    both = parts[0].unionByName(parts[1])
    text = F.array_join("reasons", ",")
    value = F.round(F.sum(F.when(C.finite(F.col("double_value")), F.col("double_value"))), 4).alias("total")
    return both.groupBy("variant", "mrid", text.alias("reasons"), "quality_valid", "quality_substituted").agg(F.count(F.lit(1)).alias("n"), F.min("field_us").alias("first_us"), F.max("field_us").alias("last_us"), value)


def o23_verify(spark: SparkSession, d: str) -> DataFrame:
    m = measurements(spark, d)
    more = read(spark, d, "nation").selectExpr("concat('urn:grid:site:', lpad(CAST(n_nationkey AS STRING), 2, '0'), ':view') AS mrid")
    return Q.verify_measurements(m, m.select("mrid").unionByName(more))




QUERIES = {f.__name__: f for f in (
    o1_read_measurements, o2_flatten, o4_parse_scalar_row, o9_weather, o10_compact, o11_qualify_key, o12_qualify_quality, o13_qualify_double,
    o14_freshness, o15_newer_only, o15_exact_time, o16_match_glob, o17_select_signals, o18_numeric_value, o19_label_signals, o20_flag_rejections, o21_stat_quality,
    o22_normalize_frames, o23_verify,
)}

_t = "timestamp_mccs"
ORACLES = {
    "o1_read_measurements": f"{M} SELECT {SHORT} FROM m",
    "o2_flatten": f"{M} SELECT {SHORT}, int_value, quality_old_data FROM m",
    "o4_parse_scalar_row": """
WITH t AS (SELECT event_id AS arrival_seq, CASE WHEN event_id % 37 = 0 THEN '' ELSE 'urn:' || event_type END AS mrid,
  CASE WHEN event_id % 5 <> 1 THEN CAST(CAST(trunc(value * 100) AS INT) AS VARCHAR) END AS dv,
  CASE WHEN event_id % 31 = 0 THEN '7' WHEN event_id % 41 = 0 THEN 'x' END AS iv,
  CASE WHEN event_id % 5 = 1 THEN CAST(user_id - 3 AS VARCHAR) END AS uv, event_id % 43 = 0 AS no_zone,
  CASE WHEN event_id % 47 = 0 THEN 'yes' WHEN event_id % 2 = 0 THEN 'True' END AS qv FROM events)
SELECT arrival_seq, CASE WHEN dv IS NOT NULL THEN 'double' WHEN iv IS NOT NULL THEN 'int' WHEN uv IS NOT NULL THEN 'uint' END AS value_type,
  TRY_CAST(dv AS DOUBLE) AS double_value, TRY_CAST(iv AS BIGINT) AS int_value, TRY_CAST(uv AS BIGINT) AS uint_value,
  CASE WHEN NOT no_zone THEN TIMESTAMP '2024-01-01 00:00:00' END AS timestamp_mccs,
  CASE WHEN lower(qv) = 'true' THEN true WHEN lower(qv) = 'false' THEN false END AS quality_valid,
  concat_ws(',', CASE WHEN mrid = '' THEN 'no_mrid' END, CASE WHEN (dv IS NOT NULL)::INT + (iv IS NOT NULL)::INT + (uv IS NOT NULL)::INT <> 1 THEN 'not_one_scalar' END,
    CASE WHEN iv = 'x' THEN 'bad_value' END, CASE WHEN TRY_CAST(uv AS BIGINT) < 0 THEN 'negative_uint' END, CASE WHEN no_zone THEN 'bad_time' END, CASE WHEN qv = 'yes' THEN 'bad_flag' END) AS reasons
FROM t""",
    "o9_weather": """
WITH w AS (SELECT event_id, ts, value, user_id FROM events), tall AS (
  SELECT CAST(event_id AS VARCHAR) AS site, ts, 'temperature' AS quantity, value AS v FROM w
  UNION ALL SELECT CAST(event_id AS VARCHAR), ts, 'wind_speed', value / 8 FROM w WHERE event_id % 3 <> 0
  UNION ALL SELECT CAST(event_id AS VARCHAR), ts, 'wind_direction', CAST(user_id % 360 AS DOUBLE) FROM w WHERE event_id % 5 <> 0)
SELECT 'urn:weather:' || site || ':' || quantity AS mrid, ts AS timestamp_mccs, 'double' AS value_type, v AS double_value, true AS quality_valid FROM tall""",
    "o10_compact": f"WITH {LOG} SELECT source, value, arrival_seq FROM log QUALIFY row_number() OVER (PARTITION BY source ORDER BY arrival_seq DESC) = 1 AND value IS NOT NULL",
    "o11_qualify_key": f"{M} SELECT {SHORT} FROM m WHERE kafka_key = mrid",
    "o12_qualify_quality": f"""{M}, p AS (SELECT 'any' AS profile, * FROM m UNION ALL SELECT 'explicit_valid', * FROM m WHERE quality_valid UNION ALL SELECT 'strict', * FROM m WHERE {STRICT})
SELECT profile, mrid, count(*) AS n, max(arrival_seq) AS last FROM p GROUP BY ALL""",
    "o13_qualify_double": f"{M} SELECT {SHORT} FROM m WHERE value_type = 'double' AND isfinite(double_value)",
    "o14_freshness": f"{M} SELECT {SHORT} FROM m WHERE received_at - timestamp_mccs <= INTERVAL 30 SECONDS",
    "o15_newer_only": f"{M}, s AS (SELECT *, max({_t}) OVER (PARTITION BY mrid ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m) SELECT {SHORT} FROM s WHERE seen IS NULL OR {_t} > seen",
    "o15_exact_time": f"{FINE}, s AS (SELECT *, max(ns) OVER (PARTITION BY mrid ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM f) SELECT {SHORT} FROM s WHERE seen IS NULL OR ns > seen",
    "o16_match_glob": f"{M}, {_rules_sql} SELECT arrival_seq, mrid, rule, threshold FROM m JOIN rules ON regexp_full_match(mrid, replace(pattern, '*', '[^:]+'))",
    "o17_select_signals": f"""{M}, s AS (SELECT * FROM m WHERE mrid IN ('urn:grid:site:03:view', 'urn:grid:site:04:click') AND {_t} >= TIMESTAMP '2024-01-01 01:01:00')
SELECT 'half_open' AS bounds, {SHORT} FROM s WHERE {_t} < TIMESTAMP '2024-01-01 01:10:00' UNION ALL SELECT 'closed', {SHORT} FROM s WHERE {_t} <= TIMESTAMP '2024-01-01 01:10:00'""",
    "o18_numeric_value": f"{M} SELECT arrival_seq, coalesce(double_value, CAST(int_value AS DOUBLE), CAST(uint_value AS DOUBLE)) AS value FROM m",
    "o19_label_signals": f"""{M} SELECT arrival_seq, n_name AS site, CAST(n_nationkey AS DOUBLE) + 40 AS latitude, CAST(n_regionkey AS DOUBLE) AS longitude, 'view' AS metric, double_value
FROM m JOIN nation ON mrid = 'urn:grid:site:' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || ':view'""",
    "o20_flag_rejections": f"""{M} SELECT arrival_seq, concat_ws(',', CASE WHEN quality_valid IS FALSE THEN 'invalid_status' END, CASE WHEN quality_valid IS NULL THEN 'missing_status' END,
  CASE WHEN double_value IS NULL THEN 'non_finite_value' END, CASE WHEN quality_old_data THEN 'old_data' END,
  CASE WHEN double_value < 10 OR double_value > 60 THEN 'out_of_band' END, CASE WHEN quality_substituted THEN 'substituted' END) AS reasons FROM m""",
    "o21_stat_quality": """WITH s AS (SELECT event_id, CAST((event_id * 7919) % 65536 * (event_id % 4 <> 0)::INT AS INT) AS stat FROM events)
SELECT event_id, stat, stat = 0 AS g_valid, (stat & 512) <> 0 AS g_subst, (stat >> 14) & 3 = 0 AND (stat & 8192) = 0 AS o_valid, (stat >> 14) & 3 = 2 AS o_subst FROM s""",
    "o22_normalize_frames": """
WITH f AS (SELECT 'pmu-' || CAST(user_id % 20 AS VARCHAR) AS source_id, event_id, 1704070800 + event_id // 8 AS soc, (event_id % 8) * 124999 AS fracsec,
  CASE WHEN event_id % 6 = 0 THEN 512 ELSE 0 END AS stat, (1704070800 + event_id // 8) * 1000000 + CASE WHEN event_id % 9 = 0 THEN -1000000 ELSE 900000 END AS gateway_us, value FROM events),
s(selector, channel) AS (VALUES ('frequency', 'FREQ'), ('rocof', 'DFREQ'), ('phasor', 'VA'), ('phasor', 'VC')),
r AS (SELECT 'urn:' || source_id || ':' || channel AS mrid, soc * 1000000 + (fracsec * 1000000000 // 1000000) // 1000 AS field_us, gateway_us, stat, channel, event_id,
  CASE channel WHEN 'FREQ' THEN value WHEN 'DFREQ' THEN CASE WHEN event_id % 10 = 0 THEN 'NaN'::DOUBLE ELSE value / 100 END WHEN 'VA' THEN value * 4 END AS v FROM f, s),
b AS (SELECT 'gateway' AS variant, mrid, concat_ws(',', CASE WHEN v IS NULL THEN 'no_channel' END, CASE WHEN field_us > gateway_us + 250000 THEN 'field_ahead' END) AS reasons, stat = 0 AS quality_valid, stat = 512 AS quality_substituted, field_us, v FROM r
 UNION ALL SELECT 'onboarding', mrid, concat_ws(',', CASE WHEN v IS NULL THEN 'no_channel' END, CASE WHEN isnan(v) THEN 'non_finite' END, CASE WHEN field_us > gateway_us THEN 'field_ahead' END), true, false, field_us, v FROM r)
SELECT variant, mrid, reasons, quality_valid, quality_substituted, count(*) AS n, min(field_us) AS first_us, max(field_us) AS last_us, round(sum(v) FILTER (WHERE isfinite(v)), 4) AS total FROM b GROUP BY ALL""",
    "o23_verify": f"""{M}, c AS (SELECT mrid FROM m UNION SELECT 'urn:grid:site:' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || ':view' FROM nation),
p AS (SELECT mrid, count(*) AS seen, count(*) FILTER (WHERE kafka_key = mrid AND value_type = 'double' AND isfinite(double_value) AND quality_valid IS TRUE AND timestamp_field <= timestamp_mccs) AS well_formed FROM m GROUP BY mrid)
SELECT mrid, coalesce(seen, 0) AS seen, coalesce(well_formed, 0) AS well_formed, seen IS NULL AS missing FROM c LEFT JOIN p USING (mrid)""",
}
