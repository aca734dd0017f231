"""Registered queries of alarms, captures, change logs and derived values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstream.functions import columns as C
from gridstream.operators import alarms as A
from gridstream.plans.base import FINE, LOG, STRICT, M, uuid5
from gridstream.plans.qualification import _rules_sql, rules
from gridstream.sources.fixtures import fine_measurements, measurements, membership_log, read
from gridstream.spec import ProcessorSpec


KINDS = ["click", "error", "purchase", "signup", "view"]


def members(spark: SparkSession, d: str, log: DataFrame | None = None) -> DataFrame:
    """Additions and removals of signals, from the change log of their sources."""
    signals = F.array(*[F.concat(F.lit("urn:grid:"), "source", F.lit(f":{k}")) for k in KINDS])
    return A.member_events(membership_log(spark, d) if log is None else log, signals)


def _transitions(spark: SparkSession, d: str, log: DataFrame | None = None) -> DataFrame:
    return A.member_transitions(A.alarm_observations(measurements(spark, d), rules(spark)), members(spark, d, log), rules(spark))


def o24_latest_values(spark: SparkSession, d: str) -> DataFrame:
    names = ["click", "view", "error"]
    m = measurements(spark, d).where(C.finite(F.col("double_value")) & F.coalesce("quality_valid", F.lit(False)) & (F.col("kafka_key") == F.col("mrid")))
    inputs = _site_inputs(spark, d, names)
    out = A.latest_values_join(m, inputs, F.col("click") + F.col("view") - F.col("error"), names, 30.0)
    return out.select("group", "arrival_seq", "newest", F.round("value", 6).alias("value"))


def o24_suppressed(spark: SparkSession, d: str) -> DataFrame:
    names = ["click", "view", "error"]
    out = A.latest_values_audit(measurements(spark, d), _site_inputs(spark, d, names), F.col("click") + F.col("view") - F.col("error"), names, 30.0)
    return out.select("group", "arrival_seq", "input", "reason", F.round("value", 6).alias("value"))


def _site_inputs(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    site = read(spark, d, "nation").where("n_nationkey < 20").selectExpr("concat('urn:grid:site:', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS `group`")
    return site.select("group", F.explode(F.array(*[F.lit(n) for n in names])).alias("input")).withColumn("mrid", F.concat("group", F.lit(":"), "input"))


def o25_pair_product(spark: SparkSession, d: str) -> DataFrame:
    phases = _site_inputs(spark, d, ["view", "click"]).withColumn("input", F.when(F.col("input") == "view", "voltage").otherwise("current"))
    return A.pair_product(measurements(spark, d), phases).select("group", "arrival_seq", F.round("value", 6).alias("value"))


def _sourced(spark: SparkSession, d: str) -> DataFrame:
    return measurements(spark, d).select("arrival_seq", "mrid", F.concat(F.lit("site:"), F.substring("mrid", 15, 2)).alias("source"))


def o26_membership_join(spark: SparkSession, d: str) -> DataFrame:
    return A.membership_join(_sourced(spark, d), A.membership_intervals(membership_log(spark, d))).select("arrival_seq", "mrid", "member_value", "member_from")


def o29_reconcile_desired(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    desired = o.where("o_orderkey % 3 = 0").selectExpr("concat('urn:', o_custkey) AS mrid", "concat('ep/', o_orderkey) AS episode_id", "o_orderpriority AS severity")
    remote = o.where("o_orderkey % 2 = 0").selectExpr("concat('ep/', o_orderkey) AS event", "concat('urn:', CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END) AS resource", "CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'ack' END AS status", "CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE 'grid' END AS owner")
    return A.reconcile_desired(desired, remote, "grid")


def o52_transitions(spark: SparkSession, d: str) -> DataFrame:
    return _transitions(spark, d).select("alarm_key", "arrival_seq", "action", "episode_id", "activated_at")


def o52_exact_time(spark: SparkSession, d: str) -> DataFrame:
    out = A.alarm_transitions(A.alarm_observations(fine_measurements(spark, d), rules(spark)))
    return out.select("alarm_key", "arrival_seq", "action", "episode_id", "activated_at")


def o53_current(spark: SparkSession, d: str) -> DataFrame:
    # as of the last measurement: the log goes on long after it
    last = measurements(spark, d).agg(F.max("arrival_seq")).scalar()
    return A.alarm_current(_transitions(spark, d, membership_log(spark, d).where(F.col("arrival_seq") <= last)))


def o54_replay(spark: SparkSession, d: str) -> DataFrame:
    return A.alarm_replay(measurements(spark, d), rules(spark), members=members(spark, d)).groupBy("rule", "mrid", "action").agg(F.count(F.lit(1)).alias("n"), F.max("timestamp_mccs").alias("last"))


def policies(spark: SparkSession, d: str) -> DataFrame:
    site = "concat('urn:grid:site:', lpad(CAST(n_nationkey AS STRING), 2, '0'), ':')"
    return read(spark, d, "nation").where("n_nationkey < 20").selectExpr(f"concat({site}, 'error') AS mrid", "50.2D AS threshold", f"array(concat({site}, 'click'), concat({site}, 'view')) AS mrids")


def o55_capture(spark: SparkSession, d: str) -> DataFrame:
    return A.capture_episodes(measurements(spark, d), policies(spark, d)).select("mrid", "onset", "cleared_at", "started_at", "ended_at", "session_id", "dropped")


def o55_exact_time(spark: SparkSession, d: str) -> DataFrame:
    return A.capture_episodes(fine_measurements(spark, d), policies(spark, d)).select("mrid", "arrival_seq", "onset", "cleared_at")


def o56_first_notifications(spark: SparkSession, d: str) -> DataFrame:
    return A.first_notifications(_transitions(spark, d)).select("episode_id", "rule", "mrid", "arrival_seq")


def o62_membership_changes(spark: SparkSession, d: str) -> DataFrame:
    return A.membership_changes(membership_log(spark, d))


def o63_union_events(spark: SparkSession, d: str) -> DataFrame:
    m = measurements(spark, d).select("arrival_seq", "mrid", "double_value")
    out = A.union_events(m, membership_log(spark, d).select("arrival_seq", "source", "value"))
    return out.select("arrival_seq", "mrid", "double_value", "source", "value")


def o64_alarm_key(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select("p_partkey", C.alarm_key(F.col("p_name"), F.concat("p_brand", F.lit("?>"), F.col("p_partkey").cast("string"))).alias("key"))
    parts = C.alarm_key_parts(F.col("key"))
    return p.select("p_partkey", "key", parts["rule"].alias("rule"), parts["mrid"].alias("mrid"))


def o65_uuid5(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", C.uuid5(C.EPISODE_NAMESPACE, F.col("o_orderkey").cast("string")).alias("id"))


def o66_canonical_uuid(spark: SparkSession, d: str) -> DataFrame:
    i = C.uuid5(C.EPISODE_NAMESPACE, F.col("o_orderkey").cast("string"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.upper(i)).when(F.col("o_orderkey") % 5 == 0, F.concat(i, F.lit("0"))).otherwise(i)
    return read(spark, d, "orders").select("o_orderkey", C.canonical_uuid(text).alias("ok"))


def o67_format_evidence(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", C.summary(F.col("value"), F.lit(50.1)).alias("summary"))


def o69_formula(spark: SparkSession, d: str) -> DataFrame:
    spec = ProcessorSpec.formula("urn:grid:site:03:view", "urn:grid:site:03:view-m", F.col("double_value") * 1000)
    return spec.apply(measurements(spark, d)).select("arrival_seq", "mrid", "timestamp_mccs", "quality_valid", F.round("double_value", 6).alias("double_value"))


def o78_processor_spec(spark: SparkSession, d: str) -> DataFrame:
    names = ["purchase", "signup"]
    spec = ProcessorSpec.latest_values({f"urn:grid:site:{k:02d}": {n: f"urn:grid:site:{k:02d}:{n}" for n in names} for k in range(20)}, ":ratio", F.try_divide("purchase", "signup"), max_age_s=20.0)
    return spec.apply(measurements(spark, d), ts="received_at").select("mrid", "arrival_seq", F.round("double_value", 6).alias("double_value"))


QUERIES = {f.__name__: f for f in (
    o24_latest_values, o24_suppressed, o25_pair_product, o26_membership_join, o29_reconcile_desired, o52_transitions, o52_exact_time, o53_current, o54_replay, o55_capture, o55_exact_time,
    o56_first_notifications, o62_membership_changes, o63_union_events, o64_alarm_key, o65_uuid5, o66_canonical_uuid, o67_format_evidence, o69_formula, o78_processor_spec,
)}

_B64 = "translate(rtrim(base64(encode({0})), '='), '+/', '-_')"
_KEY = "'alarm/v1/' || " + _B64.format("rule") + " || '/' || " + _B64.format("mrid")
_EP = "f5d55f94-655f-5460-a315-f56a8a891007"
_ID = uuid5(_EP, """('["' || alarm_key || '","live","0","' || "offset" || '"]')""")
_T = f"""{M}, {_rules_sql}, {LOG},
ch AS (SELECT *, lead(arrival_seq) OVER (PARTITION BY source ORDER BY arrival_seq) AS valid_to, coalesce(lag(value IS NOT NULL) OVER (PARTITION BY source ORDER BY arrival_seq), false) AS was FROM log),
q AS (SELECT * FROM m WHERE {STRICT} AND value_type = 'double' AND isfinite(double_value) AND kafka_key = mrid AND received_at - timestamp_mccs <= INTERVAL 30 SECONDS),
o AS (SELECT q.*, rule, threshold FROM q JOIN rules ON regexp_full_match(mrid, replace(pattern, '*', '[^:]+'))),
i AS (SELECT o.rule, o.mrid, o.arrival_seq, timestamp_mccs, double_value, threshold, "offset", false AS gone FROM o JOIN ch ON ch.source = 'site:' || substr(mrid, 15, 2) AND o.arrival_seq >= ch.arrival_seq AND (valid_to IS NULL OR o.arrival_seq < valid_to) WHERE value IS NOT NULL
  UNION ALL SELECT rule, replace(pattern, '*', substr(source, 6, 2)), arrival_seq, NULL, NULL, NULL, NULL, true FROM ch, rules WHERE value IS NULL AND was),
n AS (SELECT *, max(timestamp_mccs) OVER (PARTITION BY rule, mrid ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM i),
k AS (SELECT *, NOT gone AND double_value > threshold AS above FROM n WHERE gone OR seen IS NULL OR timestamp_mccs > seen),
w AS (SELECT *, coalesce(lag(above) OVER (PARTITION BY rule, mrid ORDER BY arrival_seq), false) AS was FROM k),
a AS (SELECT *, {_KEY} AS alarm_key, CASE WHEN above AND NOT was THEN 'activate' WHEN above THEN 'refresh' WHEN was THEN 'clear' WHEN NOT gone THEN 'evaluate' END AS action FROM w WHERE above OR was OR NOT gone),
g AS (SELECT *, sum((action = 'activate')::INT) OVER (PARTITION BY rule, mrid ORDER BY arrival_seq) AS run FROM a),
t AS (SELECT *, CASE WHEN action <> 'evaluate' THEN first_value(timestamp_mccs) OVER r END AS activated_at, CASE WHEN action <> 'evaluate' THEN first_value({_ID}) OVER r END AS episode_id
  FROM g WINDOW r AS (PARTITION BY rule, mrid, run ORDER BY arrival_seq))"""
_T53 = _T.replace(LOG, LOG.replace("FROM orders", "FROM orders WHERE o_orderkey <= (SELECT max(event_id) FROM events)"))
_FINE_ROWS = f"{STRICT} AND value_type = 'double' AND isfinite(double_value) AND kafka_key = mrid"
_IV = f"WITH {LOG}, iv AS (SELECT *, lead(arrival_seq) OVER (PARTITION BY source ORDER BY arrival_seq) AS valid_to FROM log)"
_LAST = "last_value(CASE WHEN input = '{0}' THEN {1} END IGNORE NULLS) OVER w AS {2}"


def _latest(inputs: list[str], where: str) -> str:
    fields = ", ".join(_LAST.format(n, "double_value", n) + ", " + _LAST.format(n, "received_at", f"t_{n}") for n in inputs)
    names = ", ".join(f"'{n}'" for n in inputs)
    return f"""{M}, i AS (SELECT *, substr(mrid, 1, 16) AS grp, split_part(mrid, ':', 5) AS input FROM m WHERE split_part(mrid, ':', 5) IN ({names}) AND {where}),
l AS (SELECT *, {fields} FROM i WINDOW w AS (PARTITION BY grp ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


_VALID = "quality_valid IS TRUE AND double_value IS NOT NULL AND kafka_key = mrid"
_PID = uuid5(_EP, "CAST(o_orderkey AS VARCHAR)")
_CAP = uuid5("8f3c89c2-0b2f-5a40-b6ed-7e22a1b24f63", """('["' || mrid || '","' || strftime(onset, '%Y-%m-%dT%H:%M:%S.%f') || '","' || strftime(timestamp_mccs, '%Y-%m-%dT%H:%M:%S.%f') || '"]')""")

ORACLES = {
    "o24_latest_values": _latest(["click", "view", "error"], _VALID)
    + """, f AS (SELECT *, greatest(t_click, t_view, t_error) AS newest FROM l WHERE t_click IS NOT NULL AND t_view IS NOT NULL AND t_error IS NOT NULL)
SELECT grp AS "group", arrival_seq, newest, round(click + view - error, 6) AS value FROM f WHERE newest - least(t_click, t_view, t_error) <= INTERVAL 30 SECONDS""",
    "o24_suppressed": f"""{M}, i AS (SELECT *, substr(mrid, 1, 16) AS grp, split_part(mrid, ':', 5) AS input, CASE WHEN quality_valid IS NOT TRUE THEN 'invalid_quality:' || input
  WHEN value_type <> 'double' OR double_value IS NULL THEN 'scalar_mismatch:' || input WHEN NOT isfinite(double_value) THEN 'non_finite_input:' || input
  WHEN kafka_key <> mrid THEN 'key_mismatch:' || input END AS bad FROM m WHERE split_part(mrid, ':', 5) IN ('click', 'view', 'error')),
l AS (SELECT *, {', '.join(_LAST.format(n, "CASE WHEN bad IS NULL THEN double_value END", n) + ", " + _LAST.format(n, "CASE WHEN bad IS NULL THEN received_at END", f"t_{n}") for n in ("click", "view", "error"))}
  FROM i WINDOW w AS (PARTITION BY grp ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT *, greatest(t_click, t_view, t_error) - INTERVAL 30 SECONDS AS oldest FROM l),
r AS (SELECT *, CASE WHEN bad IS NOT NULL THEN bad WHEN t_click IS NULL OR t_view IS NULL OR t_error IS NULL THEN 'incomplete_group:' || grp
  WHEN least(t_click, t_view, t_error) < oldest THEN 'stale_input:' || concat_ws(',', CASE WHEN t_click < oldest THEN 'click' END, CASE WHEN t_error < oldest THEN 'error' END, CASE WHEN t_view < oldest THEN 'view' END) END AS reason FROM s)
SELECT grp AS "group", arrival_seq, input, reason, CASE WHEN reason IS NULL THEN round(click + view - error, 6) END AS value FROM r""",
    "o25_pair_product": _latest(["view", "click"], _VALID) + """ SELECT grp AS "group", arrival_seq, round(view * click, 6) AS value FROM l WHERE view IS NOT NULL AND click IS NOT NULL""",
    "o26_membership_join": f"""{M}, {LOG}, iv AS (SELECT *, lead(arrival_seq) OVER (PARTITION BY source ORDER BY arrival_seq) AS valid_to FROM log)
SELECT m.arrival_seq, mrid, value AS member_value, iv.arrival_seq AS member_from FROM m JOIN iv ON iv.source = 'site:' || substr(mrid, 15, 2) AND m.arrival_seq >= iv.arrival_seq AND (valid_to IS NULL OR m.arrival_seq < valid_to) WHERE value IS NOT NULL""",
    "o29_reconcile_desired": """WITH d AS (SELECT 'ep/' || o_orderkey AS event, 'urn:' || o_custkey AS resource, o_orderpriority AS severity FROM orders WHERE o_orderkey % 3 = 0),
r AS (SELECT 'ep/' || o_orderkey AS event, 'urn:' || CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 1 ELSE o_custkey END AS resource FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0 AND o_orderstatus <> 'F')
SELECT event, resource, 'close' AS action, NULL AS severity FROM r WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.event = r.event AND d.resource = r.resource) UNION ALL SELECT event, resource, 'upsert', severity FROM d""",
    "o52_transitions": f"{_T} SELECT alarm_key, arrival_seq, action, episode_id, activated_at FROM t",
    "o52_exact_time": f"""{FINE}, {_rules_sql},
o AS (SELECT f.*, rule, threshold FROM f JOIN rules ON regexp_full_match(mrid, replace(pattern, '*', '[^:]+')) WHERE {_FINE_ROWS}),
n AS (SELECT *, max(ns) OVER (PARTITION BY rule, mrid ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM o),
k AS (SELECT *, double_value > threshold AS above FROM n WHERE seen IS NULL OR ns > seen),
w AS (SELECT *, coalesce(lag(above) OVER (PARTITION BY rule, mrid ORDER BY arrival_seq), false) AS was FROM k),
a AS (SELECT *, {_KEY} AS alarm_key, CASE WHEN above AND NOT was THEN 'activate' WHEN above THEN 'refresh' WHEN was THEN 'clear' ELSE 'evaluate' END AS action FROM w),
g AS (SELECT *, sum((action = 'activate')::INT) OVER (PARTITION BY rule, mrid ORDER BY arrival_seq) AS run FROM a)
SELECT alarm_key, arrival_seq, action, CASE WHEN action <> 'evaluate' THEN first_value(timestamp_mccs) OVER r END AS activated_at, CASE WHEN action <> 'evaluate' THEN first_value({_ID}) OVER r END AS episode_id
FROM g WINDOW r AS (PARTITION BY rule, mrid, run ORDER BY arrival_seq)""",
    "o55_exact_time": f"""{FINE}, q AS (SELECT * FROM f WHERE {_FINE_ROWS} AND mrid LIKE '%:error'),
n AS (SELECT *, max(ns) OVER (PARTITION BY mrid ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM q),
k AS (SELECT *, double_value > 50.2 AS above FROM n WHERE seen IS NULL OR ns > seen),
w AS (SELECT *, coalesce(lag(above) OVER (PARTITION BY mrid ORDER BY arrival_seq), false) AS was FROM k),
o AS (SELECT *, last_value(CASE WHEN above AND NOT was THEN timestamp_mccs END IGNORE NULLS) OVER (PARTITION BY mrid ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS onset FROM w)
SELECT mrid, arrival_seq, onset, timestamp_mccs AS cleared_at FROM o WHERE NOT above AND was""",
    "o53_current": f"""{_T53}, z AS (SELECT *, max(timestamp_mccs) OVER (PARTITION BY alarm_key) AS watermark FROM t QUALIFY row_number() OVER (PARTITION BY alarm_key ORDER BY arrival_seq DESC) = 1)
SELECT alarm_key, rule, mrid, episode_id, activated_at, double_value, watermark FROM z WHERE action IN ('activate', 'refresh')""",
    "o54_replay": f"{_T} SELECT rule, mrid, action, count(*) AS n, max(timestamp_mccs) AS last FROM t GROUP BY ALL",
    "o55_capture": f"""{M}, q AS (SELECT * FROM m WHERE {STRICT} AND value_type = 'double' AND isfinite(double_value) AND kafka_key = mrid AND mrid LIKE '%:error'),
n AS (SELECT *, max(timestamp_mccs) OVER (PARTITION BY mrid ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM q),
k AS (SELECT *, double_value > 50.2 AS above FROM n WHERE seen IS NULL OR timestamp_mccs > seen),
w AS (SELECT *, coalesce(lag(above) OVER (PARTITION BY mrid ORDER BY arrival_seq), false) AS was FROM k),
o AS (SELECT *, last_value(CASE WHEN above AND NOT was THEN timestamp_mccs END IGNORE NULLS) OVER (PARTITION BY mrid ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS onset FROM w)
SELECT mrid, onset, timestamp_mccs AS cleared_at, onset - INTERVAL 10 SECONDS AS started_at, timestamp_mccs + INTERVAL 10 SECONDS AS ended_at, {_CAP} AS session_id, timestamp_mccs - onset + INTERVAL 20 SECONDS > INTERVAL 24 HOURS AS dropped FROM o WHERE NOT above AND was""",
    "o56_first_notifications": f"{_T} SELECT episode_id, rule, mrid, arrival_seq FROM t WHERE action = 'activate'",
    "o62_membership_changes": f"""WITH {LOG}, p AS (SELECT *, value IS NOT NULL AS here, coalesce(lag(value IS NOT NULL) OVER (PARTITION BY source ORDER BY arrival_seq), false) AS was FROM log)
SELECT source, arrival_seq, CASE WHEN here THEN 'added' ELSE 'removed' END AS change FROM p WHERE here <> was""",
    "o63_union_events": f"{M}, {LOG} SELECT arrival_seq, mrid, double_value, NULL AS source, NULL AS value FROM m UNION ALL SELECT arrival_seq, NULL, NULL, source, value FROM log",
    "o64_alarm_key": f"""WITH p AS (SELECT p_partkey, p_name AS rule, p_brand || '?>' || CAST(p_partkey AS VARCHAR) AS mrid FROM part) SELECT p_partkey, {_KEY} AS key, rule, mrid FROM p""",
    "o65_uuid5": f"SELECT o_orderkey, {_PID} AS id FROM orders",
    "o66_canonical_uuid": f"""WITH i AS (SELECT o_orderkey, {_PID} AS id FROM orders) SELECT o_orderkey, regexp_full_match(CASE WHEN o_orderkey % 3 = 0 THEN upper(id) WHEN o_orderkey % 5 = 0 THEN id || '0' ELSE id END, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') AS ok FROM i""",
    "o67_format_evidence": "SELECT event_id, 'Frequency ' || regexp_replace(CAST(value AS VARCHAR), '\\.0$', '') || ' Hz is greater than threshold 50.1 Hz' AS summary FROM events",
    "o69_formula": f"{M} SELECT arrival_seq, 'urn:grid:site:03:view-m' AS mrid, timestamp_mccs, quality_valid, round(double_value * 1000, 6) AS double_value FROM m WHERE mrid = 'urn:grid:site:03:view' AND kafka_key = mrid AND double_value IS NOT NULL",
    "o78_processor_spec": _latest(["purchase", "signup"], _VALID)
    + """, f AS (SELECT *, greatest(t_purchase, t_signup) AS newest FROM l WHERE t_purchase IS NOT NULL AND t_signup IS NOT NULL)
SELECT grp || ':ratio' AS mrid, arrival_seq, round(purchase / signup, 6) AS double_value FROM f WHERE newest - least(t_purchase, t_signup) <= INTERVAL 20 SECONDS""",
}
