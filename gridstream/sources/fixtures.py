"""Views of the given tables in the shapes of the measurement platform."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

START = "2024-01-01 01:00:00"
START_SECOND = 1_704_070_800


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _at(ms: str) -> str:
    return f"TIMESTAMP_NTZ '{START}' + make_dt_interval(0, 0, 0, CAST(({ms}) / 1000 AS DECIMAL(18, 6)))"


STEP = "event_id * 125"  # milliseconds between two rows
_mccs = "event_id * 125 - CASE WHEN event_id % 11 = 0 THEN 60000 ELSE 0 END"
_field = "event_id * 125 - 20 - CASE WHEN event_id % 11 = 0 THEN 2500 ELSE 0 END"
_mrid = "concat('urn:grid:site:', lpad(CAST(user_id % 20 AS STRING), 2, '0'), ':', event_type)"


def measurements(spark: SparkSession, sf_dir: str, step_ms: int = 125) -> DataFrame:
    """Measurements from ``events``: 100 signals, a row every ``step_ms``, every 11th a minute late."""
    columns = [
        f"{_mrid} AS mrid",
        f"CASE WHEN event_id % 29 = 0 THEN 'wrong' ELSE {_mrid} END AS kafka_key",
        "'live' AS topic", "0 AS partition", "event_id AS offset",
        f"{_at('event_id * 125')} AS kafka_ts", "event_id AS arrival_seq",
        f"{_at(_mccs)} AS timestamp_mccs",
        f"{START_SECOND} + CAST(floor(({_mccs}) / 1000) AS BIGINT) AS mccs_sec",
        f"CAST(pmod({_mccs}, 1000) * 1000000 AS INT) AS mccs_nanos",
        f"{_at(_field)} AS timestamp_field",
        "CAST(NULL AS TIMESTAMP_NTZ) AS timestamp_gateway",
        f"{_at('event_id * 125')} AS received_at",
        "CASE WHEN event_id % 19 = 0 THEN 'int' ELSE 'double' END AS value_type",
        "CASE WHEN event_id % 19 = 0 THEN NULL ELSE value END AS double_value",
        "CASE WHEN event_id % 19 = 0 THEN CAST(floor(value) AS BIGINT) END AS int_value",
        "CAST(NULL AS BIGINT) AS uint_value", "CAST(NULL AS BOOLEAN) AS bool_value", "CAST(NULL AS STRING) AS string_value",
        "CAST(NULL AS TIMESTAMP_NTZ) AS timestamp_value",
        "CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 7 = 0 THEN false ELSE true END AS quality_valid",
        "CASE WHEN event_id % 17 = 0 THEN true END AS quality_substituted",
        "CAST(NULL AS BOOLEAN) AS quality_operator_blocked", "CAST(NULL AS BOOLEAN) AS quality_overflow",
        "CASE WHEN event_id % 23 = 0 THEN true WHEN event_id % 5 = 0 THEN false END AS quality_old_data",
    ]
    return read(spark, sf_dir, "events").selectExpr(*[c.replace(STEP, f"event_id * {step_ms}") for c in columns])


def fine_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements of which 400 at a time have one timestamp, and differ in their nanoseconds alone, out of order."""
    second = _at("floor(arrival_seq / 400) * 1000")
    return measurements(spark, sf_dir).selectExpr("* EXCEPT (timestamp_mccs, received_at, mccs_sec, mccs_nanos)", f"{second} AS timestamp_mccs", f"{second} AS received_at",
        f"{START_SECOND} + CAST(floor(arrival_seq / 400) AS BIGINT) AS mccs_sec", "CAST(arrival_seq * 37 % 1000 AS INT) AS mccs_nanos")


def membership_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log of sources from ``orders``: source, value (null: removed), arrival_seq."""
    return read(spark, sf_dir, "orders").selectExpr(
        "concat('site:', lpad(CAST(o_custkey % 20 AS STRING), 2, '0')) AS source",
        "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS value",
        "o_orderkey AS arrival_seq", "CAST(0 AS INT) AS partition",
    )


def session_requests(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """A request for each customer, spread over the whole time of the measurements;
    some partial, some to reject, some to quarantine. They are dealt to ``tasks`` tasks, if given:
    a file of a few MB is read by one or two, and has a million requests to make."""
    site = "concat('urn:grid:site:', lpad(CAST(c_custkey % 20 AS STRING), 2, '0'), ':')"
    entry = lambda k, v: f"named_struct('key', '{k}', 'value', '{v}')"
    customers = read(spark, sf_dir, "customer").select("c_custkey")
    return (customers.repartition(tasks, "c_custkey") if tasks else customers).selectExpr(
        "c_custkey AS k",
        f"{_at('c_custkey * 833')} AS started_at",
        f"{_at('c_custkey * 833 + 60000 * CASE c_custkey % 97 WHEN 7 THEN 1500 WHEN 9 THEN 0 ELSE 1 + c_custkey % 4 END')} AS ended_at",
        f"{_at('c_custkey * 833 + 864000000')} AS requested_at",
        f"""CASE WHEN c_custkey % 97 = 11 THEN array(concat({site}, 'view'), concat({site}, 'click'))
                 WHEN c_custkey % 3 = 0 THEN array(concat({site}, 'absent'), concat({site}, 'click'), concat({site}, 'view'))
                 ELSE array(concat({site}, 'click'), concat({site}, 'view')) END AS mrids""",
        f"""CASE c_custkey % 97 WHEN 13 THEN array({entry('b', 'y')}, {entry('a', 'x')}) WHEN 17 THEN array({entry('9 bad', 'x')}) WHEN 19 THEN array({entry('a', '')})
                 ELSE array({entry('a', 'x')}, {entry('b.c-d', 'y')}) END AS metadata""",
    ).withColumn("session_id", _session_id())


def _session_id() -> F.Column:
    from gridstream.functions.columns import SESSION_NAMESPACE, uuid5

    return uuid5(SESSION_NAMESPACE, F.col("k").cast("string"))


def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters (per supplier and return flag, reset each year) and gauges from ``lineitem``."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS flag", "l_suppkey AS instance", "l_shipdate AS ts", "l_orderkey", "l_linenumber",
        "l_quantity AS quantity", "l_tax AS used", "l_discount AS idle",
    )
