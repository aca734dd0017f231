"""DuckDB texts of the fixture views; every registered query's SQL begins with them."""

MRID = "'urn:grid:site:' || lpad(CAST(user_id % 20 AS VARCHAR), 2, '0') || ':' || event_type"


def at(ms: str) -> str:
    return f"TIMESTAMP '2024-01-01 01:00:00' + to_milliseconds({ms})"


MCCS = "event_id * 125 - CASE WHEN event_id % 11 = 0 THEN 60000 ELSE 0 END"
FIELD = "event_id * 125 - 20 - CASE WHEN event_id % 11 = 0 THEN 2500 ELSE 0 END"

M = f"""WITH m AS (
  SELECT {MRID} AS mrid, CASE WHEN event_id % 29 = 0 THEN 'wrong' ELSE {MRID} END AS kafka_key,
         'live' AS topic, 0 AS partition, event_id AS "offset", {at('event_id * 125')} AS kafka_ts, event_id AS arrival_seq,
         {at(MCCS)} AS timestamp_mccs, {at(FIELD)} AS timestamp_field, CAST(NULL AS TIMESTAMP) AS timestamp_gateway,
         {at('event_id * 125')} AS received_at,
         CASE WHEN event_id % 19 = 0 THEN 'int' ELSE 'double' END AS value_type,
         CASE WHEN event_id % 19 = 0 THEN NULL ELSE value END AS double_value,
         CASE WHEN event_id % 19 = 0 THEN CAST(floor(value) AS BIGINT) END AS int_value,
         CAST(NULL AS BIGINT) AS uint_value,
         CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 7 = 0 THEN false ELSE true END AS quality_valid,
         CASE WHEN event_id % 17 = 0 THEN true END AS quality_substituted,
         CAST(NULL AS BOOLEAN) AS quality_operator_blocked, CAST(NULL AS BOOLEAN) AS quality_overflow,
         CASE WHEN event_id % 23 = 0 THEN true WHEN event_id % 5 = 0 THEN false END AS quality_old_data
  FROM events
)"""

#: Rows of one microsecond that differ in nanoseconds; ``ns`` orders them.
FINE = f"""{M}, f AS (SELECT * REPLACE ({at('arrival_seq // 400 * 1000')} AS timestamp_mccs, {at('arrival_seq // 400 * 1000')} AS received_at),
  arrival_seq // 400 * 1000000000 + arrival_seq * 37 % 1000 AS ns FROM m)"""

DENSE = M.replace("event_id * 125", "event_id * 5")  # 200 rows a second

STRICT = (
    "quality_valid IS TRUE AND quality_substituted IS NOT TRUE AND quality_operator_blocked IS NOT TRUE "
    "AND quality_overflow IS NOT TRUE AND quality_old_data IS NOT TRUE"
)

LOG = """log AS (
  SELECT 'site:' || lpad(CAST(o_custkey % 20 AS VARCHAR), 2, '0') AS source,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS value, o_orderkey AS arrival_seq, 0 AS partition
  FROM orders
)"""


def uuid5(namespace: str, name: str) -> str:
    """DuckDB expression of a version 5 UUID."""
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    variant = f"substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr({h}, 17, 1)), 1)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


SITE = "'urn:grid:site:' || lpad(CAST(c_custkey % 20 AS VARCHAR), 2, '0') || ':'"
BAD_REQUESTS = "(7, 9, 11, 13, 17, 19)"  # of c_custkey % 97
REQUESTS = f"""requests AS (
  SELECT c_custkey AS k, c_custkey % 97 AS fault, {uuid5('8f3c89c2-0b2f-5a40-b6ed-7e22a1b24f63', 'CAST(c_custkey AS VARCHAR)')} AS session_id,
         {at('c_custkey * 833')} AS started_at,
         {at('c_custkey * 833 + 60000 * CASE c_custkey % 97 WHEN 7 THEN 1500 WHEN 9 THEN 0 ELSE 1 + c_custkey % 4 END')} AS ended_at,
         {at('c_custkey * 833 + 864000000')} AS requested_at,
         CASE WHEN c_custkey % 97 = 11 THEN [{SITE} || 'view', {SITE} || 'click']
              WHEN c_custkey % 3 = 0 THEN [{SITE} || 'absent', {SITE} || 'click', {SITE} || 'view']
              ELSE [{SITE} || 'click', {SITE} || 'view'] END AS mrids
  FROM customer
)"""
