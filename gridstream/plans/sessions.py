"""Registered queries of sessions, evidence, catalogues, exports and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstream.functions import columns as C
from gridstream.operators import aggregate as A
from gridstream.operators import catalogs as K
from gridstream.operators import sessions as S
from gridstream.plans.base import BAD_REQUESTS, LOG, REQUESTS, M, uuid5
from gridstream.sources import storage
from gridstream.sources.fixtures import measurements, membership_log, read, session_requests


def _accepted(spark: SparkSession, d: str) -> DataFrame:
    """Valid requests. All are stored with their verdict: every step of a join with them reads them, and would make and
    check each anew; and a filter would have them checked where they are read, before they are dealt."""
    checked = S.validate_requests(session_requests(spark, d, 4 * spark.sparkContext.defaultParallelism))
    return storage.frozen(checked, "checked-requests").where("verdict = 'accepted'")


def _session_rows(spark: SparkSession, d: str, requests: DataFrame | None = None) -> DataFrame:
    return S.session_join(measurements(spark, d), requests or _accepted(spark, d)).withColumn("blob_id", S.blob_id())


def o3_live_store(spark: SparkSession, d: str) -> DataFrame:
    path = storage.scratch(spark, "live-store")
    storage.write_live_store(measurements(spark, d), path, max_rows=5000)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("event_hour").cast("string").alias("event_hour")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mrid").alias("signals"), F.max("arrival_seq").alias("last"))


def o5_session_artifacts(spark: SparkSession, d: str) -> DataFrame:
    path = storage.scratch(spark, "artifacts")
    back = storage.read_artifact_rows(storage.write_session_artifacts(_session_rows(spark, d), path, flat=True), ["session_id", "mrid"])
    per = back.groupBy("session_id", "path", "mrid").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("session_id").agg(F.sum("n").alias("n"), F.countDistinct("path").alias("files"), F.countDistinct("mrid").alias("signals"))


def o6_selection_csv(spark: SparkSession, d: str) -> DataFrame:
    path = storage.scratch(spark, "selection")
    storage.write_selection_csv(measurements(spark, d), path)
    back = spark.read.schema("time string, mrid string, value_type string, value double").option("header", True).csv(path)
    return back.groupBy("mrid", "value_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("time").alias("last"))


def o7_publish(spark: SparkSession, d: str) -> DataFrame:
    path = storage.scratch(spark, "change-log")
    log = membership_log(spark, d).withColumn("at", F.timestamp_seconds(F.col("arrival_seq")).cast("timestamp_ntz"))
    storage.publish_compacted(log, "source", F.col("value"), "at", path)
    return spark.read.parquet(path).groupBy("key").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("value").isNull()).alias("tombstones"), F.max("timestamp").alias("newest"))


_SRC = "concat('src-', p_partkey % 20)"


#: Columns that make signals with mistakes from ``part``; the text is the same in Spark and DuckDB.
_nth, _source = "CAST(floor(p_partkey / 200) AS INT)", "p_partkey % 200"
_SIGNALS = [
    "p_partkey", f"'src-' || CAST({_source} AS VARCHAR(9)) AS source_id",
    f"CASE WHEN {_source} % 19 = 0 THEN 'host' WHEN {_source} % 23 = 0 THEN '2001:db8::' || CAST({_source} AS VARCHAR(9)) WHEN {_source} % 29 = 0 THEN '10.0.0.260' ELSE '10.0.0.' || CAST({_source} AS VARCHAR(9)) END AS host",
    f"CASE WHEN {_source} % 31 = 0 THEN 0 WHEN {_source} % 37 = 0 AND p_partkey % 11 = 0 THEN 4713 ELSE 4712 END AS port", f"CAST({_source} * 400 AS INT) AS idcode",
    "'sig-' || CAST(CASE WHEN p_partkey % 83 = 0 THEN 0 ELSE p_partkey END AS VARCHAR(20)) AS signal_id",
    f"CASE WHEN {_nth} IN (0, 5) THEN 'FREQ' WHEN {_nth} = 1 THEN 'DFREQ' ELSE 'V' || CAST(p_partkey AS VARCHAR(20)) END AS channel",
    f"CASE WHEN p_partkey % 67 = 0 THEN 'other' WHEN {_nth} IN (0, 5) THEN 'frequency' WHEN {_nth} = 1 AND p_partkey % 5 <> 0 THEN 'rocof' ELSE 'phasor' END AS selector",
    f"CASE WHEN p_partkey % 61 = 0 THEN 'X' WHEN {_nth} IN (0, 5) THEN 'FREQ' WHEN {_nth} = 1 THEN 'DFREQ' ELSE 'V' || CAST(p_partkey AS VARCHAR(20)) END AS phasor_channel",
    "'urn:part:' || CAST(CASE WHEN p_partkey % 79 = 0 THEN 0 ELSE p_partkey END AS VARCHAR(20)) AS mrid",
    f"CASE WHEN p_partkey % 71 = 0 THEN p_type WHEN {_nth} IN (0, 5) THEN 'frequency' WHEN {_nth} = 1 THEN 'rocof' WHEN p_partkey % 2 = 0 THEN 'voltage' ELSE 'current' END AS quantity",
    f"CASE WHEN p_partkey % 73 = 0 THEN 'kV' WHEN {_nth} IN (0, 5) THEN 'Hz' WHEN {_nth} = 1 THEN 'Hz/s' WHEN p_partkey % 2 = 0 THEN 'V' ELSE 'A' END AS unit",
]


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").selectExpr(*_SIGNALS)


def o8_catalog_table(spark: SparkSession, d: str) -> DataFrame:
    nested = _catalog(spark, d).groupBy("source_id").agg(F.collect_list(F.struct("signal_id", "channel", "mrid")).alias("signals"))
    return storage.read_catalog_table(nested).select("source_id", "signal_id", "channel", "mrid", "reference")


def o27_session_join(spark: SparkSession, d: str) -> DataFrame:
    return _session_rows(spark, d).select("session_id", "mrid", "arrival_seq", "timestamp_mccs")


def o28_coverage_audit(spark: SparkSession, d: str) -> DataFrame:
    requests = _accepted(spark, d).select(S.blob_id().alias("blob_id"), "session_id", "started_at", "ended_at", "mrids")
    cover = A.session_coverage(_session_rows(spark, d, requests), requests).select(S.blob_id().alias("blob_id"), "mrid", (F.col("n") + F.when(F.col("mrid").endswith("view"), 1).otherwise(0)).alias("expected"))
    return S.coverage_audit(requests, cover, measurements(spark, d))


def o30_reconcile_catalog(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    proposed = p.where("p_partkey % 3 <> 0").selectExpr(f"{_SRC} AS source_id", "concat('sig-', p_partkey) AS signal_id", "concat('urn:part:', CASE WHEN p_partkey % 61 = 0 THEN p_partkey + 1 ELSE p_partkey END) AS mrid")
    existing = p.where("p_partkey % 2 = 0").selectExpr("concat('src-', CASE WHEN p_partkey % 11 = 0 THEN 20 + p_partkey % 5 ELSE p_partkey % 20 END) AS source_id", "concat('sig-', p_partkey) AS signal_id", "concat('urn:part:', p_partkey) AS mrid").withColumn("catalog_id", F.when(F.substring("source_id", 5, 2).cast("int") % 6 == 4, "other").otherwise("grid"))
    plan, bad = K.reconcile_catalog(proposed, existing, "grid")
    return plan.select("source_id", F.lit(None).cast("string").alias("mrid"), "action").unionByName(bad.withColumnRenamed("violation", "action"))


def o31_validate_exports(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") + 100 * (F.col("l_partkey") % 2) - F.when(F.col("l_suppkey") % 50 == 0, 500).otherwise(0)).cast("long").alias("address"), F.when(F.col("l_partkey") % 40 == 0, "single_point").otherwise("short_float").alias("kind"), F.when(F.col("l_quantity") == 50, float("nan")).otherwise(F.col("l_quantity")).alias("value"), (F.col("l_tax") == 0.08).alias("overflow")))).alias("objects")
    )
    o = read(spark, d, "orders").select("o_orderkey", C.uuid5(C.EPISODE_NAMESPACE, F.col("o_orderkey").cast("string")).alias("id"), "o_orderdate", "o_custkey")
    df = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 17 == 0, F.upper("id")).otherwise(F.col("id")).alias("export_id"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate")).alias("created_at"),
        F.when(F.col("o_orderkey") % 19 == 0, "X").otherwise("M_ME_NC_1").alias("type_id"), (F.col("o_custkey") * 50).alias("common_address"), (F.col("o_orderkey") % 40).alias("cause"), "objects",
    )
    return K.validate_exports(df).select("o_orderkey", K.joined_reasons())


def o32_validate_requests(spark: SparkSession, d: str) -> DataFrame:
    return S.validate_requests(session_requests(spark, d)).select("session_id", K.joined_reasons(), "verdict")


def o33_validate_catalog(spark: SparkSession, d: str) -> DataFrame:
    return K.validate_catalog(_catalog(spark, d)).select("p_partkey", K.joined_reasons())


LINES_A_TASK = 500_000


def _blobs(spark: SparkSession, d: str) -> DataFrame:
    table = read(spark, d, "lineitem")
    # dealt once, by order and by the number of lines: left to Spark, tasks are as few as the packed bytes of the lines allow
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // LINES_A_TASK))
    lines = table.select("l_orderkey", "l_partkey", "l_tax", "l_quantity").repartition(tasks, "l_orderkey").selectExpr("l_orderkey", "concat('urn:part:', lpad(CAST(l_partkey AS STRING), 7, '0')) AS mrid", "CASE WHEN l_tax < 0.005 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS n")
    per = lines.groupBy("l_orderkey", "mrid").agg(F.sum("n").alias("n")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("mrid", "n"))).alias("cov"))
    o = read(spark, d, "orders").repartition(tasks, "o_orderkey").join(per, F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_orderkey")
    gone = k % 3 == 2
    sid = C.uuid5(C.EPISODE_NAMESPACE, k.cast("string"))
    sha = F.sha2(k.cast("string"), 256)
    empty = F.array().cast("array<struct<mrid:string,n:bigint>>")
    coverage = F.when(gone & (k % 7 != 0), empty).otherwise(F.col("cov"))
    total = F.aggregate("coverage", F.lit(0).cast("long"), lambda a, c: a + c["n"])
    obj = F.struct(F.lit(S.BUCKET).alias("bucket"), S.object_key().alias("object_key"), F.lit(S.MEDIA_TYPE).alias("media_type"), F.when(k % 23 == 0, 1).otherwise(2).alias("version"), (k % 100).alias("byte_length"), F.col("request_sha256").alias("sha256"))
    start = F.col("o_orderdate")
    return (
        o.select("o_orderkey", sid.alias("session_id"), sha.alias("request_sha256"), coverage.alias("coverage"), F.when(gone, "REJECTED").when(k % 3 == 0, "COMPLETE").otherwise("PARTIAL").alias("status"), start.alias("started_at"), (start + F.expr("INTERVAL '1' HOUR")).alias("ended_at"), start.alias("requested_at"), F.when(k % 29 == 0, start - F.expr("INTERVAL '1' HOUR")).otherwise(start).alias("finalized_at"))
        .withColumn("mrids", F.transform("coverage", lambda c: c["mrid"]))
        .withColumn("measurement_count", total + F.when(k % 11 == 0, 1).otherwise(0))
        .withColumn("rejection_reason", F.when(gone & (k % 5 != 0), "interval").when(k % 31 == 0, "x"))
        .withColumn("metadata", F.when(k % 43 == 0, F.expr("array(named_struct('key', 'b', 'value', 'y'), named_struct('key', 'a', 'value', 'x'))")))
        .withColumn("object", F.when(~gone & (k % 13 != 0), obj))
        .withColumn("blob_id", F.when(k % 37 == 0, "other").when(k % 41 == 0, F.concat(F.lit("../"), "session_id")).when(gone, S.rejected_id()).otherwise(S.blob_id()))
    )


def o34_validate_blobmeta(spark: SparkSession, d: str) -> DataFrame:
    return S.validate_blobmeta(_blobs(spark, d)).select("o_orderkey", K.joined_reasons())


def o35_audit_derived(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    derived = p.selectExpr("concat('urn:out:', p_partkey) AS mrid", "p_type AS kind", "p_brand AS unit", "'live' AS topic", "concat('o', p_size) AS owner")
    approvals = p.where("p_partkey % 9 <> 0").selectExpr("concat('urn:out:', p_partkey) AS mrid", "CASE WHEN p_partkey % 7 = 0 THEN 'X' ELSE p_type END AS kind", "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_brand END AS unit", "'live' AS topic", "concat('o', CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END) AS owner")
    inputs = read(spark, d, "lineitem").where("l_tax < 0.005").selectExpr("concat('urn:out:', l_partkey) AS mrid")
    return K.audit_derived(derived, approvals, inputs).select("mrid", K.joined_reasons())


def o36_verify_artifacts(spark: SparkSession, d: str) -> DataFrame:
    path = storage.scratch(spark, "verify")
    requests = _accepted(spark, d)
    found = storage.frozen(_session_rows(spark, d, requests), "session-rows")
    written = storage.write_session_artifacts(found, path, flat=True)
    files = storage.file_facts(spark, written)
    rows = storage.read_artifact_rows(written, ["blob_id", "session_id", "mrid"])
    cover = A.session_coverage(found, requests).groupBy("session_id").agg(F.collect_list(F.struct("mrid", (F.col("n") + F.when(F.col("mrid").endswith("03:click"), 1).otherwise(0)).alias("n"))).alias("coverage"))
    named = F.when(F.col("session_id").startswith("0"), F.lit("another")).otherwise(F.col("session_id"))
    # what was noted at writing; the files are read to be checked
    evidence = written.drop("n").join(cover, "session_id").withColumn("blob_id", S.blob_id()).withColumn("session_id", named)
    return S.verify_artifacts(files, evidence, rows).select("blob_id", K.joined_reasons())


def _cataloged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b = _blobs(spark, d).select("blob_id", "o_orderkey", F.sha2(F.concat("session_id", "status"), 256).alias("digest"), "coverage")
    return b, b.where("o_orderkey % 4 = 0 AND blob_id <> 'other'").select("blob_id", F.when(F.col("o_orderkey") % 12 == 0, F.lit("other")).otherwise(F.col("digest")).alias("digest"))


def o37_catalog_blobmeta(spark: SparkSession, d: str) -> DataFrame:
    b, catalog = _cataloged(spark, d)
    new, coverage, conflicts = S.catalog_blobmeta(b.unionByName(b), catalog)
    count = lambda df, kind: df.groupBy("blob_id").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(kind))
    return count(new, "blob").unionByName(count(coverage, "coverage")).unionByName(count(conflicts, "conflict"))


def o38_register_artifacts(spark: SparkSession, d: str) -> DataFrame:
    b, catalog = _cataloged(spark, d)
    return S.register_artifacts(b.unionByName(b), catalog, ["digest"])


def o43_session_coverage(spark: SparkSession, d: str) -> DataFrame:
    requests = _accepted(spark, d)
    return A.session_coverage(_session_rows(spark, d, requests), requests)


def o57_session_order(spark: SparkSession, d: str) -> DataFrame:
    # numbered as the operator leaves the rows, a session in one partition
    rows = A.session_order(_session_rows(spark, d).repartition("session_id").sortWithinPartitions("arrival_seq")).withColumn("_mid", F.monotonically_increasing_id())
    place = F.row_number().over(A.Window.partitionBy("session_id").orderBy("_mid"))
    return rows.select("session_id", "_mid", "arrival_seq").withColumn("place", place.cast("long")).drop("_mid")


def o60_selection_export(spark: SparkSession, d: str) -> DataFrame:
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    mrids = [f"urn:grid:site:{k:02d}:{n}" for k in range(5) for n in ("view", "click")]
    return A.selection_export(measurements(spark, d), mrids, ["double", "int", "string"], t("2024-01-01 01:00:00"), t("2024-01-01 01:12:00"))


def o61_session_lists(spark: SparkSession, d: str) -> DataFrame:
    b = _blobs(spark, d)
    newest = S.session_list(b).select("blob_id", F.lit(None).cast("string").alias("mrid"), F.col("measurement_count").alias("n"), F.lit("list").alias("kind"))
    detail = S.session_details(b).select("blob_id", "mrid", "n", F.lit("coverage").alias("kind"))
    return newest.unionByName(detail)


def o68_selection_filename(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("urn:/part "), F.col("l_partkey").cast("string"), F.lit("::"), F.col("l_shipdate").cast("date").cast("string")))).alias("mrids"))
    return lines.select("l_orderkey", C.selection_filename(F.col("mrids"), F.col("l_orderkey") * 86_399_123).alias("filename"))


QUERIES = {f.__name__: f for f in (
    o3_live_store, o5_session_artifacts, o6_selection_csv, o7_publish, o8_catalog_table, o27_session_join, o28_coverage_audit, o30_reconcile_catalog,
    o31_validate_exports, o32_validate_requests, o33_validate_catalog, o34_validate_blobmeta, o35_audit_derived, o36_verify_artifacts, o37_catalog_blobmeta,
    o38_register_artifacts, o43_session_coverage, o57_session_order, o60_selection_export, o61_session_lists, o68_selection_filename,
)}


def _why(**checks: str) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks.items()) + ") AS reasons"


_CHECK = _why(
    empty_interval="started_at >= ended_at", interval_too_long="ended_at - started_at > INTERVAL 24 HOURS", mrids_unsorted="list_sort(list_distinct(mrids)) <> mrids",
    metadata_unsorted="fault = 13", metadata_key="fault = 17", metadata_value="fault = 19",
)
_R = f"{M}, {REQUESTS}, ok AS (SELECT * FROM requests WHERE fault NOT IN {BAD_REQUESTS}), w AS (SELECT session_id, started_at, ended_at, unnest(mrids) AS mrid FROM ok), s AS (SELECT w.session_id, m.* FROM w JOIN m ON m.mrid = w.mrid AND timestamp_mccs >= started_at AND timestamp_mccs < ended_at), c AS (SELECT session_id, mrid, (SELECT count(*) FROM s WHERE s.session_id = w.session_id AND s.mrid = w.mrid) AS n, started_at, ended_at FROM w)"
_OID = uuid5("f5d55f94-655f-5460-a315-f56a8a891007", "CAST(o_orderkey AS VARCHAR)")
_CAT = f"c AS (SELECT {', '.join(_SIGNALS)} FROM part)"
_B = f"""WITH l0 AS (SELECT l_orderkey, 'urn:part:' || lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS mrid, sum(CASE WHEN l_tax < 0.005 THEN 0 ELSE CAST(l_quantity AS BIGINT) END)::BIGINT AS n FROM lineitem GROUP BY ALL),
l AS (SELECT l_orderkey, sum(n)::BIGINT AS total, min(n) AS least, count(*) AS mrids FROM l0 GROUP BY ALL),
b0 AS (SELECT o_orderkey, o_orderkey % 3 = 2 AS gone, {_OID} AS session_id, sha256(CAST(o_orderkey AS VARCHAR)) AS sha, l.*, o_orderdate FROM orders JOIN l ON l_orderkey = o_orderkey),
b AS (SELECT *, CASE WHEN gone THEN 'REJECTED' WHEN o_orderkey % 3 = 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS status, gone AND o_orderkey % 7 <> 0 AS empty, CASE WHEN gone AND o_orderkey % 7 <> 0 THEN 0 ELSE total END + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS measurement_count,
  CASE WHEN o_orderkey % 37 = 0 THEN 'other' WHEN o_orderkey % 41 = 0 THEN '../' || session_id WHEN gone THEN 'rejections/' || session_id || '/' || sha ELSE 'sessions/' || session_id || '/measurements' END AS blob_id FROM b0)"""
_P = f"{_B}, e AS (SELECT blob_id, o_orderkey, sha256(session_id || status) AS digest, CASE WHEN empty THEN 0 ELSE mrids END AS mrids FROM b), k AS (SELECT *, o_orderkey % 4 = 0 AS known, o_orderkey % 12 = 0 AS clash FROM e WHERE blob_id <> 'other'), x AS (SELECT blob_id, min(digest) AS digest FROM e WHERE blob_id = 'other' GROUP BY blob_id)"

ORACLES = {
    "o3_live_store": f"{M} SELECT strftime(timestamp_mccs, '%Y-%m-%d-%H') AS event_hour, count(*) AS n, count(DISTINCT mrid) AS signals, max(arrival_seq) AS last FROM m GROUP BY ALL",
    "o5_session_artifacts": f"{_R} SELECT session_id, count(*) AS n, 1 AS files, count(DISTINCT mrid) AS signals FROM s GROUP BY session_id",
    "o6_selection_csv": f"{M} SELECT mrid, value_type, count(*) AS n, round(sum(coalesce(double_value, int_value)), 4) AS total, max(strftime(timestamp_mccs, '%Y-%m-%dT%H:%M:%S.%g') || 'Z') AS last FROM m GROUP BY ALL",
    "o7_publish": f"WITH {LOG} SELECT source AS key, count(*) AS records, count(*) FILTER (WHERE value IS NULL) AS tombstones, make_timestamp(max(arrival_seq) * 1000000) AS newest FROM log GROUP BY source",
    "o8_catalog_table": f"WITH {_CAT} SELECT source_id, signal_id, channel, mrid, source_id || '.' || signal_id AS reference FROM c",
    "o27_session_join": f"{_R} SELECT session_id, mrid, arrival_seq, timestamp_mccs FROM s",
    "o28_coverage_audit": f"{_R} SELECT 'sessions/' || session_id || '/measurements' AS blob_id, mrid, n + (mrid LIKE '%view')::INT AS expected, n AS actual, NOT mrid LIKE '%view' AS matches FROM c",
    "o30_reconcile_catalog": """WITH p AS (SELECT 'src-' || (p_partkey % 20) AS s, 'sig-' || p_partkey AS g, 'urn:part:' || CASE WHEN p_partkey % 61 = 0 THEN p_partkey + 1 ELSE p_partkey END AS mrid FROM part WHERE p_partkey % 3 <> 0),
e0 AS (SELECT CASE WHEN p_partkey % 11 = 0 THEN 20 + p_partkey % 5 ELSE p_partkey % 20 END AS n, 'sig-' || p_partkey AS g, 'urn:part:' || p_partkey AS mrid FROM part WHERE p_partkey % 2 = 0),
e AS (SELECT 'src-' || n AS s, g, mrid, CASE WHEN n % 6 = 4 THEN 'other' ELSE 'grid' END AS cat FROM e0)
SELECT DISTINCT s AS source_id, NULL AS mrid, 'upsert' AS action FROM p
UNION ALL SELECT DISTINCT s, NULL, 'tombstone' FROM e WHERE cat = 'grid' AND s NOT IN (SELECT s FROM p)
UNION ALL SELECT DISTINCT s, NULL, 'foreign_source' FROM e WHERE cat <> 'grid' AND s IN (SELECT s FROM p)
UNION ALL SELECT DISTINCT p.s, p.mrid, 'mrid_changed' FROM p JOIN e ON p.s = e.s AND p.g = e.g WHERE p.mrid <> e.mrid
UNION ALL SELECT DISTINCT p.s, p.mrid, CASE WHEN p.s <> e.s THEN 'mrid_owned_elsewhere' ELSE 'mrid_moved' END FROM p JOIN e ON p.mrid = e.mrid WHERE p.s <> e.s OR p.g <> e.g""",
    "o31_validate_exports": f"""WITH x AS (SELECT l_orderkey, l_linenumber + 100 * (l_partkey % 2) - CASE WHEN l_suppkey % 50 = 0 THEN 500 ELSE 0 END AS address, l_partkey % 40 = 0 AS single, l_quantity = 50 AS nan, l_tax = 0.08 AS overflow FROM lineitem),
l AS (SELECT l_orderkey, count(*) AS n, bool_or(address NOT BETWEEN 1 AND 16777215) AS bad_address, count(DISTINCT address) < count(*) AS again, bool_or(single) AS some_single, bool_or(NOT single AND nan) AS some_nan, bool_or(single AND overflow) AS some_overflow,
  max(address) - min(address) = count(*) - 1 AND count(DISTINCT address) = count(*) AS run FROM x GROUP BY ALL),
o AS (SELECT o_orderkey, o_orderkey % 17 = 0 AND upper({_OID}) <> {_OID} AS bad_id, o_orderkey % 13 = 0 AS no_time, o_orderkey % 19 = 0 AS bad_type, o_custkey * 50 AS ca, o_orderkey % 40 AS cause, coalesce(n, 0) AS n, l.* EXCLUDE (n, l_orderkey) FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, {_why(bad_id="bad_id", bad_time="no_time", bad_type="bad_type", common_address="ca NOT BETWEEN 1 AND 65535", cause="cause NOT BETWEEN 1 AND 5 AND cause NOT BETWEEN 20 AND 36", object_count="n NOT BETWEEN 1 AND 127", address="bad_address", repeated_address="again", value_kind="n > 0 AND (bad_type OR some_single)", not_finite="some_nan", overflow="some_overflow", too_long="n > 0 AND 6 + CASE WHEN run THEN 3 ELSE 3 * n END + CASE WHEN bad_type THEN 1 ELSE 5 END * n > 249")} FROM o""",
    "o32_validate_requests": f"WITH {REQUESTS} SELECT session_id, {_CHECK}, CASE WHEN started_at >= ended_at THEN 'quarantine' WHEN fault IN (7, 11, 13, 17, 19) THEN 'rejected' ELSE 'accepted' END AS verdict FROM requests",
    "o33_validate_catalog": f"""WITH {_CAT}, k0 AS (SELECT *, host || '/' || port || '/' || idcode AS spot FROM c),
k AS (SELECT *, min(spot) OVER (PARTITION BY source_id) <> max(spot) OVER (PARTITION BY source_id) AS several, count(*) OVER (PARTITION BY source_id, signal_id) AS ns, count(*) OVER (PARTITION BY source_id, channel) AS nc, count(*) OVER (PARTITION BY mrid) AS nm,
  CASE quantity WHEN 'frequency' THEN 'Hz' WHEN 'rocof' THEN 'Hz/s' WHEN 'voltage' THEN 'V' WHEN 'current' THEN 'A' END AS want FROM k0)
SELECT p_partkey, {_why(repeated_source="several", repeated_signal="ns > 1", repeated_channel="nc > 1", repeated_mrid="nm > 1", bad_host="host IN ('host', '10.0.0.260')", bad_port="port = 0", bad_idcode="idcode NOT BETWEEN 1 AND 65535", unknown_quantity="want IS NULL", wrong_unit="unit <> want", selector="CASE selector WHEN 'frequency' THEN channel <> 'FREQ' WHEN 'rocof' THEN channel <> 'DFREQ' WHEN 'phasor' THEN phasor_channel <> channel ELSE true END", selected_quantity="want IS NOT NULL AND NOT CASE selector WHEN 'phasor' THEN quantity IN ('voltage', 'current') ELSE quantity = selector END")} FROM k""",
    "o34_validate_blobmeta": f"""{_B} SELECT o_orderkey, {_why(finalized_early="o_orderkey % 29 = 0", mrids="NOT gone AND mrids > 32", count_sum="NOT gone AND o_orderkey % 11 = 0", reason_on_result="NOT gone AND o_orderkey % 31 = 0", no_object="NOT gone AND o_orderkey % 13 = 0", bad_object="NOT gone AND o_orderkey % 13 <> 0 AND (o_orderkey % 23 = 0 OR o_orderkey % 100 = 0)", bad_blob_id="o_orderkey % 37 = 0 OR o_orderkey % 41 = 0", unsafe_blob_id="o_orderkey % 37 <> 0 AND o_orderkey % 41 = 0", complete_with_gap="status = 'COMPLETE' AND least = 0", partial_without_gap="status = 'PARTIAL' AND least <> 0", coverage_on_rejection="gone AND (NOT empty OR o_orderkey % 11 = 0)", reason_length="gone AND o_orderkey % 5 = 0 AND o_orderkey % 31 <> 0", metadata_unsorted="o_orderkey % 43 = 0")} FROM b""",
    "o35_audit_derived": f"""WITH u AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_tax < 0.005) SELECT 'urn:out:' || p_partkey AS mrid, {_why(not_approved="p_partkey % 9 = 0", kind="p_partkey % 9 <> 0 AND p_partkey % 7 = 0", unit="p_partkey % 9 <> 0 AND p_partkey % 5 = 0", owner="p_partkey % 9 <> 0 AND p_partkey % 4 = 0 AND p_size <> 0", input_as_output="l_partkey IS NOT NULL")} FROM part LEFT JOIN u ON l_partkey = p_partkey""",
    "o36_verify_artifacts": f"{_R} SELECT 'sessions/' || session_id || '/measurements' AS blob_id, {_why(counts="bool_or(mrid LIKE '%03:click')", identity="session_id LIKE '0%'")} FROM c GROUP BY session_id HAVING sum(n) > 0",
    "o37_catalog_blobmeta": f"{_P} SELECT blob_id, 1 AS n, 'blob' AS kind FROM k WHERE NOT known UNION ALL SELECT blob_id, mrids, 'coverage' FROM k WHERE NOT known AND mrids > 0 UNION ALL SELECT blob_id, 1, 'conflict' FROM k WHERE clash UNION ALL SELECT blob_id, 1, 'conflict' FROM x",
    "o38_register_artifacts": f"{_P} SELECT blob_id, digest, CASE WHEN clash THEN 'conflict' WHEN known THEN 'replay' ELSE 'register' END AS outcome FROM k UNION ALL SELECT blob_id, digest, 'conflict' FROM x",
    "o43_session_coverage": f"{_R} SELECT session_id, mrid, n, sum(n) OVER (PARTITION BY session_id)::BIGINT AS total, CASE WHEN min(n) OVER (PARTITION BY session_id) > 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS status FROM c",
    "o57_session_order": f"{_R} SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY timestamp_mccs, mrid, value_type, coalesce(CAST(double_value AS VARCHAR), CAST(int_value AS VARCHAR)), timestamp_field, arrival_seq) AS place, arrival_seq FROM s",
    "o60_selection_export": f"{M} SELECT timestamp_mccs AS time, mrid, value_type, coalesce(double_value, CAST(int_value AS DOUBLE)) AS value FROM m WHERE regexp_full_match(mrid, 'urn:grid:site:0[0-4]:(view|click)') AND timestamp_mccs BETWEEN TIMESTAMP '2024-01-01 01:00:00' AND TIMESTAMP '2024-01-01 01:12:00'",
    "o61_session_lists": f"""{_B}, g AS (SELECT *, CASE WHEN o_orderkey % 29 = 0 THEN o_orderdate - INTERVAL 1 HOUR ELSE o_orderdate END AS f FROM b WHERE NOT gone)
SELECT * FROM (SELECT blob_id, NULL AS mrid, measurement_count AS n, 'list' AS kind FROM g ORDER BY f DESC, blob_id LIMIT 100) UNION ALL SELECT blob_id, l0.mrid, l0.n, 'coverage' FROM g JOIN l0 ON l0.l_orderkey = o_orderkey""",
    "o68_selection_filename": """WITH l AS (SELECT l_orderkey, list_sort(list(DISTINCT 'urn:/part ' || l_partkey || '::' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR))) AS ms FROM lineitem GROUP BY ALL),
n AS (SELECT *, 'measurement-session-' || strftime(make_timestamp(l_orderkey * 86399123 // 1000 * 1000000), '%Y-%m-%dT%H-%M-%SZ') || '-' AS prefix, array_to_string(list_transform(ms, lambda x: regexp_replace(x, '[^A-Za-z0-9\\-_.]+', '-', 'g')), '--') AS labels FROM l),
k AS (SELECT *, '-selection-' || len(ms) || '-' || substr(sha256(array_to_string(ms, chr(0))), 1, 12) AS mark FROM n)
SELECT l_orderkey, prefix || CASE WHEN length(labels) > 240 - length(prefix) THEN regexp_replace(substr(labels, 1, 240 - length(prefix) - length(mark)), '-+$', '') || mark ELSE labels END || '.csv' AS filename FROM k""",
}
