"""Boundary values, lateness and restarts on small tables."""

from __future__ import annotations

import datetime as dt
import random
import uuid

import pytest
from pyspark.sql import functions as F

from gridstream.operators import sessions as request_checks
from gridstream.functions import columns as C
from gridstream.operators import aggregate, alarms, catalogs, lfr, qualify, sessions
from gridstream.schema import MEASUREMENTS
from gridstream.spec import ProcessorSpec

T0 = dt.datetime(2024, 1, 1, 1)


def measures(spark, rows):
    """rows: (mrid, second, value) and overrides, in arrival order."""
    names = MEASUREMENTS.fieldNames()
    out = []
    for k, (mrid, second, value, *more) in enumerate(rows):
        at = T0 + dt.timedelta(seconds=second)
        r = dict.fromkeys(names) | {
            "mrid": mrid, "kafka_key": mrid, "topic": "live", "partition": 0, "offset": k, "arrival_seq": k, "kafka_ts": at, "received_at": at, "timestamp_mccs": at,
            "timestamp_field": at, "value_type": "double", "double_value": None if value is None else float(value), "quality_valid": True,
        }
        r |= more[0] if more else {}
        out.append(tuple(r[n] for n in names))
    return spark.createDataFrame(out, MEASUREMENTS)


def rule(spark, threshold=50.1):
    return spark.createDataFrame([("r", "urn:*:f", threshold, "warning")], "rule string, glob string, threshold double, severity string")


def test_alarm_transitions(spark):
    rows = measures(spark, [("urn:a:f", 0, 50.1), ("urn:a:f", 1, 50.2), ("urn:a:f", 1, 60), ("urn:a:f", 2, 50.3), ("urn:a:f", 3, 50.1), ("urn:a:f", 2.5, 70), ("urn:a:f", 4, 51), ("urn:a:b:f", 5, 99), ("urn:a:f", 6, 99, {"quality_old_data": True})])
    out = alarms.alarm_transitions(alarms.alarm_observations(rows, rule(spark))).orderBy("arrival_seq").collect()
    assert [(r.arrival_seq, r.action) for r in out] == [(0, "evaluate"), (1, "activate"), (3, "refresh"), (4, "clear"), (6, "activate")]
    assert out[1].episode_id == out[2].episode_id == out[3].episode_id != out[4].episode_id
    assert out[1].summary == "Frequency 50.2 Hz is greater than threshold 50.1 Hz"
    key = out[1].alarm_key
    assert out[1].episode_id == str(uuid.uuid5(uuid.UUID(C.EPISODE_NAMESPACE), f'["{key}","live","0","1"]'))
    assert [r.action for r in alarms.alarm_transitions(alarms.alarm_observations(rows, rule(spark, 50.3)), compare="ge").orderBy("arrival_seq").collect()] == ["evaluate", "evaluate", "activate", "clear", "activate"]


def test_removal_clears_and_keeps_the_watermark(spark):
    rows = measures(spark, [("urn:a:f", 0, 60), ("urn:x:f", 0, 1), ("urn:a:f", 0, 70), ("urn:a:f", 1, 70)])
    gone = spark.createDataFrame([("r", "urn:a:f", 1)], "rule string, mrid string, arrival_seq long")
    out = alarms.alarm_transitions(alarms.alarm_observations(rows, rule(spark)), gone).where("mrid = 'urn:a:f'").orderBy("arrival_seq").collect()
    assert [(r.arrival_seq, r.action) for r in out] == [(0, "activate"), (1, "clear"), (3, "activate")]


def test_capture_bounds(spark):
    policies = spark.createDataFrame([("m", 50.2, ["m", "n"])], "mrid string, threshold double, mrids array<string>")
    rows = measures(spark, [("m", 100, 50.2), ("m", 101, 50.2001), ("m", 102, 50.2), ("m", 103, 51), ("m", 90000, 50), ("m", 90001, 60), ("m", 90002, float("inf"))])
    out = alarms.capture_episodes(rows, policies).orderBy("onset").collect()
    assert [(r.started_at, r.ended_at, r.dropped) for r in out] == [(T0 + dt.timedelta(seconds=91), T0 + dt.timedelta(seconds=112), False), (T0 + dt.timedelta(seconds=93), T0 + dt.timedelta(seconds=90010), True)]


def test_second_means(spark):
    mapping = spark.createDataFrame([("m", 1, 2)], "mrid string, common_address int, object_address int")
    rows = measures(spark, [("m", 0.1, 1), ("m", 0.9, 2, {"quality_overflow": True}), ("m", 1.5, 5), ("m", 0.5, 100), ("m", 2.0, 7), ("m", 3.0, -0.0)])
    out = aggregate.second_mean_export(rows, mapping).orderBy("second").collect()
    assert [(r["mean"], r.n, r.quality_overflow) for r in out] == [(1.5, 2, True), (5.0, 1, False), (7.0, 1, False)]


def test_preferred_frequency_ties(spark):
    s = lfr.Settings(nominal_frequency=50.0)
    cells = spark.createDataFrame([(1, 2, 49.9), (1, 2, 50.2), (1, 1, 44.0), (2, 2, 49.9), (2, 2, 50.1), (3, 1, 47.0), (3, 1, 48.0), (3, 1, 49.0), (4, 0, 50.0)], "second long, quality int, mean_frequency double")
    pick = {r.second: r.frequency for r in lfr.preferred_frequency(cells, s).collect()}
    assert pick == {1: 50.2, 2: 49.9, 3: 48.0}
    assert lfr.preferred_frequency(cells, lfr.Settings(tie="higher")).where("second = 2").first().frequency == 50.1


def test_late_and_future_rows(spark):
    units = spark.createDataFrame([("p", "f", "v")], "pmu string, frequency_mrid string, voltage_mrid string")
    at = lambda s: {"received_at": T0 + dt.timedelta(seconds=s)}
    rows = measures(spark, [("f", 0, 50, at(0.1)), ("f", 0, 50, at(1.5)), ("f", 0, 50, at(1.6)), ("f", 3, 50, at(1)), ("f", 0, 52, at(0.2) | {"quality_valid": False, "quality_overflow": True}), ("f", 0, 50, {"timestamp_field": None})])
    s = lfr.Settings(low=45, high=51)
    got = [(r.refused, list(r.reasons)) for r in lfr.accepted_inputs(rows, units, s).orderBy("arrival_seq").collect()]
    assert got == [(None, []), (None, []), ("late_after_close", []), ("future_timestamp", []), (None, ["invalid_status", "out_of_band", "overflow"]), ("missing_timestamp", [])]


def test_batch_equals_state_machine_for_any_partitioning(spark):
    from gridstream.streaming import machines

    rng = random.Random(3)
    rows = [("urn:%d:f" % rng.randrange(3), rng.randrange(40) / 2, rng.choice([49, 50.1, 50.2, 51])) for _ in range(300)]
    df = measures(spark, rows)
    want = alarms.alarm_transitions(alarms.alarm_observations(df, rule(spark)))
    again = alarms.alarm_transitions(alarms.alarm_observations(df.repartition(7, "double_value"), rule(spark)))
    key = lambda d: sorted((r.mrid, r.arrival_seq, r.action, r.episode_id or "") for r in d.collect())
    states, plain = {}, []
    keys = {r.mrid: r.alarm_key for r in want.select("mrid", "alarm_key").distinct().collect()}
    for k, (mrid, second, value) in enumerate(rows):
        row = type("R", (), dict(gone=False, mccs_us=int(second * 1e6), double_value=value, threshold=50.1, alarm_key=keys[mrid], topic="live", partition=0, offset=k, arrival_seq=k))
        plain += machines.alarm_step(states.setdefault(mrid, {}), row, ("r", mrid))
    assert key(want) == key(again) == sorted((x["mrid"], x["arrival_seq"], x["action"], x["episode_id"] or "") for x in plain)


def test_streams_go_on_over_batches(spark, tmp_path):
    from gridstream.streaming import jobs

    rng = random.Random(5)
    rows = [("urn:%d:f" % rng.randrange(4), k / 3, rng.choice([49, 50.1, 50.2, 51])) for k in range(120)]
    whole = measures(spark, rows)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    mapping = whole.select("mrid").distinct().withColumn("common_address", F.lit(1))
    schema = whole.schema
    for k in range(3):
        whole.where(f"arrival_seq >= {40 * k} AND arrival_seq < {40 * k + 40}").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.run_to_end(jobs.stream_alarm(stream, rule(spark)), f"{out}/alarm")
        jobs.run_to_end(jobs.stream_export(stream, mapping), f"{out}/export")
    want = {(r.mrid, r.arrival_seq, r.action, r.episode_id) for r in alarms.alarm_transitions(alarms.alarm_observations(whole, rule(spark))).collect()}
    assert {(r.mrid, r.arrival_seq, r.action, r.episode_id) for r in spark.read.parquet(f"{out}/alarm").collect()} == want
    means = {(r.mrid, r["mean"]) for r in aggregate.second_mean_export(whole, mapping).collect()}
    assert {(r.mrid, r["mean"]) for r in spark.read.parquet(f"{out}/export").collect()} == means


def test_alarm_state_is_restored(spark, tmp_path):
    from gridstream.streaming import jobs

    rows = measures(spark, [("urn:a:f", 0, 60), ("urn:a:f", 1, 61)])
    current = alarms.alarm_current(alarms.alarm_transitions(alarms.alarm_observations(rows.where("arrival_seq = 0"), rule(spark))))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    jobs.run_to_end(jobs.stream_alarm(stream, rule(spark), jobs.alarm_states(current)), f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r.arrival_seq, r.action, r.episode_id) for r in out] == [(1, "refresh", current.first().episode_id)]


def test_eviction_of_stale_inputs():
    from gridstream.streaming.machines import latest_step

    row = lambda i, t, v=1.0: type("R", (), dict(input=i, clock_us=t, double_value=v, names="a,b", max_age_us=5, arrival_seq=t))
    state = {}
    assert latest_step(state, row("a", 0), ("g",)) == []
    assert latest_step(state, row("b", 10), ("g",)) == [] and "a" not in state
    assert latest_step(state, row("a", 6), ("g",))[0]["newest_us"] == 10


def test_processor_spec_rules(spark):
    with pytest.raises(ValueError):
        ProcessorSpec("latest-values", {"g": {"a": "m"}}, {"g": "o"}, F.col("a"), 1.0)
    with pytest.raises(ValueError):
        ProcessorSpec.formula("m", "m", F.col("double_value"))
    rows = measures(spark, [("m", 0, 2), ("m", 1, 0), ("m", 2, 4)])
    spec = ProcessorSpec.formula("m", "out", lambda x: 1 / x)
    assert sorted(r.double_value for r in spec.apply(rows).collect()) == [0.25, 0.5]


def test_request_verdicts(spark):
    ok = str(uuid.uuid4())
    rows = [(ok, T0, T0 + dt.timedelta(hours=24), ["a", "b"]), (ok.upper(), T0, T0 + dt.timedelta(1), ["a"]), (ok, T0, T0, ["a"]), (ok, T0, T0 + dt.timedelta(hours=24, microseconds=1), ["a"]), (ok, T0, T0 + dt.timedelta(1), ["b", "a"]), (ok, T0, T0 + dt.timedelta(1), []), (ok, None, T0, ["a"]), (ok, T0, T0 + dt.timedelta(1), ["a" * 257])]
    df = spark.createDataFrame([(*r, T0) for r in rows], "session_id string, started_at timestamp_ntz, ended_at timestamp_ntz, mrids array<string>, requested_at timestamp_ntz")
    assert [r.verdict for r in sessions.validate_requests(df).collect()] == ["accepted", "quarantine", "quarantine", "rejected", "rejected", "rejected", "quarantine", "rejected"]


def test_export_size_limit(spark):
    def row(n, step):
        return (str(uuid.uuid4()), T0, "M_ME_NC_1", 1, 3, [(1 + k * step, "short_float", 1.0, False) for k in range(n)])

    df = spark.createDataFrame([row(48, 1), row(49, 1), row(30, 2), row(31, 2)], "export_id string, created_at timestamp_ntz, type_id string, common_address int, cause int, objects array<struct<address:long,kind:string,value:double,overflow:boolean>>")
    assert [list(r.reasons) for r in catalogs.validate_exports(df).collect()] == [[], ["too_long"], [], ["too_long"]]


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(0.1,), (50.2,), (1e20,), (123456.0,), (-2.5,)], "v double")
    assert [r[0] for r in df.select(C.general15(F.col("v"))).collect()] == ["0.1", "50.2", "1e+20", "123456", "-2.5"]
    bad = spark.createDataFrame([("alarm/v1/cg/dXJuOg",), ("alarm/v1/cg==/dXJuOg",), ("x",), ("alarm/v1/c/d",)], "k string")
    assert [r[0] is None for r in bad.select(C.alarm_key_parts(F.col("k"))).collect()] == [False, True, True, True]
    name = spark.createDataFrame([(["a" * 300], 0)], "m array<string>, t long").select(C.selection_filename(F.col("m"), F.col("t"))).first()[0]
    assert name.startswith("measurement-session-1970-01-01T00-00-00Z-aaa") and len(name) == 244 and "-selection-1-" in name


def test_compact_and_newer(spark):
    log = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "y", 1), ("b", "z", 3)], "k string, v string, o long")
    assert [(r.k, r.v) for r in qualify.compact(log, "k", ["o"], "v").collect()] == [("b", "z")]
    assert qualify.compact(log.limit(0), "k", ["o"], "v").count() == 0


def test_artifact_schema(spark, tmp_path):
    from gridstream.schema import SESSION_VALUES
    from gridstream.sources import storage

    rows = measures(spark, [("m", 0, 1), ("n", 1, 2)]).withColumn("session_id", F.lit("s")).withColumn("blob_id", F.lit("b"))
    storage.write_session_artifacts(rows, f"{tmp_path}/a")
    back = spark.read.parquet(f"{tmp_path}/a").drop("_session")
    assert sessions.schema_reasons(back, SESSION_VALUES) == []
    assert sessions.schema_reasons(back.drop("mrid"), SESSION_VALUES)[0] == "columns"


def test_request_metadata_is_bounded_and_sorted(spark):
    pairs = lambda keys: "array(" + ", ".join(f"named_struct('key', '{k}', 'value', 'v')" for k in keys) + ")"
    base = "SELECT '6f9619ff-8b86-5011-b42d-00cf4fc964ff' AS session_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS started_at, TIMESTAMP_NTZ '2024-01-01 01:00:00' AS ended_at, TIMESTAMP_NTZ '2024-01-01 02:00:00' AS requested_at, array('a') AS mrids"
    for keys, want in ((["a", "b"], []), (["b", "a"], ["metadata_unsorted"]), (["a", "a"], ["metadata_unsorted"]), ([f"k{i:02d}" for i in range(33)], ["metadata_count"])):
        row = request_checks.validate_requests(spark.sql(f"{base}, {pairs(keys)} AS metadata")).first()
        assert row.reasons == want and row.verdict == ("rejected" if want else "accepted")
    assert request_checks.validate_requests(spark.sql(base)).first().verdict == "accepted"


def test_alarms_of_members_only(spark):
    rows = measures(spark, [("urn:a:f", 0, 60), ("urn:a:f", 1, 60), ("urn:a:f", 2, 60), ("urn:a:f", 3, 70), ("urn:a:f", 4, 70), ("urn:b:f", 5, 70)])
    log = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", None, 3), ("a", None, 4), ("a", "z", 4), ("c", None, 5)], "source string, value string, arrival_seq long")
    changes = alarms.member_events(log.where("NOT (arrival_seq = 4 AND value IS NULL)"), F.array(F.concat(F.lit("urn:"), "source", F.lit(":f"))))
    out = alarms.member_transitions(alarms.alarm_observations(rows, rule(spark)), changes, rule(spark)).orderBy("arrival_seq").collect()
    assert [(r.arrival_seq, r.action) for r in out] == [(1, "activate"), (2, "refresh"), (3, "clear"), (4, "activate")]
    current = spark.createDataFrame([("urn:a:f", "e1"), ("urn:b:f", "e2")], "mrid string, episode_id string")
    assert [r.episode_id for r in alarms.stale_alarms(current, changes.where("present")).collect()] == ["e2"]


def test_sessions_are_restartable(spark, tmp_path):
    from gridstream.streaming import jobs

    sid = lambda k: str(uuid.UUID(int=(k << 80) | (5 << 76) | (8 << 60)))
    ask = lambda k, mrids, minutes=60, meta=(): (sid(k), T0 - dt.timedelta(minutes=1), T0 + dt.timedelta(minutes=minutes), T0, mrids, [tuple(x) for x in meta])
    schema = "session_id string, started_at timestamp_ntz, ended_at timestamp_ntz, requested_at timestamp_ntz, mrids array<string>, metadata array<struct<key: string, value: string>>"
    live = measures(spark, [("m", k, k) for k in range(6)] + [("n", 1, 2)])
    batch = spark.createDataFrame([ask(1, ["m", "n"], meta=[("a", "b")]), ask(2, ["m", "o"]), ask(3, ["x"]), ask(4, ["n", "m"]), ask(5, ["m"])], schema)
    out = f"file://{tmp_path}/s"
    extract = jobs.extract_sessions(live, out, max_rows=6)
    work = jobs.storage.file_facts
    jobs.storage.file_facts = lambda *_: 1 / 0  # broken off after the artifacts
    try:
        with pytest.raises(ZeroDivisionError):
            extract(batch, 0)
    finally:
        jobs.storage.file_facts = work
    extract(batch, 0)
    extract(batch, 0)  # a repeat
    stored = lambda name: spark.read.schema(f"{jobs.EVIDENCE}, batch int").parquet(f"{out}/{name}")
    before = {r.session_id: r for r in stored("evidence").drop("batch").collect()}
    extract(spark.createDataFrame([ask(2, ["m"]), ask(5, ["m"]), ask(6, ["n"])], schema), 1)
    found = sessions.validate_blobmeta(stored("evidence"))
    got = {r.session_id: r for r in found.collect()}
    assert found.count() == 6 and {r.session_id for r in spark.read.parquet(f"{out}/conflicts").collect()} == {sid(2)}
    assert [got[sid(k)].status for k in range(1, 7)] == ["FAILED", "PARTIAL", "PARTIAL", "REJECTED", "COMPLETE", "COMPLETE"]
    assert got[sid(1)].rejection_reason == "too_many_rows" and got[sid(3)].measurement_count == 0 and got[sid(4)].rejection_reason == "mrids_unsorted"
    assert all(not r.reasons for r in got.values() if r.status != "FAILED")
    # the replay is published again as it was, a failure is not published, a new attempt may succeed
    published = {r.session_id: r for r in stored("published").where("batch = 1").drop("batch").collect()}
    assert set(published) == {sid(5), sid(6)} and published[sid(5)] == before[sid(5)]
    jobs.extract_sessions(live, out, max_rows=7)(batch.where(F.col("session_id") == sid(1)), 2)
    assert [r.status for r in stored("published").where("batch = 2").collect()] == ["COMPLETE"]
    # too large a file is taken back
    jobs.extract_sessions(live, out, max_bytes=100)(spark.createDataFrame([ask(7, ["m"])], schema), 3)
    last = stored("evidence").where("batch = 3").first()
    assert (last.status, last.rejection_reason, last.object) == ("FAILED", "artifact_too_large", None)
    assert jobs.storage.file_facts(spark, f"{out}/artifacts/batch=3").count() == 0
    evidence = stored("evidence").where("object IS NOT NULL").select("blob_id", "session_id", "path", "object.sha256", "object.byte_length", "coverage")
    uri = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    rows = spark.read.parquet(f"{out}/artifacts").withColumn("path", uri(F.col("_metadata.file_path")))
    facts = jobs.storage.file_facts(spark, f"{out}/artifacts").withColumn("path", uri(F.col("path")))
    evidence = evidence.withColumn("path", uri(F.col("path")))
    assert {tuple(r.reasons) for r in sessions.verify_artifacts(facts, evidence, rows).collect()} == {()}
    wrong = evidence.withColumn("session_id", F.lit(sid(9)))
    assert {tuple(r.reasons) for r in sessions.verify_artifacts(facts, wrong, rows).where("path NOT LIKE '%empty%'").collect()} == {("identity",)}
    spark.read.parquet(f"{out}/artifacts").drop("_session", "batch").withColumn("mrid", F.col("double_value")).write.parquet(f"{out}/odd")
    faults = {r.format for r in jobs.storage.file_facts(spark, f"{out}/odd").collect()}
    assert all("type:mrid" in f and "required:blob_id" in f for f in faults)


def test_ip_addresses(spark):
    import ipaddress
    import random

    rng = random.Random(1)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::ffff:10.0.0.1", "1:2:3:4:5:6:1.2.3.4", "2001:db8::1", "10.0.0.1", "10.0.0.256", "01.2.3.4", "1.2.3", "1.2.3.4.", "1:2", "1::2::3", "12345::", "g::", ":", ":::", "", "host", "1:2:3:4:5:6:7:8:9"]
    texts += ["".join(rng.choice(["1", "ab", ":", ":", "::", "f"]) for _ in range(rng.randrange(2, 12))) for _ in range(300)]
    texts = [t for t in texts if "%" not in t]

    def known(t):
        try:
            return bool(ipaddress.ip_address(t))
        except ValueError:
            return False

    df = spark.createDataFrame([(t,) for t in texts], "host string")
    got = [r[0] for r in df.select(F.col("host").rlike(catalogs.IPV4) | F.col("host").rlike(catalogs.IPV6)).collect()]
    assert [t for t, g in zip(texts, got, strict=True) if g != known(t)] == []


@pytest.mark.parametrize("width", [1, 7, 1 << 20])
def test_running_values_in_buckets(spark, width):
    from gridstream.functions.running import with_running

    rng = random.Random(width)
    rows = [(rng.choice("ab"), k, rng.choice([None, rng.randrange(100)])) for k in range(200)]
    df = spark.createDataFrame(rows, "key string, seq long, v int").repartition(3)
    got = with_running(df, ["key"], "seq", width, top=("max_before", F.col("v")), was=("last_before", F.col("v")), now=("last", F.col("v"))).collect()
    want = []
    for key, seq, v in rows:
        before = [x for k, s, x in rows if k == key and s < seq and x is not None]
        want.append((key, seq, v, max(before, default=None), before[-1] if before else None, v if v is not None else (before[-1] if before else None)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_alarms_do_not_depend_on_buckets(spark, monkeypatch):
    from gridstream.functions import running

    rng = random.Random(3)
    rows = measures(spark, [("urn:a:f", k + rng.randrange(-3, 3), rng.choice([50, 60])) for k in range(120)])
    log = spark.createDataFrame([(f"urn:a:f", k % 3 > 0, 7 * k) for k in range(18)], "mrid string, present boolean, arrival_seq long")
    found = []
    for width in (1 << 20, 5):
        monkeypatch.setattr(running, "WIDTH", width)
        found.append(sorted(map(repr, alarms.member_transitions(alarms.alarm_observations(rows, rule(spark)), log, rule(spark)).collect())))
    assert found[0] == found[1] and len(found[0]) > 20


def test_coverage_comes_from_the_stored_rows(spark, tmp_path):
    from gridstream.streaming import jobs

    sid = str(uuid.UUID(int=(1 << 80) | (5 << 76) | (8 << 60)))
    schema = "session_id string, started_at timestamp_ntz, ended_at timestamp_ntz, requested_at timestamp_ntz, mrids array<string>"
    asked = spark.createDataFrame([(sid, T0, T0 + dt.timedelta(hours=1), T0, ["m"])], schema)
    jobs.storage.write_live_store(measures(spark, [("m", 0, 1), ("m", 1, 2)]), f"{tmp_path}/live")
    live = lambda: spark.read.parquet(f"{tmp_path}/live")
    work = jobs.storage.write_session_artifacts
    jobs.storage.write_session_artifacts = lambda *_, **__: 1 / 0  # broken off after the rows
    try:
        with pytest.raises(ZeroDivisionError):
            jobs.extract_sessions(live(), f"{tmp_path}/s")(asked, 0)
    finally:
        jobs.storage.write_session_artifacts = work
    jobs.storage.write_live_store(measures(spark, [("m", 2, 3)]), f"{tmp_path}/live")  # the store grows meanwhile
    jobs.extract_sessions(live(), f"{tmp_path}/s")(asked, 0)
    row = spark.read.schema(jobs.EVIDENCE).parquet(f"{tmp_path}/s/evidence").first()
    assert row.measurement_count == 2 == spark.read.parquet(row.path).count()
    assert (row.blob_id, row.object.object_key) == (f"sessions/{sid}/measurements", f"sessions/{sid}/measurements.parquet")


def test_points_in_intervals(spark):
    from gridstream.functions.intervals import interval_join

    rng = random.Random(2)
    at = lambda s: T0 + dt.timedelta(microseconds=s)
    points = [(rng.choice("abc"), k, at(rng.randrange(-10**11, 10**11)) if k % 3 else at(rng.randrange(0, 3000))) for k in range(300)] + [("a", 900, None), (None, 901, T0)]
    spans = []
    for k in range(150):
        start = rng.randrange(-10**11, 10**11) if k % 3 else rng.randrange(0, 3000)
        spans.append((rng.choice("abd"), k, at(start), at(start + rng.choice((0, -5, 1, 7, 1000, 4096, 10**6, 10**8, 86_400 * 10**6, 10**11)))))
    spans += [("a", 200, points[0][2], points[0][2] + dt.timedelta(microseconds=1)), ("a", 201, None, T0)]
    p, s = spark.createDataFrame(points, "k string, i int, t timestamp_ntz"), spark.createDataFrame(spans, "k string, j int, a timestamp_ntz, b timestamp_ntz")
    got = sorted((r.i, r.j) for r in interval_join(p, s, "k", "t", "a", "b").collect())
    assert got == sorted((i, j) for k, i, t in points for m, j, a, b in spans if k == m and t and a and a <= t < b) and len(got) > 300


def test_live_store_is_pruned_to_the_hours_asked_for(spark, tmp_path):
    from gridstream.sources import storage

    storage.write_live_store(measures(spark, [("m", 3600 * k, k) for k in range(50)]), f"{tmp_path}/live")
    asked = spark.createDataFrame([("s", T0 + dt.timedelta(hours=3, minutes=-1), T0 + dt.timedelta(hours=5), ["m"])], "session_id string, started_at timestamp_ntz, ended_at timestamp_ntz, mrids array<string>")
    found = sessions.session_join(spark.read.parquet(f"{tmp_path}/live"), asked)
    assert sorted(r.double_value for r in found.collect()) == [3.0, 4.0]
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_evidence_size_is_that_of_the_message(spark):
    row = ("s" * 36, "a" * 64, "COMPLETE", "b" * 200, ["m", "n" * 130], [("m", 0), ("n" * 130, 300)], 300, None, [("k", "v")], ("bucket", "o" * 50, "t", 2, 5000, "c" * 64), "p", T0, T0, T0, T0.replace(year=1969))
    from gridstream.streaming import jobs

    df = spark.createDataFrame([row], jobs.EVIDENCE)
    # texts, digest, times of seconds alone (those before 1970 take ten bytes), lists, count, status, metadata, object
    want = (2 + 36) + (3 + 200) + 34 + 3 * (2 + 6) + (2 + 11) + (2 + 1) + (3 + 130) + (2 + 3) + (3 + 133 + 3) + 3 + 2 + (2 + 6) + (2 + (2 + 6) + (2 + 50) + 3 + 3 + 34 + 2)
    assert df.select(sessions.evidence_size(df)).first()[0] == want
    big = df.withColumn("rejection_reason", F.repeat(F.lit("x"), 40_000))
    assert "too_large" in sessions.validate_blobmeta(big).first().reasons


def test_the_contract_s_own_identities_have_no_fault(spark):
    from gridstream.streaming import jobs

    sid = "6f9619ff-8b86-5011-b42d-00cf4fc964ff"
    row = (sid, "a" * 64, "COMPLETE", f"sessions/{sid}/measurements", ["m"], [("m", 3)], 3, None, [], ("elsewhere", f"sessions/{sid}/measurements.parquet", sessions.MEDIA_TYPE, 2, 5000, "c" * 64), "p", T0, T0 + dt.timedelta(1), T0, T0)
    df = spark.createDataFrame([row], jobs.EVIDENCE)
    assert list(sessions.validate_blobmeta(df, "elsewhere").first().reasons) == []
    assert list(sessions.validate_blobmeta(df).first().reasons) == ["bad_object"]


def test_reasons_of_suppressed_latest_values(spark):
    from gridstream.operators.alarms import latest_values_audit, latest_values_join

    at = lambda s: None if s is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    nan, inf = float("nan"), float("inf")
    told = [  # input, key, type, value, valid, second, reason
        ("a", "a", "double", 1.0, True, 0, "incomplete_group:g"), ("b", "b", "double", 2.0, None, 1, "invalid_quality:b"), ("b", "b", "int", None, True, 1, "scalar_mismatch:b"),
        ("b", "b", "double", nan, True, 1, "non_finite_input:b"), ("b", "x", "double", 2.0, True, 1, "key_mismatch:b"), ("b", None, "double", 2.0, True, 1, "key_mismatch:b"),
        ("b", "b", "double", 2.0, True, None, "incomplete_group:g"), ("b", "b", "double", 2.0, True, 2, None), ("a", "a", "double", 0.0, True, 3, "result_not_numeric"),
        ("a", "a", "double", 1e308, True, 4, "non_finite_result"), ("a", "a", "double", 1e300, True, 8, "stale_input:b"), ("a", "a", "double", 3.0, True, 9, "stale_input:b"),
        ("b", "b", None, 1.0, True, 9, "scalar_mismatch:b"), ("b", "b", "double", 4.0, True, 20, "stale_input:a"), ("a", "a", "double", inf, False, 20, "invalid_quality:a"), ("a", "a", "double", 8.0, True, 21, None),
    ]
    rows = [(i, k, t, v, q, at(s), n) for n, (i, k, t, v, q, s, _) in enumerate(told)]
    df = spark.createDataFrame([*rows, ("z", "z", "double", 1.0, True, at(0), 99)], "mrid string, kafka_key string, value_type string, double_value double, quality_valid boolean, received_at timestamp, arrival_seq long")
    inputs = spark.createDataFrame([("a", "g", "a"), ("b", "g", "b")], "mrid string, group string, input string")
    calculation = F.when(F.col("a") != 0, F.col("a") * F.when(F.col("a") == 1e308, 100.0).otherwise(F.col("b")))
    out = latest_values_audit(df, inputs, calculation, ["a", "b"], 5.0).orderBy("arrival_seq").collect()
    assert [r.reason for r in out] == [r[-1] for r in told]
    assert [(r.arrival_seq, r.value) for r in out if r.value is not None] == [(7, 2.0), (15, 32.0)]
    good = df.where("quality_valid AND value_type = 'double' AND NOT isnan(double_value) AND kafka_key = mrid AND received_at IS NOT NULL")
    assert sorted(r.arrival_seq for r in latest_values_join(good, inputs, calculation, ["a", "b"], 5.0).collect()) == [7, 15]
    assert latest_values_audit(df.limit(0), inputs, calculation, ["a", "b"], None).count() == 0
