"""Streams that are stopped and started again, and numbers that must be exact."""

from __future__ import annotations

import datetime as dt
import math
import random
import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from gridstream.functions.exact import array_mean, hex_text, stable_mean
from gridstream.functions.running import with_running
from gridstream.operators import aggregate, alarms, catalogs, lfr, qualify
from gridstream.plans import aggregates
from gridstream.sources.fixtures import measurements
from gridstream.streaming import jobs, machines
from tests.test_operators import T0, measures

SF = "/root/testdata/sf0.001"
EPOCH = dt.datetime(1970, 1, 1)


# --- exact numbers ------------------------------------------------------------


def doubles():
    rng = random.Random(1)
    odd = [0.0, -0.0, 1.0, -1.0, 2.0**-1022, -(2.0**-1022), 5e-324, 1e-310, 1e300, -1e300, 1.7976931348623157e308, 0.1, 50.2, 2.0**52, 2.0**53 - 1, 1 - 2.0**-53, 1 + 2.0**-52]
    return odd + [rng.uniform(-1, 1) * 10.0 ** rng.randint(-307, 307) for _ in range(700)] + [2.0**k for k in range(-1070, 1024, 7)]


def test_hexadecimal_text_of_doubles(spark):
    df = spark.createDataFrame([(x,) for x in doubles()], "x double").withColumn("h", hex_text(F.col("x")))
    wrong = [(r.x, r.h, (r.x + 0.0).hex()) for r in df.collect() if r.h != (0.0 if r.x == 0 else r.x).hex()]
    assert wrong == []


def test_means_do_not_overflow_or_depend_on_order(spark):
    values = [1e308, 1e308, -1e308, 1.0]
    assert stable_mean(values) == stable_mean(values[::-1]) and math.isfinite(stable_mean(values))
    assert str(stable_mean([-0.0, 0.0])) == "0.0" and str(stable_mean([-1.0, 1.0])) == "0.0"
    df = spark.createDataFrame([([1e308, 1e308],), ([],), (None,), ([0.1, 0.2, 0.3],)], "v array<double>")
    assert [r[0] for r in df.select(array_mean(spark, F.col("v"))).collect()] == [1e308, None, None, stable_mean([0.3, 0.1, 0.2])]


def test_export_identities_tell_all_that_is_exported(spark):
    rows = measures(spark, [("m", 0, 1e13, {"quality_overflow": True}), ("m", 1, 1e300), ("m", 2, 0.0, {"quality_operator_blocked": True, "quality_old_data": True}), ("m", 3, 50.2), ("m", 4, 1)])
    where = lambda address, cause: spark.createDataFrame([("m", address, 7, cause)], "mrid string, common_address int, object_address int, cause int")
    out = aggregate.second_mean_export(rows, where(5, 20)).orderBy("second").collect()
    assert [r["mean"] for r in out] == [1e13, 1e300, 0.0, 50.2]
    assert [(r.quality_operator_blocked, r.quality_old_data, r.quality_overflow, r.quality_substituted) for r in out] == [(False, False, True, False), (False,) * 4, (True, True, False, False), (False,) * 4]
    start = int((T0 - EPOCH).total_seconds())
    assert [r.export_id for r in out] == [machines.export_id("m", start + k, r["mean"], (5, 7, 20), [r.quality_operator_blocked, r.quality_old_data, r.quality_overflow, r.quality_substituted]) for k, r in enumerate(out)]
    assert out[3].export_id == str(uuid.uuid5(machines.EXPORTS, "\0".join(["m", str(start + 3), (50.2).hex(), "5", "7", "20", "0", "0", "0", "0"])))
    for other in (where(6, 20), where(5, 3)):
        assert not {r.export_id for r in out} & {r.export_id for r in aggregate.second_mean_export(rows, other).collect()}


def test_export_times_are_whole_milliseconds(spark):
    row = lambda us: (str(uuid.uuid4()), EPOCH + dt.timedelta(microseconds=us), "M_ME_NC_1", 1, 3, [(1, "short_float", 1.0, False)])
    df = spark.createDataFrame([row(us) for us in (-1, 0, 500, 999, 1000)], "export_id string, created_at timestamp_ntz, type_id string, common_address int, cause int, objects array<struct<address:long,kind:string,value:double,overflow:boolean>>")
    assert [list(r.reasons) for r in catalogs.validate_exports(df).collect()] == [["bad_time"]] * 4 + [[]]


def test_order_by_nanoseconds(spark):
    rows = measures(spark, [("m", 0, k, {"mccs_sec": 10, "mccs_nanos": n}) for k, n in enumerate([5, 4, 5, 6, 999, 998])])
    assert [r.double_value for r in qualify.newer_only(rows, ["mrid"]).orderBy("arrival_seq").collect()] == [0, 3, 4]


# --- running values --------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 7, 1 << 20])
def test_next_values_in_buckets(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("ab"), k // 2, k, rng.choice([None, rng.randrange(9)])) for k in range(120)]
    df = spark.createDataFrame(rows, "k string, o long, tie int, v int").repartition(3)
    got = with_running(df, ["k"], "o", width, then=["tie"], nxt=("first_after", F.col("v")), was=("last_before", F.col("v"))).collect()
    for r in got:
        own = [(o, t, v) for k, o, t, v in rows if k == r.k and v is not None]
        assert r.nxt == next((v for o, t, v in sorted(own) if (o, t) > (r.o, r.tie)), None)
        assert r.was == next((v for o, t, v in sorted(own, reverse=True) if (o, t) < (r.o, r.tie)), None)


def test_logs_and_counters_do_not_depend_on_buckets(spark):
    rng = random.Random(5)
    log = spark.createDataFrame([(rng.choice("abc"), rng.choice([None, "x", "y"]), k) for k in range(150)], "source string, value string, arrival_seq long")
    samples = spark.createDataFrame([(rng.choice("ab"), T0 + dt.timedelta(seconds=k // 2), k, float(rng.randrange(100))) for k in range(100)], "s string, ts timestamp_ntz, n int, value double")
    found = []
    for width in (None, 7):
        found.append([sorted(map(repr, df.collect())) for df in (
            alarms.membership_intervals(log, width=width), alarms.membership_changes(log, width=width),
            aggregate.counter_rate(samples, ["s"], ["s"], order=["n"], width=width and 7_000_000),
        )])
    assert found[0] == found[1] and all(found[0])


# --- alarms after a restart -----------------------------------------------------------


def test_alarms_go_on_wherever_they_were_stopped(spark):
    rules = spark.createDataFrame([("r", "urn:*:f", 50.0, "warning")], "rule string, glob string, threshold double, severity string")
    story = ["in", 60, 61, 40, 40, 62, "out", 70, "in", 63, 64, "out", "in", 65, 30, 66, 66]
    times = [0, 5, 6, 6, 7, 9, 0, 10, 0, 9, 10, 0, 0, 10, 11, 12, 12]  # of equal seconds the nanoseconds decide

    def step(state, k, mrid):
        what = story[k]
        row = SimpleNamespace(
            alarm_key=f"key/{mrid}", arrival_seq=k, topic="t", partition="0", offset=str(k), mccs_us=times[k] * 10**6, at_seconds=times[k], at_nanos=k,
            double_value=None if isinstance(what, str) else float(what), threshold=50.0, gone=what == "out", joined=what == "in", bound=True,
        )
        return machines.alarm_step(state, row, ("r", mrid))

    names = [f"urn:{k}:f" for k in range(len(story) + 1)]
    before, active, marks, inside = {}, [], [], []
    for k, mrid in enumerate(names):
        state = {}
        for j in range(k):
            step(state, j, mrid)
        before[mrid] = state
        if "watermark" in state:
            marks.append(("r", mrid, state["watermark"] // 10**9, state["watermark"] % 10**9))
        if "episode" in state:
            at = EPOCH + dt.timedelta(microseconds=state["watermark"] // 1000)
            active.append(("r", mrid, state["episode"][0], EPOCH + dt.timedelta(microseconds=state["episode"][1]), at))
        if state.get("member"):
            inside.append((mrid,))
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    current = table(active, "rule string, mrid string, episode_id string, activated_at timestamp_ntz, watermark timestamp_ntz")
    members = table(inside, "mrid string")
    states, stale = jobs.alarm_states(current, table(marks, "rule string, mrid string, seconds long, nanos int"), members, rules), jobs.alarms_to_end(current, members, rules)
    restored = {r.mrid: machines.ALARM.unpack(tuple(r)[2:]) for r in states.collect()}
    assert stale.count() == 0
    for k, mrid in enumerate(names):
        whole, again = dict(before[mrid]), restored.get(mrid, {})
        assert [step(again, j, mrid) for j in range(k, len(story))] == [step(whole, j, mrid) for j in range(k, len(story))], k


def test_alarms_of_former_members_are_ended(spark):
    rules = spark.createDataFrame([("r", "urn:*:f", 50.0, "warning")], "rule string, glob string, threshold double, severity string")
    current = spark.createDataFrame([("r", "urn:a:f", "e1", T0, T0), ("r", "urn:b:f", "e2", T0, T0), ("other", "urn:a:f", "e3", T0, T0)], "rule string, mrid string, episode_id string, activated_at timestamp_ntz, watermark timestamp_ntz")
    seconds = int((T0 - EPOCH).total_seconds())
    marks = spark.createDataFrame([("r", "urn:b:f", seconds + 9, 5), ("r", "urn:c:f", 3, 0)], "rule string, mrid string, seconds long, nanos int")
    members = spark.createDataFrame([("urn:a:f",), ("urn:c:f",), ("urn:d:f",)], "mrid string")
    known = marks.unionByName(spark.createDataFrame([("r", "urn:a:f", 5, 0)], marks.schema))
    states, stale = jobs.alarm_states(current, known, members, rules), jobs.alarms_to_end(current, members, rules)
    assert [(r.mrid, r.episode_id, r.action) for r in stale.collect()] == [("urn:b:f", "e2", "clear")]
    got = {r.mrid: machines.ALARM.unpack(tuple(r)[2:]) for r in states.collect()}
    assert got["urn:b:f"] == {"watermark": (seconds + 9) * 10**9 + 5} and got["urn:d:f"] == {"member": True}
    assert got["urn:a:f"]["watermark"] == seconds * 10**9 and got["urn:a:f"]["episode"] == ["e1", seconds * 10**6]
    with pytest.raises(Exception, match="no watermark"):
        jobs.alarm_states(current, marks, members, rules).collect()
    evidence = jobs.alarm_states(current.where("mrid = 'urn:a:f' AND rule = 'r'")).first()
    assert (evidence.seconds, evidence.member, evidence.episode_id) == (seconds, True, "e1")


def test_restored_alarms_in_the_stream(spark, tmp_path):
    rules = spark.createDataFrame([("r", "urn:*:f", 50.0, "warning")], "rule string, glob string, threshold double, severity string")
    rows = measures(spark, [("urn:a:f", 10, 40), ("urn:b:f", 11, 60), ("urn:b:f", 4, 60), ("urn:c:f", 12, 60)])
    active = spark.createDataFrame([("r", "urn:a:f", "e1", T0, T0)], "rule string, mrid string, episode_id string, activated_at timestamp_ntz, watermark timestamp_ntz")
    start = int((T0 - EPOCH).total_seconds())
    marks = spark.createDataFrame([("r", "urn:a:f", start, 0), ("r", "urn:b:f", start + 10, 999_999_999), ("r", "urn:c:f", start + 20, 0)], "rule string, mrid string, seconds long, nanos int")
    states = jobs.alarm_states(active, marks, spark.createDataFrame([("urn:a:f",), ("urn:b:f",), ("urn:c:f",)], "mrid string"), rules)
    log = rows.withColumn("present", F.lit(None).cast("boolean"))
    out = f"{tmp_path}/out"
    jobs.run_to_end(jobs.stream_alarm(jobs.replayed(spark, log, "alarms", "arrival_seq"), rules, states), out)
    got = sorted((r.mrid, r.action, r.episode_id == "e1") for r in spark.read.parquet(out).collect())
    assert got == [("urn:a:f", "clear", True), ("urn:b:f", "activate", False)]


@pytest.mark.parametrize(("kind", "state"), [
    (machines.EXPORT, {"second": 5, "values": [1.0, 2.5], "flags": [True, False, False, True]}), (machines.CAPTURE, {"seen": 5 * 10**9 + 7}), (machines.CAPTURE, {"seen": -3, "onset": 9}),
    (machines.LATEST, {"a": [1.0, 5], "b": [2.0, -6]}), (machines.ALARM, {"watermark": 12, "member": True, "episode": ["e", 4]}), (machines.ALARM, {"member": True}), (machines.ALARM, {"watermark": -1}),
])
def test_states_come_back_as_they_were(kind, state):
    assert kind.unpack(kind.pack(state)) == state


def test_a_store_without_order_is_refused(spark, tmp_path, monkeypatch):
    from gridstream.sources import storage

    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/t")
    storage.date_in_order(spark, f"{tmp_path}/t")
    work = storage._folder

    class Forgetful:
        def __init__(self, store):
            self.listStatus, self.setTimes = store.listStatus, lambda *_: None

    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/u")
    names = sorted(p for p in (tmp_path / "u").iterdir() if p.suffix == ".parquet")
    for k, p in enumerate(reversed(names)):
        __import__("os").utime(p, (1000 + k, 1000 + k))
    monkeypatch.setattr(storage, "_folder", lambda *a: (Forgetful(work(*a)[0]), work(*a)[1]))
    with pytest.raises(ValueError, match="order"):
        storage.date_in_order(spark, f"{tmp_path}/u")


# --- seconds closed by timers --------------------------------------------------------------


def test_seconds_close_by_timers_and_outlive_a_restart(spark, tmp_path):
    s, units = aggregates.SETTINGS, aggregates._units(spark, SF)
    table = jobs.with_last_tick(measurements(spark, SF, aggregates.DENSE_MS), s)
    half = table.agg(F.max("arrival_seq")).first()[0] // 2
    odd = table.where("arrival_seq % 97 = 3").withColumn("timestamp_field", F.when(F.col("arrival_seq") % 2 == 0, F.col("received_at") + F.expr("INTERVAL '9' SECOND"))).withColumn("offset", -F.col("offset"))
    table = table.unionByName(odd)
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def run(rows):
        rows.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(source)
        jobs.run_to_end(jobs.stream_lfr(stream, units, s), out, jobs.publish_lfr(out, "urn:lfr:preferred", s))

    run(table.where(F.col("arrival_seq") <= half))
    early = spark.read.parquet(f"{out}/sent").count()
    run(table.where(F.col("arrival_seq") > half))
    inputs = lfr.accepted_inputs(table.where("mrid <> ''"), units, s)
    want = {(r.pmu, r.second): (r.good, r.total, r.rejections) for r in lfr.pmu_second(inputs, units, s).collect()}
    cells = spark.read.schema(jobs.CELL).parquet(f"{out}/cells")
    got = [((r.pmu, r.second), (r.good, r.total, r.rejections)) for r in cells.where("refused IS NULL").collect()]
    assert len(got) == len(want) and dict(got) == want and len(want) == 20 * len({second for _, second in want})
    refused = {r.refused: r.n for r in cells.where("refused IS NOT NULL").groupBy("refused").agg(F.sum("n").alias("n")).collect()}
    assert refused == {r.refused: r.n for r in lfr.refusal_counts(inputs).collect()} and len(refused) == 3
    batch = {r.publication_id: r.double_value for r in lfr.publications(lfr.preferred_frequency(lfr.classify_pmu(lfr.pmu_second(inputs, units, s), s), s), "urn:lfr:preferred", s).collect()}
    sent = {r.publication_id: r.double_value for r in spark.read.parquet(f"{out}/sent").collect()}
    assert 0 < early < len(sent) and sent == pytest.approx(batch)
