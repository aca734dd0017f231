"""A small test for each finding of round 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstream.functions import columns as C
from gridstream.operators import alarms
from gridstream.operators import sessions as S


def test_next_values_use_no_frame_that_ends_at_the_last_row(spark):
    # such a frame is worked off anew for each row: 52,000 rows of a bucket are 1.4e9 steps
    log = spark.range(60_000).selectExpr("'s' AS source", "IF(id % 3 = 0, NULL, 'x') AS value", "id AS arrival_seq")
    intervals = alarms.membership_intervals(log)
    assert "unboundedfollowing" not in intervals._jdf.queryExecution().toString().lower()
    assert intervals.where("valid_to = valid_from + 1").count() == 39_999


def test_a_zero_divisor_suppresses_the_result(spark, tmp_path):
    from gridstream.plans import episodes

    rows = [(k, t, 1, v) for k, (t, v) in enumerate([("purchase", 4.0), ("signup", 2.0), ("signup", 0.0), ("signup", 1.0)], 1)]
    spark.createDataFrame(rows, "event_id long, event_type string, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    out = episodes.o78_processor_spec(spark, str(tmp_path)).orderBy("arrival_seq").collect()
    assert [(r.arrival_seq, r.double_value) for r in out] == [(2, 2.0), (4, 4.0)]


def test_file_names_of_far_years_have_no_sign(spark):
    name = spark.range(1).select(C.selection_filename(F.array(F.lit("a")), F.lit(86_399_123 * 2_933_737))).first()[0]
    assert name == "measurement-session-10002-03-21T05-18-32Z-a.csv"


def test_the_newest_sessions_have_one_order(spark):
    rows = [(f"s{k % 7}", "other", "COMPLETE", k % 7, 0) for k in range(7)]
    for order in (1, -1):
        df = spark.createDataFrame(rows[::order], "session_id string, blob_id string, status string, measurement_count long, finalized_at long")
        assert [r.session_id for r in S.session_list(df, 3).collect()] == ["s0", "s1", "s2"]


def test_artifacts_are_written_and_read_without_a_commit_or_a_listing(spark, tmp_path, monkeypatch):
    from gridstream.sources import storage

    monkeypatch.setattr(storage, "PIECE", 7)  # a session of several pieces
    time = "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, 100 - id)"
    rows = spark.range(60).selectExpr(
        "IF(id % 3 = 0, 'a', concat('s/', id % 5)) AS session_id", "'b' AS blob_id", "concat('m', id % 2) AS mrid", f"{time} AS timestamp_mccs", "'double' AS value_type", "CAST(id AS DOUBLE) AS double_value",
        "1L AS int_value", "NULL AS uint_value", "true AS bool_value", "'x' AS string_value", "NULL AS timestamp_value", f"{time} AS timestamp_field", "NULL AS timestamp_gateway",
        *[f"true AS quality_{q}" for q in ("valid", "substituted", "operator_blocked", "overflow", "old_data")],
    )
    files = storage.write_session_artifacts(rows, f"{tmp_path}/a")
    want = {r.session_id: r.n for r in rows.groupBy("session_id").count().withColumnRenamed("count", "n").collect()}
    assert {r.session_id: r.n for r in files.collect()} == want and files.count() == len(want) == 6
    back = storage.read_artifact_rows(files, ["session_id", "double_value"]).collect()
    assert sorted(r.double_value for r in back) == list(range(60))
    assert all([r.double_value for r in back if r.session_id == s] == sorted((r.double_value for r in back if r.session_id == s), reverse=True) for s in want)
    assert sorted(r.double_value for r in spark.read.parquet(f"{tmp_path}/a").where("_session = 's/1'").collect()) == sorted(r.double_value for r in back if r.session_id == "s/1")
    assert {r.format for r in storage.file_facts(spark, files).collect()} == {""}
    once = rows.where("session_id = 'a'").limit(2)
    again = storage.write_session_artifacts(once, f"{tmp_path}/a", True)
    assert [r.n for r in again.collect()] == [2] and spark.read.parquet(f"{tmp_path}/a").count() == 60 - want["a"] + 2


def test_rules_do_not_gather_the_changes_in_one_task(spark):
    from gridstream.operators.qualify import match_few

    rules = spark.createDataFrame([("r", "urn:*:f")], "rule string, glob string")
    changes = spark.range(1000, numPartitions=4).selectExpr("concat('urn:', id % 9, IF(id % 2 = 0, ':f', ':g')) AS mrid", "id AS arrival_seq")
    out = match_few(changes, rules)
    assert out.count() == 500
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_second_costs_few_calls_of_the_store(spark):
    from types import SimpleNamespace

    from pyspark.sql import Row

    from gridstream.streaming import jobs

    calls, held = [], {"sums": None, "seen": []}

    def state(name):
        def call(f):
            return lambda *a: (calls.append(name), f(*a))[1]

        return SimpleNamespace(
            get=call(lambda: held[name]), update=call(lambda v: held.update({name: v})), appendValue=call(held["seen"].append), clear=call(lambda: held.update({name: None})),
        )

    handle = SimpleNamespace(getValueState=lambda n, _: state(n), getListState=lambda n, _: state(n), registerTimer=lambda _: calls.append("timer"))
    job = jobs.Seconds([f"p{k}" for k in range(20)], 600)
    job.init(handle)
    rows = [Row(arrival_seq=k, pmu=f"p{k % 19}", topic="t", partition=0, offset=k, kind="frequency" if k % 2 else "voltage", double_value=float(k), good=k % 3 > 0, refused=None, rejections=k % 2) for k in range(190)]
    bad = Row(arrival_seq=500, pmu="p0", topic="t", partition=0, offset=500, kind="voltage", double_value=1.0, good=True, refused="late_after_close", rejections=0)
    assert [(r.second, r.refused, r.n) for r in job.handleInputRows((7,), iter([*rows[::-1][:100], bad]), None)] == [(7, "late_after_close", 1)]
    assert list(job.handleInputRows((7,), iter(rows[:120]), None)) == []  # 30 of them again
    assert len(calls) == 4 + 4
    cells = list(job.handleExpiredTimer((7,), None, None))
    assert len(calls) == 4 + 4 + 3
    assert [c.pmu for c in cells] == job.units and (cells[19].total, cells[19].mean_frequency) == (0, None)
    own = [r for r in rows if r.pmu == "p4"]
    mean = lambda kind: sum(good := [r.double_value for r in own if r.kind == kind and r.good]) / len(good)
    assert (cells[4].total, cells[4].rejections) == (sum(r.kind == "frequency" for r in own), sum(r.rejections for r in own))
    assert (cells[4].mean_frequency, cells[4].mean_voltage) == (mean("frequency"), mean("voltage"))


def test_session_requests_are_made_once_and_by_many_tasks(spark):
    from gridstream.plans import sessions

    d = "/root/testdata/sf0.001"
    for query in (sessions.o28_coverage_audit, sessions.o43_session_coverage, sessions.o27_session_join):
        df = query(spark, d)
        assert "c_custkey" not in df._jdf.queryExecution().executedPlan().toString()  # the joins read what was stored
    assert sessions.session_requests(spark, d, 7).rdd.getNumPartitions() == 7


def test_blobs_are_dealt_by_the_number_of_their_lines(spark, monkeypatch):
    from gridstream.plans import sessions

    d = "/root/testdata/sf0.001"
    few = sessions._blobs(spark, d)
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    monkeypatch.setattr(sessions, "LINES_A_TASK", 100)
    many = sessions._blobs(spark, d)
    plan = many._jdf.queryExecution().executedPlan().toString()
    # both tables are dealt once, before the lines are summed and listed
    assert plan.count("Exchange hashpartitioning") == 2 and many.rdd.getNumPartitions() == -(-lines // 100)
    assert few.exceptAll(many).isEmpty() and few.count() == many.count()
