"""A small test for each finding of round 4."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"


def _artifacts(folder: Path) -> list[Path]:
    return sorted(folder.rglob("*.zstd.parquet"))


def _rows(spark, n: int = 40, sessions: int = 3):
    time = "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)"
    return spark.range(n).selectExpr(
        f"concat('00000000-0000-5000-8000-00000000000', id % {sessions}) AS session_id", f"concat('sessions/00000000-0000-5000-8000-00000000000', id % {sessions}, '/measurements') AS blob_id",
        "concat('urn:grid:site:01:m', id % 2) AS mrid", f"{time} AS timestamp_mccs", "'double' AS value_type", "50 + id / 100 AS double_value", "CAST(NULL AS BIGINT) AS int_value", "CAST(NULL AS BIGINT) AS uint_value",
        "CAST(NULL AS BOOLEAN) AS bool_value", "CAST(NULL AS STRING) AS string_value", "CAST(NULL AS TIMESTAMP_NTZ) AS timestamp_value", f"{time} AS timestamp_field", "CAST(NULL AS TIMESTAMP_NTZ) AS timestamp_gateway",
        *[f"id % 7 > 0 AS quality_{q}" for q in ("valid", "substituted", "operator_blocked", "overflow", "old_data")],
    )


def test_a_small_session_takes_one_block_of_the_disk(spark, tmp_path):
    from gridstream.sources import storage

    rows = _rows(spark)
    files = storage.write_session_artifacts(rows, f"{tmp_path}/a", flat=True)
    found = _artifacts(tmp_path / "a")
    assert len(found) == 3 and all(f.stat().st_size <= 4096 for f in found)
    assert len({f.parent for f in found}) <= 256 and all(f.parent.name.startswith("_part=") for f in found)  # no folder for each session
    assert {r.format for r in storage.file_facts(spark, files).collect()} == {""}
    note = pq.ParquetFile(found[0]).metadata.metadata
    assert note == {b"wama.parquet.schema_version": b"2"}  # where the reference's reader looks for it
    back = storage.read_artifact_rows(files, ["session_id", "mrid", "double_value", "quality_valid"]).drop("path")
    want = rows.select("session_id", "mrid", "double_value", "quality_valid")
    assert back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()
    stored = spark.read.parquet(f"{tmp_path}/a")
    assert stored.count() == 40 and "_session" not in stored.columns
    # a session is replaced, the others are left alone
    again = storage.write_session_artifacts(rows.where("session_id LIKE '%1'").limit(2), f"{tmp_path}/a", True, True)
    assert [r.n for r in again.collect()] == [2] and _artifacts(tmp_path / "a") == found and spark.read.parquet(f"{tmp_path}/a").count() == 40 - 13 + 2


def test_a_file_without_the_version_is_told(spark, tmp_path):
    from gridstream.sources import storage

    storage.write_session_artifacts(_rows(spark), f"{tmp_path}/a")
    [bad, *_] = _artifacts(tmp_path / "a")
    table = pq.read_table(bad, partitioning=None)
    pq.write_table(table.replace_schema_metadata({"wama.parquet.schema_version": "1"}), bad)
    assert sorted(r.format for r in storage.file_facts(spark, f"{tmp_path}/a").collect()) == ["", "", "version"]


def test_artifacts_of_queries_have_no_folders_of_their_own(spark, monkeypatch, tmp_path):
    from gridstream.plans import sessions
    from gridstream.sources import storage

    paths = []
    monkeypatch.setattr(storage, "scratch", lambda spark, name: paths.append(f"file://{tmp_path}/{name}-{len(paths)}") or paths[-1])
    for query, name in ((sessions.o5_session_artifacts, "artifacts"), (sessions.o36_verify_artifacts, "verify")):
        n = query(spark, SF).count()
        [folder] = tmp_path.glob(f"{name}-*")
        found = _artifacts(folder)
        assert len(found) == n > len(list(folder.iterdir())) and not list(folder.glob("_session=*"))
        assert max(f.stat().st_size for f in found) <= 4096


def test_files_are_checked_against_what_was_noted_at_writing_in_one_pass(spark, tmp_path):
    from pyspark.sql import functions as F

    from gridstream.operators import sessions as S
    from gridstream.sources import storage

    rows = _rows(spark)
    written = storage.write_session_artifacts(rows, f"{tmp_path}/a", flat=True)
    noted = {r.session_id: r for r in written.collect()}
    cover = rows.groupBy("session_id", "mrid").count().groupBy("session_id").agg(F.collect_list(F.struct("mrid", F.col("count").alias("n"))).alias("coverage"))
    blob = F.concat(F.lit("sessions/"), "session_id", F.lit("/measurements"))
    evidence = written.drop("n").join(cover, "session_id").withColumn("blob_id", blob)
    facts = storage.file_facts(spark, written)
    assert {(r.sha256, r.byte_length) for r in facts.collect()} == {(r.sha256, r.byte_length) for r in noted.values()}
    check = lambda: S.verify_artifacts(storage.file_facts(spark, written), evidence, storage.read_artifact_rows(written, ["blob_id", "session_id", "mrid"]))
    checked = check()
    assert [r.reasons for r in checked.collect()] == [[]] * 3
    assert checked._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # the rows are read once
    # a whole file of other rows: less than what the evidence says, and of another session
    [one, two] = [Path(noted[s].path.removeprefix("file:")) for s in sorted(noted)[:2]]
    one.write_bytes(two.read_bytes())
    found = {r.blob_id[-14]: r.reasons for r in check().collect()}
    assert found["1"] == found["2"] == [] and {"digest", "counts", "identity"} <= set(found["0"])


def test_materialized_sessions_are_small_files_and_their_coverage_is_counted_once(spark, monkeypatch, tmp_path):
    from gridstream.plans import streams
    from gridstream.sources import storage

    paths, plans = [], []
    monkeypatch.setattr(storage, "scratch", lambda spark, name: paths.append(f"file://{tmp_path}/{name}-{len(paths)}") or paths[-1])
    for name in ("write_session_artifacts", "write_empty_artifacts"):
        def spy(df, *a, work=getattr(storage, name), **b):
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
            return work(df, *a, **b)

        monkeypatch.setattr(storage, name, spy)
    done = streams.o77_materialize(spark, SF).where("status <> 'REJECTED'").count()
    assert len(plans) == 2 and not any(step in p for p in plans for step in ("Window", "Aggregate", "to_json"))
    [folder] = tmp_path.glob("sessions-*/artifacts/batch=0")
    found = _artifacts(folder)
    assert len(found) == done and not list(folder.glob("_session=*"))
    assert max(f.stat().st_size for f in found) <= 4096


def test_the_mean_of_a_second_is_exactly_rounded_as_in_the_reference(spark, tmp_path):
    import math
    import shutil

    from gridstream.plans import aggregates, streams
    from gridstream.streaming.machines import export_id

    values = [11.53, 27.32, 35.44]  # added up one by one, as by the SQL, their mean is a last bit off
    rows = [(k, 14, "click", v) for k, v in zip([1, 2, 3, 9], [*values, 1.0], strict=True)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    shutil.copy(f"{SF}/nation.parquet", f"{tmp_path}/nation.parquet")
    top = max(values)
    mean, plain = top * (math.fsum(v / top for v in values) / 3), top * (sum([v / top for v in values[:2]], 0.0) + 1.0) / 3
    want = export_id("urn:grid:site:14:click", 1_704_070_800, mean, (15, 114, 3), [False] * 4)
    assert mean == 24.763333333333335 != plain
    for query in (aggregates.o39_second_mean, streams.o73_stream_export):
        assert [(r.n, r.export_id) for r in query(spark, str(tmp_path)).collect()] == [(3, want)]
