"""Structured Streaming jobs: twins of the batch operators with keyed state.

Order within a key is by ``arrival_seq`` inside a micro-batch; the source keeps
it between batches. State lives in RocksDB and in the query's checkpoint, so a
restart goes on where it stopped.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridstream.cluster import ship
from gridstream.functions.columns import alarm_key, exact_time, finite
from gridstream.operators import aggregate, lfr, sessions
from gridstream.operators.qualify import glob_regex, match_few, quality_ok
from gridstream.sources import storage
from gridstream.streaming import machines

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine(StatefulProcessor):
    """Runs a step function over the rows of each key; the state is typed and is read
    and written once for each key and batch."""

    def __init__(self, step: Callable[[dict, Any, tuple], list[dict]], columns: list[str], kind: machines.Kind):
        self.step, self.columns, self.kind = step, columns, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.kind.columns)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.kind.unpack(tuple(self.state.get())) if self.state.exists() else {}
        found: list[dict] = []
        # a micro-batch is bounded by its trigger, and so is what one key has in it
        for row in pd.concat(list(rows)).sort_values("turn").itertuples(index=False):
            found += self.step(state, row, key)
        if state:
            self.state.update(self.kind.pack(state))
        elif self.state.exists():
            self.state.clear()
        yield pd.DataFrame(found, columns=self.columns)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        names = [(c.split(" ")[0], c.split(" ")[1]) for c in self.kind.columns.split(", ")]
        kinds = {"long": int, "int": int, "boolean": bool, "string": str}
        row = initialState.iloc[0]
        self.state.update(tuple(None if pd.isna(row[n]) else kinds[k](row[n]) for n, k in names))

    def close(self) -> None:
        pass


def _run(df: DataFrame, keys: list[str], step: Callable, schema: str, kind: machines.Kind, initial: DataFrame | None = None) -> DataFrame:
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    df = df if "turn" in df.columns else df.withColumn("turn", F.col("arrival_seq"))
    columns = [c.strip().split(" ")[0] for c in schema.replace("array<double>", "x").split(",")]
    start = initial.groupBy(*keys) if initial is not None else None
    return df.groupBy(*keys).transformWithStateInPandas(Machine(step, columns, kind), schema, "append", "none", start)


def _us(c: str) -> F.Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _known(df: DataFrame, profile: str) -> DataFrame:
    return df.where(quality_ok(profile) & (F.col("value_type") == "double") & finite(F.col("double_value")) & F.col("kafka_key").eqNullSafe(F.col("mrid")))


def _exact(df: DataFrame) -> list[F.Column]:
    """The time that orders alarms and captures, as a row's two numbers."""
    at = exact_time(df)
    return [at["seconds"].alias("at_seconds"), at["nanos"].alias("at_nanos")]


def stream_export(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Event-second means per mapped mrid with all flags and their identity; the newest second of
    each stays open. mapping: mrid, and what ``export_targets`` reads."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    where = aggregate.export_targets(mapping)
    rows = _known(df, "explicit_valid").where(F.col("timestamp_field").isNotNull()).join(where, "mrid")
    rows = rows.select(
        "mrid", "arrival_seq", _us("timestamp_field").alias("field_us"), "double_value", "common_address", "object_address", "cause",
        flag("quality_operator_blocked").alias("blocked"), flag("quality_old_data").alias("not_topical"), flag("quality_overflow").alias("overflow"), flag("quality_substituted").alias("substituted"),
    )
    flags = ", ".join(f"{f} boolean" for f in machines.FLAGS)
    return _run(rows, ["mrid"], machines.export_step, f"mrid string, second_us long, n long, mean double, {flags}, export_id string", machines.EXPORT)


def stream_capture(df: DataFrame, policies: DataFrame) -> DataFrame:
    """Closed episodes above each policy's threshold."""
    rows = _known(df, "strict").where(F.col("timestamp_mccs").isNotNull()).join(policies.select("mrid", "threshold"), "mrid")
    rows = rows.select("mrid", "arrival_seq", _us("timestamp_mccs").alias("mccs_us"), *_exact(rows), "double_value", "threshold")
    return _run(rows, ["mrid"], machines.capture_step, "mrid string, onset_us long, cleared_us long", machines.CAPTURE)


def stream_latest_values(df: DataFrame, inputs: DataFrame, names: list[str], max_age_s: float | None, clock: str = "kafka_ts") -> DataFrame:
    """Values of all inputs of a group on each arrival, exact for out-of-order clocks too."""
    rows = _known(df, "explicit_valid").join(inputs, "mrid")
    age = -1 if max_age_s is None else round(max_age_s * 1e6)
    rows = rows.select("group", "arrival_seq", "input", _us(clock).alias("clock_us"), "double_value", F.lit(",".join(names)).alias("names"), F.lit(age).cast("long").alias("max_age_us"))
    return _run(rows, ["group"], machines.latest_step, "group string, arrival_seq long, newest_us long, inputs array<double>", machines.LATEST)


ALARM_KINDS = "alarm_key string, rule string, mrid string, arrival_seq long, mccs_us long, action string, episode_id string, activated_us long"


def stream_alarm(df: DataFrame, rules: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Alarm transitions per rule and mrid. ``initial`` (rule, mrid and the columns of
    ``machines.ALARM``) restores the state from the stored change logs, see ``alarm_states``.

    If ``df`` has a column ``present``, rows where it is not null are changes of
    the membership of their mrid (see ``alarms.member_events``): a signal is
    evaluated only while it is a member, and its removal ends an active alarm.
    """
    member = F.col("present") if "present" in df.columns else F.lit(None).cast("boolean")
    df = df.withColumn("_present", member)
    size = lambda c: F.size(F.split(c, ":"))
    patterns = rules.withColumn("_n", size("glob")).withColumn("_p", glob_regex(F.col("glob")))
    fresh = F.col("received_at") - F.col("timestamp_mccs") <= F.expr("INTERVAL '30' SECOND")
    counted = df.where(F.col("_present").isNotNull()).unionByName(_known(df.where(F.col("_present").isNull()), "strict").where(fresh))
    rows = counted.withColumn("_n", size("mrid")).join(F.broadcast(patterns), "_n").where(F.expr("mrid RLIKE _p"))
    seconds, nanos = _exact(rows)
    rows = rows.select(
        "rule", "mrid", "arrival_seq", alarm_key(F.col("rule"), F.col("mrid")).alias("alarm_key"), "topic",
        F.col("partition").cast("string").alias("partition"), F.col("offset").cast("string").alias("offset"),
        F.coalesce(_us("timestamp_mccs"), F.lit(0)).alias("mccs_us"), F.coalesce(seconds, F.lit(0)).alias("at_seconds"), F.coalesce(nanos, F.lit(0)).alias("at_nanos"),
        "double_value", "threshold", F.coalesce(~F.col("_present"), F.lit(False)).alias("gone"), F.coalesce(F.col("_present"), F.lit(False)).alias("joined"),
        F.lit("present" in df.columns).alias("bound"),
        (2 * F.col("arrival_seq") + F.when(F.col("_present").isNull(), 1).otherwise(0)).alias("turn"),  # changes of membership before rows of their place
    )
    return _run(rows, ["rule", "mrid"], machines.alarm_step, ALARM_KINDS, machines.ALARM, initial)


def alarm_states(active: DataFrame, watermarks: DataFrame | None = None, members: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """What ``stream_alarm`` begins with after a restart, from the newest entries of three change logs.

    active: rule, mrid, episode_id, activated_at, watermark (time of the evidence). watermarks:
    rule, mrid, seconds, nanos, of all keys that were ever evaluated, active or not. members: mrid of
    the signals that are members now; ``rules`` say which keys those are. A key's watermark is
    the later of its own and its alarm's evidence. An active alarm without a watermark is an
    error; only without the log of watermarks does evidence stand in. Alarms of signals that are no
    members (any more) are not active, but keep their watermark; ``alarms_to_end`` lists
    them. Without ``members`` all active ones are members. Keys of rules that are not configured are left out.
    """
    keys = ["rule", "mrid"]
    marks = active.select(*keys, exact_time(active, "watermark").alias("_mark")) if watermarks is None else watermarks.select(*keys, F.struct("seconds", F.col("nanos").cast("int").alias("nanos")).alias("_mark"))
    now = active.select(*keys) if members is None else match_few(members.select("mrid").distinct(), rules).select(*keys)
    alarms_now = active.select(*keys, "episode_id", "activated_at", exact_time(active, "watermark").alias("_evidence"))
    both = alarms_now.join(marks, keys, "full_outer").join(now.distinct().withColumn("member", F.lit(True)), keys, "full_outer")
    known = both if rules is None else both.join(rules.select("rule").distinct(), "rule", "left_semi")
    lacking = F.col("episode_id").isNotNull() & F.col("_mark").isNull()
    error = F.raise_error(F.lit("an active alarm has no watermark")).cast("struct<seconds: bigint, nanos: int>")
    late = known.withColumn("_mark", F.when(lacking, error).otherwise(F.col("_mark"))).withColumn("_at", F.greatest("_mark", "_evidence"))
    episode = lambda c: F.when(F.col("member"), c)
    return late.select(*keys, "_at.seconds", "_at.nanos", "member", episode(F.col("episode_id")).alias("episode_id"), episode(_us("activated_at")).alias("activated_us"))


def alarms_to_end(active: DataFrame, members: DataFrame, rules: DataFrame) -> DataFrame:
    """Active alarms of configured rules whose signal is no member when the work begins, as transitions that clear them."""
    now = match_few(members.select("mrid").distinct(), rules).select("rule", "mrid")
    stale = active.join(rules.select("rule").distinct(), "rule", "left_semi").join(now, ["rule", "mrid"], "left_anti")
    return stale.select(alarm_key(F.col("rule"), F.col("mrid")).alias("alarm_key"), "rule", "mrid", "episode_id", F.lit("clear").alias("action"))


CELL = "second long, pmu string, mean_frequency double, mean_voltage double, good long, total long, rejections long, refused string, n long"
NO_SECOND = -(1 << 40)  # of rows without a field time


SUMS = "pmu array<string>, frequency array<double>, good array<bigint>, total array<bigint>, voltage array<double>, voltages array<bigint>, rejections array<bigint>"
SEEN = "pmu array<string>, topic array<string>, partition array<int>, offset array<bigint>"


class Seconds(StatefulProcessor):
    """Sums of one second by unit, and the second's end by a timer.

    The state is typed: the sums of all units as one value, and a list of the inputs seen with one
    entry for each batch. So a second costs the same few calls of the store however many units
    and rows it has: each batch reads and writes the sums once and adds one entry, and the timer
    reads them once. State is gone when the timer has fired.
    """

    def __init__(self, units: list[str], close_delay_ms: int):
        self.units, self.delay = units, close_delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", SUMS)
        self.seen = handle.getListState("seen", SEEN)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        refused: Counter = Counter()
        taken = []
        for row in rows:  # of one second
            if row["refused"] is None:
                taken.append(row)
            else:
                refused[row["refused"]] += 1
        for reason, n in refused.items():
            yield self._row(second=key[0], refused=reason, n=n)
        if not taken:
            return
        held = self.sums.get()
        sums, known = {}, set()
        if held is None:
            self.handle.registerTimer((key[0] + 1) * 1000 + self.delay)
        else:
            sums = {pmu: list(was) for pmu, *was in zip(*held, strict=True)}
            known = {k for batch in self.seen.get() for k in zip(*batch, strict=True)}
        fresh = []
        for row in sorted(taken, key=lambda r: r["arrival_seq"]):
            k = (row["pmu"], row["topic"], row["partition"], row["offset"])
            if k in known:
                continue
            known.add(k)
            fresh.append(k)
            own = sums.setdefault(row["pmu"], [0.0, 0, 0, 0.0, 0, 0])
            if row["kind"] == "frequency":
                own[2] += 1
            if row["good"]:
                of = 0 if row["kind"] == "frequency" else 3
                own[of] += row["double_value"]
                own[of + 1] += 1
            own[5] += row["rejections"]
        if fresh:
            self.seen.appendValue(tuple(map(list, zip(*fresh, strict=True))))
            self.sums.update(tuple(map(list, zip(*((pmu, *own) for pmu, own in sums.items()), strict=True))))

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        found = {pmu: own for pmu, *own in zip(*(self.sums.get() or ()), strict=True)}
        self.sums.clear()
        self.seen.clear()
        for pmu in self.units:  # absent ones too
            f, good, total, v, voltages, rejections = found.get(pmu, (None, 0, 0, None, 0, 0))
            yield self._row(second=key[0], pmu=pmu, mean_frequency=f / good if good else None, mean_voltage=v / voltages if voltages else None, good=good, total=total, rejections=rejections)

    def _row(self, **values: Any) -> Row:
        return Row(**{name: values.get(name) for name in (c.split(" ")[0] for c in CELL.split(", "))})

    def close(self) -> None:
        pass


def stream_lfr(df: DataFrame, units: DataFrame, s: lfr.Settings, live: bool = False, disorder_ms: int = 1) -> DataFrame:
    """Cells of every configured unit for each second that has closed, and counts of refused
    rows (``refused``, ``n``; too late, too far ahead, without a time) as they come.

    A second closes ``close_delay_ms`` after its end, by a timer: on the clock of ``received_at``, which is
    that of the rows themselves and so the same in a replay (rows may come ``disorder_ms`` out
    of its order), or, if ``live``, on the wall clock. Whether a row is late its two times
    tell. The clock of a replay stands still at its end; ``with_last_tick`` moves it on.
    """
    ship(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = sorted(r[0] for r in units.select("pmu").distinct().collect())  # the configuration
    clocked = df.withColumn("_clock", F.col("received_at").cast("timestamp")).withWatermark("_clock", f"{disorder_ms} milliseconds")
    inputs = lfr.accepted_inputs(clocked, units, s)
    rows = inputs.select(
        F.coalesce("second", F.lit(NO_SECOND)).alias("second"), "_clock", "arrival_seq", "pmu", "topic", "partition", "offset", "kind",
        "double_value", "good", "refused", F.size("reasons").alias("rejections"),
    )
    return rows.groupBy("second").transformWithState(Seconds(names, s.close_delay_ms), CELL, "append", "processingTime" if live else "eventTime")


def with_last_tick(df: DataFrame, s: lfr.Settings) -> DataFrame:
    """A stored table to replay, with a last row of no signal by whose time all seconds have closed."""
    wait = F.expr(f"INTERVAL '{s.max_future_s + s.close_delay_ms // 1000 + 3}' SECOND")
    # an empty mrid and not null: a filter that a join implies would take the row before its time is seen
    ends = df.agg(F.lit("").alias("mrid"), (F.max("received_at") + wait).alias("received_at"), (F.max("arrival_seq") + 1).alias("arrival_seq"))
    return df.unionByName(ends.where(F.col("received_at").isNotNull()), allowMissingColumns=True)


def publish_lfr(output: str, mrid: str, s: lfr.Settings) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: keep the batch's cells and refusals (``output``/cells, by batch), classify
    the closed cells, choose the frequency, and append what the outbox has not sent (``output``/sent)."""

    def publish(found: DataFrame, batch: int) -> None:
        spark = found.sparkSession
        path = f"{output}/cells/batch={batch}"
        found.write.mode("overwrite").parquet(path)
        cells = spark.read.schema(CELL).parquet(path).where(F.col("refused").isNull())
        pending = lfr.publications(lfr.preferred_frequency(lfr.classify_pmu(cells, s), s), mrid, s)
        sent = _stored(spark, f"{output}/sent", "publication_id string")
        lfr.outbox(pending, sent).write.mode("append").parquet(f"{output}/sent")

    return publish


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that the first batch has yet to write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


NO_METADATA = "array<struct<key: string, value: string>>"
EVIDENCE = (
    "session_id string, request_sha256 string, status string, blob_id string, mrids array<string>, coverage array<struct<mrid: string, n: bigint>>, "
    "measurement_count bigint, rejection_reason string, metadata array<struct<key: string, value: string>>, "
    "object struct<bucket: string, object_key: string, media_type: string, version: int, byte_length: bigint, sha256: string>, path string, "
    "started_at timestamp_ntz, ended_at timestamp_ntz, requested_at timestamp_ntz, finalized_at timestamp_ntz"
)


def _written_once(df: DataFrame, path: str) -> DataFrame:
    """What an earlier attempt has written in full, or else the table, written now."""
    spark = df.sparkSession
    if not storage.is_complete(spark, path):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def extract_sessions(live: DataFrame, output: str, max_rows: int = sessions.MAX_ROWS, max_bytes: int = sessions.MAX_OBJECT, bucket: str = sessions.BUCKET) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: validate requests, extract the accepted ones, and write
    per batch artifacts, evidence, what is to be published, and conflicts.

    The live store is read once: a batch's rows are stored before anything else, and
    coverage and artifacts are made of what was stored, so that a store that grows
    meanwhile cannot make them differ. All of a batch's output lies in folders of its number and
    is written anew if the batch is done again, from the same stored rows.

    A session of more than ``max_rows`` rows or ``max_bytes`` bytes is FAILED: it has no artifact
    (a file that turned out too large is removed), and its next request is a new
    attempt. A request of a session that has been finished or rejected is a replay if its digest
    is the same, and its evidence is published again as it was; otherwise it is a
    conflict. Of several in one batch the first asked for counts.
    """

    def extract(requests: DataFrame, batch: int) -> None:
        spark = requests.sparkSession
        full = requests if "metadata" in requests.columns else requests.withColumn("metadata", F.lit(None).cast(NO_METADATA))
        asked = full.withColumn("request_sha256", sessions.request_digest()).dropDuplicates(["session_id", "request_sha256"])
        first = asked.groupBy("session_id").agg(F.min_by("request_sha256", F.struct("requested_at", "request_sha256")).alias("_first"))
        known = _stored(spark, f"{output}/evidence", f"{EVIDENCE}, batch int").where((F.col("batch") < batch) & (F.col("status") != "FAILED")).drop("batch")
        held = known.select("session_id", F.col("request_sha256").alias("_held"))
        # stored, as the coverage below: every step that follows reads them, and would deal and join them anew
        marked = storage.frozen(sessions.validate_requests(asked.join(first, "session_id").join(held, "session_id", "left")), "checked-requests")
        clash = marked.where(F.coalesce("_held", "_first") != F.col("request_sha256"))
        clash.select("session_id", "request_sha256", F.coalesce("_held", "_first").alias("held_sha256")).write.mode("overwrite").parquet(f"{output}/conflicts/batch={batch}")

        new = marked.where(F.col("_held").isNull() & (F.col("request_sha256") == F.col("_first"))).drop("_held", "_first")
        accepted = new.where("verdict = 'accepted'")
        found = sessions.session_join(live, accepted.select("session_id", "started_at", "ended_at", "mrids"))
        rows = _written_once(found.withColumn("blob_id", sessions.blob_id()), f"{output}/rows/batch={batch}")
        coverage = F.array_sort(F.collect_list(F.struct("mrid", "n")))  # a request has at most 32 signals
        per = aggregate.session_coverage(rows, accepted).groupBy("session_id").agg(coverage.alias("coverage"), F.first("status").alias("_status"), F.first("total").alias("_total"))
        cover = storage.frozen(per, "session-coverage")

        path = f"{output}/artifacts/batch={batch}"
        files = storage.write_session_artifacts(rows.join(cover.where(F.col("_total") > max_rows), "session_id", "left_anti"), path, again=True, flat=True)
        files = files.unionByName(storage.write_empty_artifacts(cover.where("_total = 0"), path, flat=True))
        facts = storage.frozen(storage.file_facts(spark, files).join(files.select("path", "session_id"), "path"), "artifact-facts")
        everything = new.where("verdict <> 'quarantine'").join(cover, "session_id", "left").join(facts, "session_id", "left")
        evidence = _evidence(everything, max_rows, max_bytes, bucket)
        evidence.write.mode("overwrite").parquet(f"{output}/evidence/batch={batch}")
        own = spark.read.schema(EVIDENCE).parquet(f"{output}/evidence/batch={batch}")
        storage.remove_files(facts.where(F.col("byte_length") > max_bytes).select("path"))

        again = marked.where(F.col("_held") == F.col("request_sha256")).select("session_id").distinct()
        out = own.where("status <> 'FAILED'").unionByName(known.join(again, "session_id", "left_semi"))
        out.write.mode("overwrite").parquet(f"{output}/published/batch={batch}")

    return extract


def _evidence(requests: DataFrame, max_rows: int, max_bytes: int, bucket: str) -> DataFrame:
    """Evidence rows of validated requests with their coverage and the facts of their files."""
    rejected = F.col("verdict") == "rejected"
    many, large = F.col("_total") > max_rows, F.coalesce(F.col("byte_length") > max_bytes, F.lit(False))
    done = (F.col("verdict") == "accepted") & ~many & ~large
    obj = F.struct(
        F.lit(bucket).alias("bucket"), sessions.object_key().alias("object_key"), F.lit(sessions.MEDIA_TYPE).alias("media_type"),
        F.lit(sessions.VERSION).alias("version"), "byte_length", "sha256",
    )
    why = F.when(rejected, F.substring(F.array_join("reasons", ","), 1, 1024)).when(many, "too_many_rows").when(large, "artifact_too_large")
    return requests.select(
        "session_id", "request_sha256", F.when(rejected, "REJECTED").when(done, F.col("_status")).otherwise("FAILED").alias("status"),
        F.when(rejected, sessions.rejected_id()).otherwise(sessions.blob_id()).alias("blob_id"),
        F.when(done, F.col("mrids")).alias("mrids"), F.when(done, F.col("coverage")).alias("coverage"),
        F.when(done, F.col("_total")).otherwise(0).cast("long").alias("measurement_count"), why.alias("rejection_reason"),
        F.when(done, F.col("metadata")).alias("metadata"), F.when(done, obj).alias("object"), F.when(done, F.col("path")).alias("path"),
        "started_at", "ended_at", "requested_at", F.greatest("requested_at", F.current_timestamp().cast("timestamp_ntz")).alias("finalized_at"),
    )


def run_to_end(df: DataFrame, output: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Work off what is there and stop: append to a table, or hand batches over."""
    writer = df.writeStream.outputMode("append").option("checkpointLocation", f"{output}-checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(output)
    query.awaitTermination()


def replayed(spark: SparkSession, df: DataFrame, name: str, order: str | None = None, files: int = 32) -> DataFrame:
    """A stored table as a stream of its files, ``files`` of them in a micro-batch.

    With ``order`` the files hold ranges of that column and are read in its
    order, so keyed state may go on from one micro-batch to the next; a file
    has at most 100,000 rows.
    """
    path = storage.scratch(spark, name)
    if order is None:
        df.write.parquet(path)
        return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, order).sortWithinPartitions(order).write.option("maxRecordsPerFile", 100_000).parquet(path)
    storage.date_in_order(spark, path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)
