"""Threshold alarms, capture episodes and change logs as batch jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstream.functions import running
from gridstream.functions.columns import EPISODE_NAMESPACE, SESSION_NAMESPACE, alarm_key, canonical_json, exact_time, finite, summary, uuid5
from gridstream.functions.running import with_running
from gridstream.operators.qualify import match_few, match_mrid_glob, quality_ok
from gridstream.sources.storage import frozen

COMPARE = {
    "gt": (lambda v, t: v > t, "greater than"),
    "ge": (lambda v, t: v >= t, "at least"),
    "lt": (lambda v, t: v < t, "less than"),
    "le": (lambda v, t: v <= t, "at most"),
}


def membership_intervals(log: DataFrame, key: str = "source", order: str = "arrival_seq", width: int | None = None) -> DataFrame:
    """Change log to validity intervals [from, to) of the keys that are present. The log is
    worked off in buckets of ``width``, so no key's whole log is in one task."""
    ends = with_running(log, [key], order, width, valid_to=("first_after", F.col(order)))
    return ends.where(F.col("value").isNotNull()).select(key, "value", F.col(order).alias("valid_from"), "valid_to")


def membership_join(df: DataFrame, intervals: DataFrame, key: str = "source", order: str = "arrival_seq") -> DataFrame:
    """Rows with the membership that held when they arrived: equal key, order inside the interval.

    At most one interval matches a row, so each side is merged into one ordered
    stream per key and the newest interval start is carried forward, from one
    bucket of arrivals to the next; no pairs of rows and intervals are formed.
    """
    columns = [c for c in df.columns]
    starts = intervals.select(F.col(key), F.col("valid_from").alias("_o"), F.lit(0).alias("_side"), F.struct("value", "valid_from", "valid_to").alias("_m"), F.lit(None).cast(df.select(F.struct(*columns)).schema[0].dataType).alias("_r"))
    rows = df.select(F.col(key), F.col(order).alias("_o"), F.lit(1).alias("_side"), F.lit(None).cast(starts.schema["_m"].dataType).alias("_m"), F.struct(*columns).alias("_r"))
    both = with_running(starts.unionByName(rows).withColumn("_turn", 2 * F.col("_o") + F.col("_side")), [key], "_turn", _member=("last", F.col("_m"))).drop("_m").withColumnRenamed("_member", "_m")
    inside = F.col("_m").isNotNull() & (F.col("_m.valid_to").isNull() | (F.col("_o") < F.col("_m.valid_to")))
    return both.where((F.col("_side") == 1) & inside).select("_r.*", F.col("_m.value").alias("member_value"), F.col("_m.valid_from").alias("member_from"))


def membership_changes(log: DataFrame, key: str = "source", order: str = "arrival_seq", width: int | None = None) -> DataFrame:
    """Additions and removals: rows of the log where presence changes."""
    now = F.col("value").isNotNull()
    was = F.coalesce("_was", F.lit(False))
    change = F.when(now & ~was, "added").when(~now & was, "removed")
    rows = with_running(log, [key], order, width, _was=("last_before", now))
    return rows.withColumn("change", change).where(F.col("change").isNotNull()).select(key, order, "change")


def member_events(log: DataFrame, signals: Column, order: str = "arrival_seq") -> DataFrame:
    """Additions and removals of signals (mrid, order, present): where the presence of
    their source in a change log changes. ``signals`` lists the mrids of a ``source``."""
    return membership_changes(log, "source", order).select(F.explode(signals).alias("mrid"), order, (F.col("change") == "added").alias("present"))


def union_events(*logs: DataFrame) -> DataFrame:
    """Logs of different shapes as one, absent columns null."""
    out = logs[0]
    for other in logs[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def alarm_observations(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Qualified rows of every rule they match."""
    ok = quality_ok("strict") & (F.col("value_type") == "double") & finite(F.col("double_value")) & F.col("kafka_key").eqNullSafe(F.col("mrid"))
    fresh = F.col("received_at") - F.col("timestamp_mccs") <= F.expr("INTERVAL '30' SECOND")
    return match_mrid_glob(df.where(ok & F.col("timestamp_mccs").isNotNull() & fresh), rules)


OBSERVED = ["rule", "severity", "mrid", "arrival_seq", "timestamp_mccs", "received_at", "double_value", "threshold", "topic", "partition", "offset"]


def _alarm_events(observations: DataFrame, changes: DataFrame | None, compare: str, width: int | None) -> DataFrame:
    """Observations and changes of membership (``present``) as one log, cut into buckets
    of arrivals. A change comes before the observations of its place."""
    beyond, _ = COMPARE[compare]
    seen = observations.select(*OBSERVED, exact_time(observations).alias("at"), beyond(F.col("double_value"), F.col("threshold")).alias("beyond"), F.lit(None).cast("boolean").alias("present"))
    events = seen if changes is None else union_events(seen, changes.select("rule", "mrid", "arrival_seq", "present"))
    turn = 2 * F.col("arrival_seq") + F.when(F.col("present").isNull(), 1).otherwise(0)
    return events.withColumn("_turn", turn).withColumn("_bucket", F.floor(F.col("arrival_seq") / (width or running.WIDTH)))


_KEY = ["rule", "mrid"]


def _alarm_handed_on(events: DataFrame, bound: bool) -> DataFrame:
    """Per key and bucket the state in which it begins: ``member_in``, ``newest_in`` (time of
    the newest counted row) and ``active_in``.

    What a bucket does to the state is summed up in one row: the last change of
    membership, and, for a key that enters it as a member and as none, the newest row of
    a member and whether that one is beyond the threshold. That newest row decides: it is
    counted if it is newer than all before, then it is the bucket's last counted row, and
    the alarm is as it says unless a removal follows. Without one the state stays, after a
    removal the alarm has ended. So the states follow from one ordered pass over the sums.
    """
    inside = Window.partitionBy(*_KEY, "_bucket").orderBy("_turn", "present").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = F.coalesce(~F.col("present"), F.lit(False)).cast("int")
    rows = events.select(*_KEY, "_bucket", "_turn", "present", "at", "beyond", F.last("present", ignorenulls=True).over(inside).alias("_known"), F.sum(gone).over(inside).alias("_gone"))
    sums = [F.max_by("present", F.when(F.col("present").isNotNull(), F.col("_turn"))).alias("member_out"), F.max("_gone").alias("_removals")]
    for name, at_first in (("in", True), ("out", False)):
        own = F.col("present").isNull() & (F.coalesce("_known", F.lit(at_first)) if bound else F.lit(True))
        first = F.when(own, F.struct("at", -F.col("_turn")))  # of equal times the first
        sums.append(F.max_by(F.struct("at", "beyond", "_gone"), first).alias(f"_{name}"))
    past = Window.partitionBy(*_KEY).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.groupBy(*_KEY, "_bucket").agg(*sums).withColumn("member_in", F.coalesce(F.last("member_out", ignorenulls=True).over(past), F.lit(not bound)))
    timed = summed.withColumn("_top", F.when(F.col("member_in"), F.col("_in")).otherwise(F.col("_out"))).withColumn("newest_in", F.max("_top.at").over(past))
    counted = F.col("_top").isNotNull() & (F.col("newest_in").isNull() | (F.col("_top.at") > F.col("newest_in")))
    state = F.when(F.col("_removals") > 0, counted & F.coalesce(F.col("_top.beyond") & (F.col("_top._gone") == F.col("_removals")), F.lit(False))).otherwise(F.when(counted, F.col("_top.beyond")))
    return timed.withColumn("_state", state).select(*_KEY, "_bucket", "member_in", "newest_in", F.coalesce(F.last("_state", ignorenulls=True).over(past), F.lit(False)).alias("active_in"))


def _alarm_actions(events: DataFrame, bound: bool) -> DataFrame:
    """Rows with an action, each bucket by itself from the state in which it begins. ``_run`` is
    the activation to which a row belongs, null if that lies in an earlier bucket."""
    inside = Window.partitionBy(*_KEY, "_bucket").orderBy("_turn", "present")
    now, past = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow), inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.join(_alarm_handed_on(events, bound), [*_KEY, "_bucket"])
    member = F.coalesce(F.last("present", ignorenulls=True).over(now), F.col("member_in")) if bound else F.lit(True)
    rows = rows.withColumn("_at", F.when(F.col("present").isNull() & member, F.col("at")))
    seen = F.greatest(F.max("_at").over(past), F.col("newest_in"))
    rows = rows.withColumn("_seen", seen).withColumn("_counted", F.col("_at").isNotNull() & (F.col("_seen").isNull() | (F.col("_at") > F.col("_seen"))))
    gone = F.coalesce(~F.col("present"), F.lit(False))
    rows = rows.withColumn("above", F.when(F.col("_counted"), F.col("beyond")).when(gone, F.lit(False)))
    rows = rows.withColumn("_was", F.coalesce(F.last("above", ignorenulls=True).over(past), F.col("active_in")))
    action = F.when(F.col("above") & ~F.col("_was"), "activate").when(F.col("above"), "refresh").when(F.col("_was") & ~F.col("above"), "clear").when(F.col("_counted"), "evaluate")
    acted = rows.withColumn("action", action).where(F.col("action").isNotNull()).withColumn("alarm_key", alarm_key(F.col("rule"), F.col("mrid")))
    ident = uuid5(EPISODE_NAMESPACE, canonical_json(F.col("alarm_key"), F.col("topic"), F.col("partition"), F.col("offset")))
    opened = F.when(F.col("action") == "activate", F.struct(ident.alias("episode_id"), F.col("timestamp_mccs").alias("activated_at")))
    kept = ["alarm_key", *OBSERVED[:8], "action", "above", "_turn", "_bucket"]
    return acted.withColumn("_opened", opened).select(*kept, F.last("_opened", ignorenulls=True).over(now).alias("_run"))


def _transitions(observations: DataFrame, changes: DataFrame | None, bound: bool, compare: str, width: int | None) -> DataFrame:
    _, words = COMPARE[compare]
    acted = frozen(_alarm_actions(_alarm_events(observations, changes, compare, width), bound), "alarm-actions")
    # alarms that go on from one bucket to the next: the last activation before
    past = Window.partitionBy(*_KEY).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = acted.groupBy(*_KEY, "_bucket").agg(F.max_by("_run", F.when(F.col("_run").isNotNull(), F.col("_turn"))).alias("_last"))
    before = last.select(*_KEY, "_bucket", F.last("_last", ignorenulls=True).over(past).alias("_before"))
    open_before = F.col("_run").isNull() & (F.col("action") != "evaluate")
    going_on = acted.where(open_before).join(before.where(F.col("_before").isNotNull()), [*_KEY, "_bucket"]).withColumn("_run", F.col("_before")).drop("_before")
    out = acted.where(~open_before).unionByName(going_on).withColumn("_e", F.when(F.col("action") != "evaluate", F.col("_run")))
    text = F.when(F.col("above"), summary(F.col("double_value"), F.col("threshold"), words))
    return out.select("alarm_key", *OBSERVED[:8], "action", "_e.episode_id", "_e.activated_at", text.alias("summary"))


def alarm_transitions(observations: DataFrame, removals: DataFrame | None = None, compare: str = "gt", width: int | None = None) -> DataFrame:
    """Per rule and mrid the accepted rows with ``action``: activate, refresh, clear
    or evaluate; episode id, activation time and evidence text.

    A row counts only if newer (to the nanosecond, where rows have it) than every earlier counted row of its key. A
    removal (rule, mrid, arrival_seq) ends an active alarm and keeps the
    watermark. Work is spread over keys and buckets of ``width`` arrivals, which changes no
    result: a summary of each bucket, one pass over the summaries, one pass over
    the rows, whose result is stored once.
    """
    changes = None if removals is None else removals.withColumn("present", F.lit(False))
    return _transitions(observations, changes, False, compare, width)


def member_transitions(observations: DataFrame, members: DataFrame, rules: DataFrame, compare: str = "gt", width: int | None = None) -> DataFrame:
    """``alarm_transitions`` of signals while they are members; a removal ends an
    active alarm. members: mrid, arrival_seq, present (see ``member_events``)."""
    changes = match_few(members.select("mrid", "arrival_seq", "present"), rules)
    return _transitions(observations, changes, True, compare, width)


def stale_alarms(current: DataFrame, members: DataFrame) -> DataFrame:
    """Active alarms of signals that are no members when the work begins; they are to be cleared."""
    return current.join(members.select("mrid"), "mrid", "left_anti")


def alarm_current(transitions: DataFrame) -> DataFrame:
    """Active alarms after all changes, with the watermark of their key."""
    last = transitions.groupBy("alarm_key").agg(
        F.max_by(F.struct("rule", "mrid", "action", "episode_id", "activated_at", "double_value", "timestamp_mccs", "summary"), "arrival_seq").alias("r"), F.max("timestamp_mccs").alias("watermark")
    )
    return last.where(F.col("r.action").isin("activate", "refresh")).select("alarm_key", "r.rule", "r.mrid", "r.episode_id", "r.activated_at", "r.double_value", F.greatest("watermark", "r.timestamp_mccs").alias("watermark"))


def alarm_replay(df: DataFrame, rules: DataFrame, compare: str = "gt", members: DataFrame | None = None) -> DataFrame:
    """Historical reconstruction: every row is evaluated when the topic received it, with
    the membership of that time; no notification follows."""
    seen = alarm_observations(df.withColumn("received_at", F.col("kafka_ts")), rules)
    return alarm_transitions(seen, compare=compare) if members is None else member_transitions(seen, members, rules, compare)


def first_notifications(transitions: DataFrame) -> DataFrame:
    """One row per new episode: its first activation."""
    first = F.min_by(F.struct("rule", "mrid", "arrival_seq", "timestamp_mccs", "double_value"), "arrival_seq")
    return transitions.where(F.col("action") == "activate").groupBy("episode_id").agg(first.alias("r")).select("episode_id", "r.*")


def capture_episodes(df: DataFrame, policies: DataFrame, pad_s: int = 10, longest_h: int = 24) -> DataFrame:
    """Closed episodes above a policy's threshold, as session requests.

    policies: mrid, threshold, mrids (what to capture). Strictly above opens, at
    or below closes; [start, end) is padded on both sides; episodes whose
    padded length exceeds ``longest_h`` hours have ``dropped`` set; an episode
    still open at the end gives no row.
    """
    ok = quality_ok("strict") & (F.col("value_type") == "double") & finite(F.col("double_value")) & F.col("kafka_key").eqNullSafe(F.col("mrid")) & F.col("timestamp_mccs").isNotNull()
    rows = df.where(ok).join(policies, "mrid")
    narrow = rows.select("mrid", "arrival_seq", "timestamp_mccs", exact_time(rows).alias("at"), "double_value", "threshold", "mrids")
    newer = with_running(narrow, ["mrid"], "arrival_seq", _seen=("max_before", F.col("at")))
    kept = frozen(newer.where(F.col("_seen").isNull() | (F.col("at") > F.col("_seen"))).drop("_seen", "at"), "capture-rows")
    marked = with_running(kept.withColumn("above", F.col("double_value") > F.col("threshold")), ["mrid"], "arrival_seq", _was=("last_before", F.col("above"))).withColumn("_was", F.coalesce("_was", F.lit(False)))
    changed = marked.where(F.col("above") != F.col("_was"))
    ended = with_running(changed, ["mrid"], "arrival_seq", onset=("last_before", F.when(F.col("above"), F.col("timestamp_mccs")))).where(~F.col("above"))
    pad = F.expr(f"INTERVAL '{pad_s}' SECOND")
    out = ended.select("mrid", "arrival_seq", "onset", F.col("timestamp_mccs").alias("cleared_at"), (F.col("onset") - pad).alias("started_at"), (F.col("timestamp_mccs") + pad).alias("ended_at"), F.col("timestamp_mccs").alias("requested_at"), "mrids")
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    ident = uuid5(SESSION_NAMESPACE, canonical_json(F.col("mrid"), text("onset"), text("cleared_at")))
    return out.withColumn("session_id", ident).withColumn("dropped", F.col("ended_at") - F.col("started_at") > F.expr(f"INTERVAL '{longest_h}' HOUR"))


def latest_values_join(df: DataFrame, inputs: DataFrame, calculation: Column, names: list[str], max_age_s: float | None = 5.0, ts: str = "received_at") -> DataFrame:
    """Join of the newest value of every input of a group, on each arrival.

    inputs: mrid, group, input. ``calculation`` uses the columns ``names``. Emits
    when all inputs of the group are known and none is older than the newest
    by more than ``max_age_s``; results that are not finite are suppressed.
    Exact for a clock that does not run backwards; the stateful form covers the rest.
    """
    rows = df.join(inputs, "mrid")
    newest_of = {f"_{n}": ("last", F.when(F.col("input") == n, F.struct(F.col("double_value").alias("v"), F.col(ts).alias("t")))) for n in names}
    rows = with_running(rows, ["group"], "arrival_seq", **newest_of)
    known = F.lit(True)
    for n in names:
        known = known & F.col(f"_{n}").isNotNull()
    newest = F.greatest(*[F.col(f"_{n}.t") for n in names])
    full = rows.where(known).withColumn("newest", newest)
    if max_age_s is not None:
        for n in names:
            full = full.where(F.col("newest") - F.col(f"_{n}.t") <= F.expr(f"INTERVAL '{max_age_s}' SECOND"))
    for n in names:
        full = full.withColumn(n, F.col(f"_{n}.v"))
    out = full.withColumn("value", calculation).drop(*[f"_{n}" for n in names])
    return out.where(finite(F.col("value")))


def latest_values_audit(df: DataFrame, inputs: DataFrame, calculation: Column, names: list[str], max_age_s: float | None = 5.0, ts: str = "received_at") -> DataFrame:
    """Every arrival of a group's inputs with ``value`` or the ``reason`` why none is published.

    Takes all measurements, as ``latest_values_join`` takes qualified ones. Reasons, first one first:
    invalid_quality, scalar_mismatch (no double), non_finite_input, key_mismatch (each with ``:input``; such a row
    counts for nothing else), incomplete_group ``:group`` (an input never came), stale_input with the sorted inputs that are too
    old, until they come anew, result_not_numeric (the calculation gives null) and non_finite_result. Rows without
    a reason are those of the join. A null time counts as a value that is missing.
    """
    rows = df.join(inputs, "mrid")
    of = lambda reason: F.concat(F.lit(f"{reason}:"), "input")
    bad = (
        F.when(~quality_ok("explicit_valid"), of("invalid_quality"))
        .when(~F.col("value_type").eqNullSafe("double") | F.col("double_value").isNull(), of("scalar_mismatch"))
        .when(~finite(F.col("double_value")), of("non_finite_input"))
        .when(~F.col("kafka_key").eqNullSafe(F.col("mrid")), of("key_mismatch"))
    )
    rows = rows.withColumn("_bad", bad)
    counts = F.col("_bad").isNull() & F.col(ts).isNotNull()
    newest_of = {f"_{n}": ("last", F.when(counts & (F.col("input") == n), F.struct(F.col("double_value").alias("v"), F.col(ts).alias("t")))) for n in names}
    rows = with_running(rows, ["group"], "arrival_seq", **newest_of).withColumn("newest", F.greatest(*[F.col(f"_{n}.t") for n in names]))
    missing = F.lit(False)
    for n in names:
        missing = missing | F.col(f"_{n}").isNull()
    too_old = lambda n: F.col("newest") - F.col(f"_{n}.t") > F.expr(f"INTERVAL '{max_age_s}' SECOND")
    stale = F.array_compact(F.array(*[F.when(F.lit(False) if max_age_s is None else too_old(n), n) for n in sorted(names)]))
    before = F.coalesce("_bad", F.when(missing, F.concat(F.lit("incomplete_group:"), "group")), F.when(F.size(stale) > 0, F.concat(F.lit("stale_input:"), F.array_join(stale, ","))))
    for n in names:
        rows = rows.withColumn(n, F.col(f"_{n}.v"))
    result = rows.withColumn("_before", before).withColumn("value", F.when(F.col("_before").isNull(), calculation))
    after = F.when(F.col("value").isNull(), "result_not_numeric").when(~finite(F.col("value")), "non_finite_result")
    reason = F.coalesce("_before", after)
    return result.withColumn("reason", reason).withColumn("value", F.when(F.col("reason").isNull(), F.col("value"))).drop("_bad", "_before", *[f"_{n}" for n in names])


def pair_product(df: DataFrame, phases: DataFrame) -> DataFrame:
    """Apparent power per phase: newest valid voltage times newest valid current, on
    either arrival, with no age limit and no finite check. phases: mrid, group, input."""
    ok = df.where(quality_ok("explicit_valid") & F.col("double_value").isNotNull() & F.col("kafka_key").eqNullSafe(F.col("mrid")))
    rows = ok.join(phases, "mrid")
    last = lambda n: ("last", F.when(F.col("input") == n, F.col("double_value")))
    return with_running(rows, ["group"], "arrival_seq", voltage=last("voltage"), current=last("current")).where(F.col("voltage").isNotNull() & F.col("current").isNotNull()).withColumn("value", F.col("voltage") * F.col("current"))


def formula(df: DataFrame, source: str, target: str, calculation: Column) -> DataFrame:
    """Stateless derived value: one input, one output; times and quality are kept,
    results that are not finite are suppressed."""
    rows = df.where((F.col("mrid") == source) & F.col("kafka_key").eqNullSafe(F.col("mrid")) & F.col("double_value").isNotNull()).withColumn("double_value", calculation)
    return rows.where(finite(F.col("double_value"))).withColumn("mrid", F.lit(target)).withColumn("kafka_key", F.lit(target))


def reconcile_desired(desired: DataFrame, remote: DataFrame, owner: str) -> DataFrame:
    """Actions that bring the remote open alarms to the desired ones.

    desired: mrid, episode_id, severity. remote: event, resource, status, owner.
    Only own open or acknowledged rows count; a remote row matches on episode
    and resource. Unmatched remote rows are closed, all desired ones upserted.
    """
    own = remote.where((F.col("owner") == owner) & F.col("status").isin("open", "ack"))
    want = desired.select(F.col("episode_id").alias("event"), F.col("mrid").alias("resource"), "severity")
    close = own.join(want, ["event", "resource"], "left_anti").select("event", "resource", F.lit("close").alias("action"), F.lit(None).cast("string").alias("severity"))
    return close.unionByName(want.select("event", "resource", F.lit("upsert").alias("action"), "severity"))
