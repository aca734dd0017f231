"""Projections, predicates and qualification of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstream.functions.columns import exact_time, finite, reasons
from gridstream.functions.running import with_running
from gridstream.schema import FLAGS, QUALITY, VALUE_COLUMNS


def flatten_measurement(df: DataFrame, message: str = "message") -> DataFrame:
    """Nested message (ids, times, a one-of struct, optional quality struct) to
    flat typed columns; exactly the set alternative is non-null, absent flags stay null."""
    m = F.col(message)
    values = [m["value"][kind].alias(name) for kind, name in VALUE_COLUMNS.items()]
    kind = F.coalesce(*[F.when(m["value"][k].isNotNull(), F.lit(k)) for k in VALUE_COLUMNS])
    flags = [m["quality"][f].alias(q) for f, q in zip(FLAGS, QUALITY, strict=True)]
    rest = [F.col(c) for c in df.columns if c != message]
    return df.select(m["mrid"].alias("mrid"), *rest, *[m[t].alias(t) for t in ("timestamp_field", "timestamp_gateway", "timestamp_mccs")], kind.alias("value_type"), *values, *flags)


def parse_scalar_row(df: DataFrame) -> DataFrame:
    """Text-typed stored rows to typed rows, with ``reasons`` why a row is invalid.

    Needs an mrid, exactly one scalar, a non-negative unsigned value, flags
    that say true or false, and ISO times with a zone. Values of invalid rows
    are null where they cannot be read; keep rows with no reason, quarantine
    the others.
    """
    zone = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$"
    time = lambda c: F.when(F.col(c).rlike(zone), F.expr(f"try_cast({c} AS TIMESTAMP)").cast("timestamp_ntz"))
    flag = lambda c: F.when(F.lower(c) == "true", True).when(F.lower(c) == "false", False)
    number = lambda c: F.when(F.col(c).rlike(r"^[+-]?\d+$"), F.expr(f"try_cast({c} AS BIGINT)"))
    typed = {
        "double_value": F.expr("try_cast(double_value AS DOUBLE)"), "int_value": number("int_value"), "uint_value": number("uint_value"),
        "bool_value": flag("bool_value"), "string_value": F.col("string_value"), "timestamp_value": time("timestamp_value"),
        "timestamp_mccs": time("timestamp_mccs"), "timestamp_field": time("timestamp_field"), "timestamp_gateway": time("timestamp_gateway"),
    } | {q: flag(q) for q in QUALITY}
    present = sum((F.col(c).isNotNull().cast("int") for c in VALUE_COLUMNS.values()), F.lit(0))
    unread = lambda c: F.col(c).isNotNull() & typed[c].isNull()
    bad = reasons(
        no_mrid=F.coalesce(F.col("mrid"), F.lit("")) == "",
        not_one_scalar=present != 1,
        bad_value=unread("double_value") | unread("int_value") | unread("uint_value") | unread("bool_value") | unread("timestamp_value"),
        negative_uint=typed["uint_value"] < 0,
        bad_time=typed["timestamp_mccs"].isNull() | unread("timestamp_field") | unread("timestamp_gateway"),
        bad_flag=F.expr("false") if not QUALITY else F.coalesce(*[F.when(unread(q), True) for q in QUALITY], F.lit(False)),
    )
    kind = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(k)) for k, c in VALUE_COLUMNS.items()])
    rest = [F.col(c) for c in df.columns if c not in typed and c != "value_type"]
    return df.select(*rest, kind.alias("value_type"), *[v.alias(k) for k, v in typed.items()], bad.alias("reasons"))


def weather_to_measurements(df: DataFrame) -> DataFrame:
    """Wide readings (site, ts, temperature, wind_speed, wind_direction) to one
    valid measurement for each finite value."""
    wide = ["temperature", "wind_speed", "wind_direction"]
    pairs = F.inline(F.array(*[F.struct(F.lit(w).alias("quantity"), F.col(w).cast("double").alias("double_value")) for w in wide]))
    tall = df.select("site", "ts", pairs).where(finite(F.col("double_value")))
    return tall.select(
        F.concat(F.lit("urn:weather:"), "site", F.lit(":"), "quantity").alias("mrid"), F.col("ts").alias("timestamp_mccs"), F.lit("double").alias("value_type"), "double_value", F.lit(True).alias("quality_valid")
    )


def compact(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Latest record per key without tombstones (null values). The order must be total."""
    latest = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.groupBy(F.col(key).alias("_k")).agg(latest).select("r.*").where(F.col(value).isNotNull())


def qualify_key(df: DataFrame) -> DataFrame:
    """Rows whose record key is their mrid."""
    return df.where(F.col("kafka_key").eqNullSafe(F.col("mrid")))


def quality_ok(profile: str = "strict") -> Column:
    """``any``; ``explicit_valid``: flag set; ``strict``: and no other flag set."""
    ok = {"any": F.lit(True), "explicit_valid": F.coalesce("quality_valid", F.lit(False))}
    if profile in ok:
        return ok[profile]
    if profile != "strict":
        raise ValueError(f"unknown profile {profile!r}")
    result = ok["explicit_valid"]
    for q in QUALITY[1:]:
        result = result & ~F.coalesce(q, F.lit(False))
    return result


def qualify_quality(df: DataFrame, profile: str = "strict") -> DataFrame:
    return df.where(quality_ok(profile))


def qualify_double(df: DataFrame) -> DataFrame:
    """Rows whose value is the double alternative and finite."""
    return df.where((F.col("value_type") == "double") & finite(F.col("double_value")))


def freshness_filter(df: DataFrame, max_age_s: float = 30, now: str = "received_at") -> DataFrame:
    """Drop rows older than the limit at their evaluation time; future rows pass."""
    return df.where(F.col(now) - F.col("timestamp_mccs") <= F.expr(f"INTERVAL '{max_age_s}' SECOND"))


def newer_only(df: DataFrame, keys: list[str], ts: str = "timestamp_mccs", order: str = "arrival_seq") -> DataFrame:
    """Rows strictly newer, to the nanosecond where rows have it, than every earlier row
    of their key. Rows without a time go."""
    timed = df.withColumn("_at", exact_time(df, ts)).where(F.col("_at").isNotNull())
    seen = with_running(timed, keys, order, _seen=("max_before", F.col("_at")))
    return seen.where(F.col("_seen").isNull() | (F.col("_at") > F.col("_seen"))).drop("_seen", "_at")


def glob_regex(glob: Column) -> Column:
    """Anchored pattern of a colon-separated glob; * is one whole non-empty segment."""
    def segment(s: Column) -> Column:
        return F.when(s == "*", F.lit("[^:]+")).otherwise(F.concat(F.lit("\\Q"), s, F.lit("\\E")))
    return F.concat(F.lit("^"), F.array_join(F.transform(F.split(glob, ":"), segment), ":"), F.lit("$"))


def match_few(df: DataFrame, rules: DataFrame) -> DataFrame:
    """The same as ``match_mrid_glob`` for tables of few rows for each mrid: every row is compared, segment by segment.

    Rules are configuration and go to every task. Left to itself, Spark joins on the number of segments
    in one task: it holds a side for unfit to be sent whose rows all have one key.
    """
    parts = df.withColumn("_s", F.split("mrid", ":")).withColumn("_n", F.size("_s"))
    patterns = rules.withColumn("_g", F.split("glob", ":")).withColumn("_n", F.size("_g"))
    fits = F.zip_with("_g", "_s", lambda g, x: F.when(g == "*", x != "").otherwise(g == x))
    return parts.join(F.broadcast(patterns), "_n").where(F.forall(fits, lambda ok: ok)).drop("_n", "_s", "_g")


def match_mrid_glob(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows with every rule whose glob matches their mrid.

    Only distinct mrids are compared with rules, on an equal number of
    segments; the matches then join the rows on the mrid.
    """
    size = lambda c: F.size(F.split(c, ":"))
    signals = df.select("mrid").where(F.col("mrid").isNotNull()).distinct().withColumn("_n", size("mrid"))
    patterns = rules.withColumn("_n", size("glob")).withColumn("_p", glob_regex(F.col("glob")))
    matched = signals.join(F.broadcast(patterns), "_n").where(F.expr("mrid RLIKE _p")).drop("_n", "_p")
    return df.join(matched, "mrid")


def select_signals(df: DataFrame, mrids: list[str], start: Column, end: Column, bounds: str = "half_open") -> DataFrame:
    """Rows of the signals in a time range: ``half_open`` or ``closed``."""
    ts = F.col("timestamp_mccs")
    return df.where(F.col("mrid").isin(mrids) & (ts >= start) & ((ts < end) if bounds == "half_open" else (ts <= end)))


def label_signals(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Add the label columns of each known mrid; others are left out."""
    return df.join(labels, "mrid")


def rejection_reasons(low: float, high: float) -> Column:
    """All reasons against an LFR frequency sample, in a fixed order of names."""
    value, flag = F.col("double_value"), lambda c: F.coalesce(c, F.lit(False))
    return F.array_sort(
        reasons(
            missing_status=F.col("quality_valid").isNull(),
            invalid_status=~F.col("quality_valid"),
            substituted=flag("quality_substituted"),
            operator_blocked=flag("quality_operator_blocked"),
            overflow=flag("quality_overflow"),
            old_data=flag("quality_old_data"),
            non_finite_value=~finite(value),
            out_of_band=finite(value) & ((value < low) | (value > high)),
        )
    )


def flag_rejections(df: DataFrame, low: float, high: float) -> DataFrame:
    """Add ``reasons``: every reason that applies, not just the first."""
    return df.withColumn("reasons", rejection_reasons(low, high))


def stat_quality(stat: Column, variant: str = "gateway") -> Column:
    """struct<valid, substituted> of a 16-bit status word.

    ``gateway``: valid when the word is 0, substituted by bit 9. ``onboarding``:
    valid when bits 15-14 are 0 and bit 13 is clear; substituted when bits 15-14 are 2.
    """
    top = F.shiftright(stat, 14).bitwiseAND(F.lit(3))
    if variant == "gateway":
        return F.struct((stat == 0).alias("valid"), (stat.bitwiseAND(F.lit(1 << 9)) != 0).alias("substituted"))
    return F.struct(((top == 0) & (stat.bitwiseAND(F.lit(1 << 13)) == 0)).alias("valid"), (top == 2).alias("substituted"))


def normalize_frames(frames: DataFrame, signals: DataFrame, variant: str = "gateway", ahead_us: int = 250_000) -> DataFrame:
    """Decoded frames to one row per catalogued signal.

    Frames: source_id, soc, fracsec, time_base, stat, gateway_us, frequency, rocof,
    phasors (map of channel to value). Signals: source_id, mrid, selector
    (``frequency``, ``rocof`` or ``phasor``), channel. Field time is
    soc + floor(fracsec * 1e9 / time_base) ns, cut to microseconds. ``reasons``
    says why a row is to be quarantined: a missing channel; for ``onboarding``
    a value that is not finite or a field time after the gateway's; for
    ``gateway`` a field time more than ``ahead_us`` ahead.
    """
    nanos = F.floor(F.col("fracsec").cast("decimal(38,0)") * F.lit(1_000_000_000).cast("decimal(20,0)") / F.col("time_base").cast("decimal(20,0)"))
    joined = frames.join(signals, "source_id")
    value = F.when(F.col("selector") == "frequency", F.col("frequency")).when(F.col("selector") == "rocof", F.col("rocof")).otherwise(F.try_element_at("phasors", F.col("channel")))
    field = F.col("soc") * 1_000_000 + F.floor(nanos / 1000).cast("long")
    quality = stat_quality(F.col("stat"), variant)
    rows = joined.withColumn("double_value", value).withColumn("field_us", field).withColumn("_q", quality)
    if variant == "gateway":
        bad = reasons(no_channel=F.col("double_value").isNull(), field_ahead=F.col("field_us") > F.col("gateway_us") + ahead_us)
    else:
        bad = reasons(no_channel=F.col("double_value").isNull(), non_finite=F.col("double_value").isNotNull() & ~finite(F.col("double_value")), field_ahead=F.col("field_us") > F.col("gateway_us"))
    return rows.select("source_id", "mrid", "field_us", "gateway_us", F.col("gateway_us").alias("mccs_us"), "double_value", F.col("_q.valid").alias("quality_valid"), F.col("_q.substituted").alias("quality_substituted"), bad.alias("reasons"))


def verify_measurements(df: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row per catalogued mrid: rows seen, well-formed rows, and whether it is missing.

    Well-formed: key equals mrid, finite double, explicitly valid, three times
    in order (an absent gateway time counts as the mccs time).
    """
    gateway = F.coalesce("timestamp_gateway", "timestamp_mccs")
    good = F.col("kafka_key").eqNullSafe(F.col("mrid")) & (F.col("value_type") == "double") & finite(F.col("double_value")) & quality_ok("explicit_valid") & (F.col("timestamp_field") <= gateway) & (gateway <= F.col("timestamp_mccs"))
    per = df.groupBy("mrid").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.coalesce(good, F.lit(False))).alias("well_formed"))
    out = catalog.select("mrid").distinct().join(per, "mrid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("mrid", zero("seen"), zero("well_formed"), F.col("seen").isNull().alias("missing"))
