"""Column expressions: identifiers, keys, numbers and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstream.functions.intervals import micros

# Namespaces of identifiers.
EPISODE_NAMESPACE = "f5d55f94-655f-5460-a315-f56a8a891007"
SESSION_NAMESPACE = "8f3c89c2-0b2f-5a40-b6ed-7e22a1b24f63"
EXPORT_NAMESPACE = "f39fc794-f7e9-4d59-9c2a-5bb1d84af1b2"

UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def numeric_value() -> Column:
    """The value of double, int and uint measurements as a double."""
    return F.coalesce(F.col("double_value"), F.col("int_value").cast("double"), F.col("uint_value").cast("double"))


def finite(value: Column) -> Column:
    """Not null, not NaN, not infinite; never null itself."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), F.lit(False))


def exact_time(df: DataFrame, ts: str = "timestamp_mccs") -> Column:
    """struct<seconds, nanos> by which rows are ordered: the pair ``mccs_sec`` and ``mccs_nanos``
    where a row has it, else the timestamp, which is cut to microseconds; null without both."""
    us = micros(F.col(ts))
    part = F.pmod(us, F.lit(1_000_000))
    cut = F.struct(F.call_function("div", us - part, F.lit(1_000_000)).cast("long").alias("seconds"), (part * 1000).cast("int").alias("nanos"))
    known = F.when(F.col(ts).isNotNull(), cut)
    if ts != "timestamp_mccs" or not {"mccs_sec", "mccs_nanos"} <= set(df.columns):
        return known
    pair = F.struct(F.col("mccs_sec").cast("long").alias("seconds"), F.col("mccs_nanos").cast("int").alias("nanos"))
    return F.when(F.col("mccs_sec").isNotNull() & F.col("mccs_nanos").isNotNull(), pair).otherwise(known)


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5 UUID of a text name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def canonical_uuid(text: Column) -> Column:
    """Whether a text is a lower-case hyphenated UUID."""
    return F.coalesce(text.rlike(UUID), F.lit(False))


def base64url(text: Column) -> Column:
    """URL-safe base64 of the UTF-8 bytes, without padding."""
    plain = F.regexp_replace(F.base64(F.encode(text, "UTF-8")), r"[=\s]", "")
    return F.translate(plain, "+/", "-_")


def alarm_key(rule: Column, mrid: Column) -> Column:
    """``alarm/v1/<rule>/<mrid>`` with both parts encoded."""
    return F.concat(F.lit("alarm/v1/"), base64url(rule), F.lit("/"), base64url(mrid))


def alarm_key_parts(key: Column) -> Column:
    """struct<rule, mrid> of an alarm key; null unless encoding the parts again gives the key."""
    parts = F.split(key, "/")
    def text(k: int) -> Column:
        raw = F.translate(F.get(parts, F.lit(k)), "-_", "+/")
        full = F.concat(raw, F.repeat(F.lit("="), F.pmod(-F.length(raw), F.lit(4)).cast("int")))
        shape = full.rlike("^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")
        return F.when(shape, F.decode(F.unbase64(F.when(shape, full)), "UTF-8"))
    rule, mrid = text(2), text(3)
    return F.when((F.size(parts) == 4) & (alarm_key(rule, mrid) == key), F.struct(rule.alias("rule"), mrid.alias("mrid")))


def general15(value: Column) -> Column:
    """A number with up to 15 significant digits and no trailing zeros."""
    text = F.format_string("%.15g", value)
    return F.when(text.contains("e"), F.regexp_replace(text, r"\.?0+e", "e")).when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def summary(value: Column, threshold: Column, word: str = "greater than") -> Column:
    """The evidence sentence of an alarm."""
    return F.concat(F.lit("Frequency "), general15(value), F.lit(f" Hz is {word} threshold "), general15(threshold), F.lit(" Hz"))


def canonical_json(*columns: Column) -> Column:
    """Compact JSON array of the columns' texts, for identifiers and digests."""
    return F.to_json(F.array(*[c.cast("string") for c in columns]))


def digest(*columns: Column) -> Column:
    """SHA-256 of the canonical JSON, in hexadecimal."""
    return F.sha2(canonical_json(*columns), 256)


def reasons(**checks: Column) -> Column:
    """Array of the names whose condition holds, in the given order; null counts as false."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]), lambda x: x.isNotNull())


def selection_filename(mrids: Column, start_ms: Column, limit: int = 240) -> Column:
    """File name of a CSV selection: start second and sanitised mrids; too long a
    list is cut and marked with its size and a digest."""
    # years of five digits are written with a plus sign, which is no part of a name
    second = F.ltrim(F.date_format(F.timestamp_seconds(F.floor(start_ms / 1000)), "yyyy-MM-dd'T'HH-mm-ss'Z'"), F.lit("+"))
    prefix = F.concat(F.lit("measurement-session-"), second, F.lit("-"))
    def clean(m: Column) -> Column:
        kept = F.regexp_replace(F.regexp_replace(m, r"[^A-Za-z0-9\-_.]+", "-"), r"^[\-.]+|[\-.]+$", "")
        return F.when(kept == "", F.lit("mrid")).otherwise(kept)
    labels = F.array_join(F.transform(mrids, clean), "--")
    room = F.lit(limit) - F.length(prefix)
    mark = F.concat(F.lit("-selection-"), F.size(mrids).cast("string"), F.lit("-"), F.substring(F.sha2(F.array_join(mrids, "\0"), 256), 1, 12))
    cut = F.concat(F.regexp_replace(F.substring(labels, F.lit(1), room - F.length(mark)), r"-+$", ""), mark)
    return F.concat(prefix, F.when(F.length(labels) > room, cut).otherwise(labels), F.lit(".csv"))
