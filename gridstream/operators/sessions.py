"""Bounded sessions: extraction, evidence, catalogue and ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstream.functions.columns import canonical_uuid, reasons
from gridstream.functions.intervals import interval_join, micros

MAX_MRIDS, MAX_HOURS, MAX_METADATA, MAX_TEXT = 32, 24, 32, 256
MAX_ROWS = 5_000_000
# What the contract accepts as metadata keys and as object keys.
METADATA_KEY = "^[A-Za-z][A-Za-z0-9_.-]{0,63}$"
OBJECT_KEY = "^[A-Za-z0-9][A-Za-z0-9._/-]{0,511}$"
BUCKET = "measurement-sessions"
MEDIA_TYPE = "application/vnd.apache.parquet"
VERSION = 2
MAX_OBJECT = 4 << 30
MAX_EVIDENCE = 32 << 10  # bytes


def sorted_unique(items: Column) -> Column:
    """Whether an array is strictly ascending."""
    return (F.array_sort(F.array_distinct(items)) == items)


def blob_id() -> Column:
    """Identity of a materialized session's blob."""
    return F.concat(F.lit("sessions/"), F.col("session_id"), F.lit("/measurements"))


def rejected_id() -> Column:
    """Identity of a rejected request."""
    return F.concat(F.lit("rejections/"), F.col("session_id"), F.lit("/"), F.col("request_sha256"))


def object_key() -> Column:
    """Where a session's artifact lies in the bucket."""
    return F.concat(blob_id(), F.lit(".parquet"))


def in_hours(live: DataFrame, intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of a live store's ``event_hour`` folders that some interval touches.

    The hours are found while the query runs and reach the scan as a filter on
    its folders. They are at most the hours of the store's time (8,784 short
    texts a year), which bounds the broadcast. Tables without the column pass as they are.
    """
    if "event_hour" not in live.columns:
        return live
    hour = F.expr("INTERVAL '1' HOUR")
    touched = F.sequence(F.date_trunc("hour", F.col(start)).cast("timestamp_ntz"), F.col(end).cast("timestamp_ntz"), hour)
    hours = intervals.where(F.col(start) < F.col(end)).select(F.explode(touched).alias("h")).select(F.date_format("h", "yyyy-MM-dd-HH").alias("event_hour")).distinct()
    # Spark only carries a side that filters over to the folders of the other
    return live.join(F.broadcast(hours.where(F.col("event_hour") > "")), "event_hour", "left_semi")


def session_join(df: DataFrame, requests: DataFrame) -> DataFrame:
    """Rows of each request's signals in its half-open interval, bounds cut to milliseconds.

    See ``interval_join`` for how rows and requests meet, and ``in_hours`` for what is
    read of a live store. Columns of ``df`` and ``session_id``.
    """
    cut = lambda c: F.date_trunc("millisecond", F.col(c)).cast("timestamp_ntz")
    asked = requests.select("session_id", cut("started_at").alias("_from"), cut("ended_at").alias("_to"), "mrids")
    wanted = asked.select("session_id", "_from", "_to", F.explode("mrids").alias("mrid"))
    live = in_hours(df, asked, "_from", "_to")
    return interval_join(live, wanted, "mrid", "timestamp_mccs", "_from", "_to").drop("_from", "_to")


def _metadata_reasons(df: DataFrame) -> dict[str, Column]:
    """Breaches of the rules on ``metadata``, where the table has it."""
    if "metadata" not in df.columns:
        return {}
    is_map = dict(df.dtypes)["metadata"].startswith("map")
    keys, values = (F.map_keys("metadata"), F.map_values("metadata")) if is_map else (F.col("metadata.key"), F.col("metadata.value"))
    return {
        "metadata_count": F.size(keys) > MAX_METADATA, "metadata_unsorted": ~sorted_unique(keys),
        "metadata_key": F.exists(keys, lambda k: k.isNull() | ~k.rlike(METADATA_KEY)),
        "metadata_value": F.exists(values, lambda v: v.isNull() | ~F.octet_length(v).between(1, MAX_TEXT)),
    }


def request_digest() -> Column:
    """SHA-256 of a request's content, by which a repeat is told from a conflict."""
    return F.sha2(F.to_json(F.struct("session_id", "started_at", "ended_at", "requested_at", "mrids", "metadata")), 256)


def session_list(blobs: DataFrame, n: int = 100) -> DataFrame:
    """The n sessions finished last, with what a pick list shows; blobs of one id and time by their session."""
    return blobs.where("status <> 'REJECTED'").orderBy(F.desc("finalized_at"), "blob_id", "session_id").limit(n).select("blob_id", "session_id", "status", "measurement_count", "finalized_at")


def session_details(blobs: DataFrame) -> DataFrame:
    """A row for every signal of every finished session with its number of rows."""
    return blobs.where("status <> 'REJECTED'").select("blob_id", "session_id", F.inline("coverage"))


def validate_requests(df: DataFrame) -> DataFrame:
    """Add ``reasons`` and ``verdict``: accepted, rejected (evidence is written), or
    quarantine (no valid evidence is possible). A column ``metadata`` (array of
    key and value, or a map) is checked where the requests have one. What passes
    these limits cannot exceed the contract's 32 KiB of serialized size."""
    length = F.col("ended_at") - F.col("started_at")
    bad_id = ~canonical_uuid(F.col("session_id"))
    bad_time = F.col("started_at").isNull() | F.col("ended_at").isNull() | F.col("requested_at").isNull()
    why = reasons(
        bad_session_id=bad_id, missing_time=bad_time, empty_interval=F.col("started_at") >= F.col("ended_at"),
        interval_too_long=length > F.expr(f"INTERVAL '{MAX_HOURS}' HOUR"),
        mrid_count=~F.coalesce(F.size("mrids"), F.lit(0)).between(1, MAX_MRIDS),
        mrids_unsorted=~sorted_unique(F.col("mrids")),
        mrid_length=F.exists("mrids", lambda m: (F.octet_length(m) == 0) | (F.octet_length(m) > MAX_TEXT)), **_metadata_reasons(df),
    )
    hard = F.arrays_overlap("reasons", F.array(*map(F.lit, ("bad_session_id", "missing_time", "empty_interval"))))
    verdict = F.when(hard, "quarantine").when(F.size("reasons") > 0, "rejected").otherwise("accepted")
    return df.withColumn("reasons", why).withColumn("verdict", verdict)


def coverage_audit(blobs: DataFrame, coverage: DataFrame, live: DataFrame) -> DataFrame:
    """Per blob and mrid the expected row count against the rows that live data has now.

    blobs: blob_id, started_at, ended_at. coverage: blob_id, mrid, expected.
    """
    wanted = blobs.join(coverage, "blob_id").select("blob_id", "mrid", "expected", "started_at", "ended_at")
    rows = in_hours(live, blobs, "started_at", "ended_at").select("mrid", "timestamp_mccs")
    spans = wanted.select("blob_id", "mrid", "started_at", "ended_at")
    found = interval_join(rows, spans, "mrid", "timestamp_mccs", "started_at", "ended_at").groupBy("blob_id", "mrid").agg(F.count(F.lit(1)).alias("actual"))
    out = wanted.join(found, ["blob_id", "mrid"], "left").withColumn("actual", F.coalesce("actual", F.lit(0)).cast("long"))
    return out.select("blob_id", "mrid", "expected", "actual", (F.col("expected") == F.col("actual")).alias("matches"))


def _varint(n: Column) -> Column:
    """Bytes of a non-negative number on the wire."""
    return F.ceil(F.length(F.bin(n)) / 7)


def _sized(length: Column) -> Column:
    """Bytes of a tag, a length and as many bytes."""
    return 1 + _varint(length) + length


def evidence_size(df: DataFrame) -> Column:
    """Bytes of an evidence row as the message that is published: field numbers are
    under 16, so a tag is one byte; empty texts and zeros are left out."""

    def text(c: Column) -> Column:
        n = F.coalesce(F.octet_length(c), F.lit(0))
        return F.when(n > 0, _sized(n)).otherwise(0)

    def number(c: Column) -> Column:
        return F.when(c > 0, 1 + _varint(c)).otherwise(0)

    def time(c: str) -> Column:
        us = micros(F.col(c))
        seconds = F.floor(us / 1_000_000)
        own = F.when(seconds < 0, 11).otherwise(number(seconds)) + number(1000 * F.pmod(us, F.lit(1_000_000)))
        return F.coalesce(_sized(own), F.lit(0))

    def each(items: Column, size) -> Column:
        return F.aggregate(F.coalesce(items, F.array()), F.lit(0).cast("long"), lambda a, x: a + size(x))

    o = F.col("object")
    total = text(F.col("blob_id")) + text(F.col("session_id")) + F.lit(34) + text(F.col("rejection_reason")) + number(F.col("measurement_count")) + F.lit(2)
    for c in ("requested_at", "started_at", "ended_at", "finalized_at"):
        total = total + time(c)
    total = total + each(F.col("mrids"), lambda m: _sized(F.octet_length(m))) + each(F.col("coverage"), lambda c: _sized(text(c["mrid"]) + number(c["n"])))
    if "metadata" in df.columns:
        pairs = F.map_entries("metadata") if dict(df.dtypes)["metadata"].startswith("map") else F.col("metadata")
        total = total + each(pairs, lambda m: _sized(text(m["key"]) + text(m["value"])))
    inner = text(o["bucket"]) + text(o["object_key"]) + text(o["media_type"]) + number(o["byte_length"]) + number(o["version"]) + F.lit(34)
    return total + F.when(o.isNull(), 0).otherwise(_sized(inner))


def validate_blobmeta(df: DataFrame, bucket: str = BUCKET) -> DataFrame:
    """Add ``reasons``: all breaches of the evidence contract, for artifacts in ``bucket``.

    Columns: session_id, blob_id, request_sha256 (hex), status, mrids, coverage
    (array of mrid, n), measurement_count, rejection_reason, object (bucket,
    object_key, media_type, version, byte_length, sha256), four times.
    """
    done = F.col("status").isin("COMPLETE", "PARTIAL")
    rejected = F.col("status") == "REJECTED"
    o, cov = F.col("object"), F.coalesce(F.col("coverage"), F.array())
    total = F.aggregate(cov, F.lit(0).cast("long"), lambda a, c: a + c["n"])
    missing = F.exists(cov, lambda c: c["n"] == 0)
    named = (o["bucket"] == bucket) & (o["object_key"] == object_key()) & (o["media_type"] == MEDIA_TYPE) & (o["version"] == VERSION)
    good_object = named & o["byte_length"].between(1, MAX_OBJECT) & (F.length(o["sha256"]) == 64)
    own_length = F.exists("mrids", lambda m: ~F.octet_length(m).between(1, MAX_TEXT))
    text = F.coalesce("rejection_reason", F.lit(""))
    # rows within all other limits have under 31 KiB: only the rest need be measured
    outsize = (F.size("mrids") > MAX_MRIDS) | (F.size(cov) > MAX_MRIDS) | F.coalesce(own_length, F.lit(False)) | F.exists(cov, lambda c: F.octet_length(c["mrid"]) > MAX_TEXT)
    outsize = outsize | (F.octet_length(text) > 1024) | (F.octet_length("blob_id") > 512) | (F.octet_length("session_id") > 64) | ~F.coalesce(good_object | o.isNull(), F.lit(False))
    for breach in _metadata_reasons(df).values():
        outsize = outsize | F.coalesce(breach, F.lit(False))
    return df.withColumn(
        "reasons",
        reasons(
            bad_session_id=~canonical_uuid(F.col("session_id")),
            bad_request_digest=~F.coalesce(F.col("request_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
            empty_interval=F.col("started_at") >= F.col("ended_at"),
            finalized_early=F.col("finalized_at") < F.col("requested_at"),
            bad_status=~(done | rejected),
            mrids=done & (~F.size("mrids").between(1, MAX_MRIDS) | ~sorted_unique(F.col("mrids")) | own_length),
            coverage_order=done & (F.transform(cov, lambda c: c["mrid"]) != F.col("mrids")),
            count_sum=done & (F.col("measurement_count") != total),
            reason_on_result=done & (text != ""),
            no_object=done & o.isNull(),
            bad_object=done & o.isNotNull() & ~F.coalesce(good_object, F.lit(False)),
            bad_blob_id=F.when(done, F.col("blob_id") != blob_id()).when(rejected, F.col("blob_id") != rejected_id()),
            unsafe_blob_id=~F.coalesce(F.col("blob_id").rlike(OBJECT_KEY) & ~F.exists(F.split("blob_id", "/"), lambda p: p.isin("", ".", "..")), F.lit(False)),
            complete_with_gap=(F.col("status") == "COMPLETE") & missing,
            partial_without_gap=(F.col("status") == "PARTIAL") & ~missing,
            coverage_on_rejection=rejected & ((F.size(cov) > 0) | (F.coalesce(F.size("mrids"), F.lit(0)) > 0) | (F.col("measurement_count") != 0)),
            reason_length=rejected & ~F.octet_length(text).between(1, 1024),
            object_on_rejection=rejected & o.isNotNull(), too_large=F.when(outsize, evidence_size(df)) > MAX_EVIDENCE, **_metadata_reasons(df),
        ),
    )


def catalog_blobmeta(df: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New blobs, their coverage rows, and conflicts (a known id with another digest).

    df: blob_id, digest, coverage and more. Equal repeats are accepted once; two
    digests of one id in a batch are a conflict too.
    """
    known = catalog.select("blob_id", F.col("digest").alias("_known"))
    per = df.groupBy("blob_id").agg(F.min_by(F.struct(*df.columns), F.struct("digest")).alias("r"), F.min("digest").alias("_lo"), F.max("digest").alias("_hi")).join(known, "blob_id", "left")
    clash = (F.col("_lo") != F.col("_hi")) | (F.col("_known").isNotNull() & (F.col("_known") != F.col("_lo")))
    new = per.where(~clash & F.col("_known").isNull()).select("r.*")
    return new.drop("coverage"), new.select("blob_id", F.inline("coverage")), per.where(clash).select("blob_id", F.col("_lo").alias("digest"), "_known")


def register_artifacts(verified: DataFrame, ledger: DataFrame, fields: list[str], key: str = "blob_id") -> DataFrame:
    """Add ``outcome`` per key: register, replay (all fields equal) or conflict."""
    per = verified.groupBy(key).agg(F.count_distinct(F.struct(*fields)).alias("_n"), F.min(F.struct(*fields)).alias("_v"))
    held = ledger.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"), F.min(F.struct(*fields)).alias("_held"))
    both = per.join(held, key, "left")
    outcome = F.when((F.col("_n") > 1) | (F.col("_rows") > 1), "conflict").when(F.col("_held").isNull(), "register").when(F.col("_held") == F.col("_v"), "replay").otherwise("conflict")
    return both.select(key, "_v.*", outcome.alias("outcome"))


def verify_artifacts(files: DataFrame, evidence: DataFrame, rows: DataFrame) -> DataFrame:
    """Add ``reasons`` to each evidence row from its file and the rows in it.

    files: path, sha256 and byte_length, and ``format`` if the file's columns
    were checked (see ``sources.storage.file_facts``). evidence: blob_id,
    session_id, path, sha256, byte_length, coverage. rows: the artifacts' values
    with the path of their file. Counts are compared per mrid, both ways; every
    row must carry the ids of the evidence.
    """
    checked = "format" in files.columns
    facts = files.select("path", F.col("sha256").alias("_sha256"), F.col("byte_length").alias("_bytes"), (F.col("format") if checked else F.lit("")).alias("_format"))
    counts = rows.groupBy("path", "mrid").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"_{k}_{c}") for c in ("blob_id", "session_id") for k, f in (("lo", F.min), ("hi", F.max))])
    own = evidence.select("path", "blob_id", "session_id", F.inline_outer("coverage")).withColumnRenamed("n", "want")
    whose = evidence.select("path", "blob_id", "session_id")
    strange = [~F.col(f"_{k}_{c}").eqNullSafe(F.col(c)) for c in ("blob_id", "session_id") for k in ("lo", "hi")]
    # one pass over the rows for both: they are read from the files
    known = counts.join(whose, "path").select("path", "mrid", "n", (strange[0] | strange[1] | strange[2] | strange[3]).alias("_strange"))
    met = own.select("path", "mrid", "want").where("want > 0").join(known, ["path", "mrid"], "full_outer")
    off = met.groupBy("path").agg(F.count_if(~F.col("want").eqNullSafe(F.col("n"))).alias("_off"), F.bool_or("_strange").alias("_foreign"))
    joined = evidence.join(facts, "path", "left").join(off, "path", "left")
    why = reasons(
        no_file=F.col("_sha256").isNull(), digest=F.col("_sha256") != F.col("sha256"), length=F.col("_bytes") != F.col("byte_length"), counts=F.col("_off") > 0, identity=F.col("_foreign"), format=F.col("_format") != "",
    )
    return joined.select("blob_id", "path", why.alias("reasons"))


def schema_reasons(df: DataFrame, expected: list[tuple[str, str, bool]]) -> list[str]:
    """Differences between a table's columns and the format: names, order, types, field ids."""
    from pyspark.sql import types as T

    want = [(n, T._parse_datatype_string(k), i) for i, (n, k, _) in enumerate(expected, 1)]
    have = [(f.name, f.dataType, f.metadata.get("parquet.field.id")) for f in df.schema.fields]
    out = [] if [x[0] for x in have] == [x[0] for x in want] else ["columns"]
    both = {n: (t, i) for n, t, i in have}
    return out + [f"type:{n}" for n, t, _ in want if n in both and both[n][0] != t] + [f"field_id:{n}" for n, _, i in want if n in both and both[n][1] not in (None, i)]
