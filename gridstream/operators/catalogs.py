"""Catalogues of sources and signals, export records, and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstream.functions.intervals import micros
from gridstream.functions.columns import canonical_uuid, finite, reasons

# Fixed values of the export protocol.
TYPES = {"M_SP_NA_1": "single_point", "M_DP_NA_1": "double_point", "M_ME_NC_1": "short_float"}
CAUSES = [1, 2, 3, 4, 5, *range(20, 37)]
MAX_ASDU = 249

# Unit and kind of each measured quantity.
UNITS = {"frequency": "Hz", "rocof": "Hz/s", "voltage": "V", "current": "A"}
SELECTED = {"frequency": ["frequency"], "rocof": ["rocof"], "phasor": ["voltage", "current"]}
_byte = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{_byte}(\.{_byte}){{3}}$"
_h = "[0-9A-Fa-f]{1,4}"
_tails = "|".join(f"({_h}:){{1,{7 - k}}}(:{_h}){{1,{k}}}" for k in range(1, 7))
IPV6 = rf"^(({_h}:){{7}}{_h}|({_h}:){{1,7}}:|{_tails}|:((:{_h}){{1,7}}|:)|(({_h}:){{6}}|::({_h}:){{0,5}}|({_h}:){{1,5}}:({_h}:){{0,4}}){_byte}(\.{_byte}){{3}})$"


def validate_exports(df: DataFrame) -> DataFrame:
    """Add ``reasons``: all breaches of the export contract.

    Columns: export_id, created_at, type_id, common_address, cause, objects (array
    of address, kind, value, overflow).
    """
    objects = F.coalesce(F.col("objects"), F.array())
    n = F.size(objects)
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    want = F.try_element_at(kinds, F.col("type_id"))
    addresses = F.transform(objects, lambda o: o["address"])
    first = F.get(addresses, F.lit(0))
    sequence = F.forall(F.transform(addresses, lambda a, i: a - i), lambda x: x == first)
    size = 6 + F.when(sequence, F.lit(3)).otherwise(3 * n) + F.when(want == "short_float", 5).otherwise(1) * n
    return df.withColumn(
        "reasons",
        reasons(
            bad_id=~canonical_uuid(F.col("export_id")),
            bad_time=~F.coalesce(F.floor(micros(F.col("created_at")) / 1000) > 0, F.lit(False)),  # whole milliseconds
            bad_type=want.isNull(),
            common_address=~F.coalesce(F.col("common_address").between(1, 0xFFFF), F.lit(False)),
            cause=~F.coalesce(F.col("cause").isin(CAUSES), F.lit(False)),
            object_count=~n.between(1, 127),
            address=F.exists(objects, lambda o: ~o["address"].between(1, 0xFFFFFF)),
            repeated_address=F.size(F.array_distinct(addresses)) < n,
            value_kind=F.exists(objects, lambda o: ~o["kind"].eqNullSafe(want)),
            not_finite=F.exists(objects, lambda o: (o["kind"] == "short_float") & ~finite(o["value"])),
            point_value=F.exists(objects, lambda o: (o["kind"] == "double_point") & ~F.coalesce(o["value"].isin(0.0, 1.0, 2.0, 3.0), F.lit(False))),
            overflow=F.exists(objects, lambda o: (o["kind"] != "short_float") & F.coalesce(o["overflow"], F.lit(False))),
            too_long=(n > 0) & (size > MAX_ASDU),
        ),
    )


def validate_catalog(signals: DataFrame) -> DataFrame:
    """Add ``reasons`` to each signal row (source_id, host, port, idcode, signal_id,
    channel, selector, mrid, quantity, unit; where present ``phasor_channel``, the
    channel that a phasor selector names). A source has one host, port and idcode;
    a selector with its channel, a channel and a signal id occur once in a source."""
    over = lambda *c: F.count(F.lit(1)).over(Window.partitionBy(*c))
    unit = F.try_element_at(F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair]), F.col("quantity"))
    agrees = F.when(F.col("selector") == "frequency", F.col("channel") == "FREQ").when(F.col("selector") == "rocof", F.col("channel") == "DFREQ").when(F.col("selector") == "phasor", F.lit(True)).otherwise(F.lit(False))
    if "phasor_channel" in signals.columns:
        agrees = agrees & ((F.col("selector") != "phasor") | F.col("phasor_channel").eqNullSafe(F.col("channel")))
    kinds = F.try_element_at(F.create_map(*[x for s, q in SELECTED.items() for x in (F.lit(s), F.array(*map(F.lit, q)))]), F.col("selector"))
    place = F.struct("host", "port", "idcode")
    source = Window.partitionBy("source_id")
    counted = (
        signals.withColumn("_signal", over("source_id", "signal_id")).withColumn("_channel", over("source_id", "channel")).withColumn("_mrid", over("mrid"))
        .withColumn("_source", F.min(place).over(source) != F.max(place).over(source))
    )
    why = reasons(
        repeated_source=F.col("_source"), repeated_signal=F.col("_signal") > 1, repeated_channel=F.col("_channel") > 1, repeated_mrid=F.col("_mrid") > 1,
        bad_host=~F.coalesce(F.col("host").rlike(IPV4) | F.col("host").rlike(IPV6), F.lit(False)), bad_port=~F.coalesce(F.col("port").between(1, 65535), F.lit(False)),
        bad_idcode=~F.coalesce(F.col("idcode").between(1, 65535), F.lit(False)), unknown_quantity=unit.isNull(), wrong_unit=unit.isNotNull() & ~F.coalesce(F.col("unit") == unit, F.lit(False)), selector=~F.coalesce(agrees, F.lit(False)), selected_quantity=unit.isNotNull() & ~F.coalesce(F.array_contains(kinds, F.col("quantity")), F.lit(False)),
    )
    return counted.withColumn("reasons", why).drop("_signal", "_channel", "_mrid", "_source")


def reconcile_catalog(proposed: DataFrame, existing: DataFrame, catalog_id: str) -> tuple[DataFrame, DataFrame]:
    """Plan and violations.

    proposed: source_id, signal_id, mrid. existing: the same with catalog_id. The
    plan upserts every proposed source and removes own sources that are not
    proposed. Violations: a source of another catalogue, a signal whose mrid
    changed, an mrid of another source or moved between signals. Use the plan only
    where there is no violation.
    """
    sources = proposed.select("source_id").distinct()
    owners = existing.select("source_id", "catalog_id").distinct()
    both = sources.withColumn("_new", F.lit(True)).join(owners, "source_id", "full_outer")
    action = F.when(F.col("_new"), "upsert").when(F.col("catalog_id") == catalog_id, "tombstone")
    plan = both.withColumn("action", action).where(F.col("action").isNotNull()).select("source_id", "action").distinct()
    foreign = both.where(F.col("_new") & (F.col("catalog_id") != catalog_id)).select("source_id", F.lit(None).cast("string").alias("mrid"), F.lit("foreign_source").alias("violation"))
    old = existing.select("source_id", "signal_id", F.col("mrid").alias("_mrid"))
    changed = proposed.join(old, ["source_id", "signal_id"]).where(F.col("mrid") != F.col("_mrid")).select("source_id", "mrid", F.lit("mrid_changed").alias("violation"))
    held = existing.select(F.col("source_id").alias("_s"), F.col("signal_id").alias("_g"), "mrid")
    met = proposed.join(held, "mrid")
    moved = met.where((F.col("source_id") != F.col("_s")) | (F.col("signal_id") != F.col("_g"))).select("source_id", "mrid", F.when(F.col("source_id") != F.col("_s"), "mrid_owned_elsewhere").otherwise("mrid_moved").alias("violation"))
    return plan, foreign.unionByName(changed).unionByName(moved).distinct()


def audit_derived(derived: DataFrame, approvals: DataFrame, inputs: DataFrame) -> DataFrame:
    """Add ``reasons`` to derived outputs (mrid, kind, unit, topic, owner): not approved,
    another kind, unit, topic or owner than approved, or an input used as an output."""
    ok = approvals.select("mrid", *[F.col(c).alias(f"_{c}") for c in ("kind", "unit", "topic", "owner")], F.lit(True).alias("_known"))
    used = inputs.select("mrid").distinct().withColumn("_input", F.lit(True))
    both = derived.join(ok, "mrid", "left").join(used, "mrid", "left")
    differs = lambda c: F.col("_known") & ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    why = reasons(not_approved=F.col("_known").isNull(), kind=differs("kind"), unit=differs("unit"), topic=differs("topic"), owner=differs("owner"), input_as_output=F.col("_input"))
    return both.select(*derived.columns, why.alias("reasons"))


def joined_reasons(column: Column | str = "reasons") -> Column:
    """Reasons as one text."""
    return F.array_join(column, ",").alias("reasons")
