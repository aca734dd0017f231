"""Author-supplied derived values: what goes in, what comes out, and the calculation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstream.functions.columns import finite
from gridstream.operators.alarms import formula, latest_values_join
from gridstream.operators.qualify import quality_ok


@dataclass(frozen=True)
class ProcessorSpec:
    """A ``formula`` (one input, one output), or ``latest-values`` (groups of at
    least two inputs, each in one group, every group with one output and a
    positive age). The calculation is a Column over the input names (a formula's
    is over ``double_value``) or a plain function, which becomes a pandas UDF;
    errors of the function, nulls and results that are not finite are suppressed. A Column must
    not raise: where a divisor may be zero it is written with ``try_divide``."""

    kind: str
    groups: dict[str, dict[str, str]]
    outputs: dict[str, str]
    calculation: Column | Callable[..., float]
    max_age_s: float | None = None
    names: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        inputs = [m for g in self.groups.values() for m in g.values()]
        if self.kind == "formula":
            if len(inputs) != 1 or len(self.outputs) != 1:
                raise ValueError("a formula has exactly one input and one output")
        elif self.kind == "latest-values":
            if any(len(g) < 2 for g in self.groups.values()) or len(inputs) != len(set(inputs)):
                raise ValueError("a group has at least two inputs, each in one group only")
            if set(self.outputs) != set(self.groups) or not self.max_age_s or self.max_age_s <= 0:
                raise ValueError("every group has one output, and the age is positive")
        else:
            raise ValueError(f"unknown kind {self.kind!r}")
        if set(inputs) & set(self.outputs.values()):
            raise ValueError("an input cannot be an output")

    @classmethod
    def formula(cls, source: str, target: str, calculation: Column | Callable[..., float]) -> ProcessorSpec:
        return cls("formula", {"": {"double_value": source}}, {"": target}, calculation, names=("double_value",))

    @classmethod
    def latest_values(cls, groups: dict[str, dict[str, str]], suffix: str, calculation: Column | Callable[..., float], max_age_s: float) -> ProcessorSpec:
        return cls("latest-values", groups, {g: g + suffix for g in groups}, calculation, max_age_s, tuple(next(iter(groups.values()))))

    def column(self) -> Column:
        if isinstance(self.calculation, Column):
            return self.calculation
        function = self.calculation

        @F.pandas_udf("double")
        def call(*inputs: pd.Series) -> pd.Series:
            def one(*x: float) -> float | None:
                try:
                    y = function(*x)
                    return float(y) if isinstance(y, (int, float)) and not isinstance(y, bool) else None
                except Exception:
                    return None  # an author's error suppresses the output

            return pd.Series([one(*x) for x in zip(*inputs, strict=True)], dtype="float64")

        return call(*[F.col(n) for n in self.names])

    def apply(self, df: DataFrame, ts: str = "kafka_ts") -> DataFrame:
        """The derived measurements of a batch."""
        if self.kind == "formula":
            return formula(df.where(finite(F.col("double_value"))), next(iter(self.groups[""].values())), self.outputs[""], self.column())
        rows = [(m, g, n) for g, inputs in self.groups.items() for n, m in inputs.items()]
        inputs = df.sparkSession.createDataFrame(rows, "mrid string, group string, input string")
        names = df.sparkSession.createDataFrame(list(self.outputs.items()), "group string, _output string")
        ok = df.where(quality_ok("explicit_valid") & finite(F.col("double_value")) & F.col("kafka_key").eqNullSafe(F.col("mrid")))
        out = latest_values_join(ok, inputs, self.column(), list(self.names), self.max_age_s, ts).join(F.broadcast(names), "group")
        return out.withColumn("mrid", F.col("_output")).withColumn("kafka_key", F.col("_output")).withColumn("double_value", F.col("value")).select(df.columns)
