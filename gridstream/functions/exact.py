"""Numbers that must come out the same bit by bit wherever they are computed."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def stable_mean(values: list[float]) -> float:
    """Mean that no order of the values and no overflow of their sum can change; minus zero becomes zero."""
    scale = max(map(abs, values))
    if scale == 0:
        return 0.0
    return scale * (math.fsum(v / scale for v in values) / len(values)) + 0.0


def array_mean(spark: SparkSession, values: Column) -> Column:
    """``stable_mean`` of an array of finite numbers, in batches; null if it is empty. An
    exactly rounded sum has no form in Spark's own functions."""
    from gridstream.cluster import ship

    ship(spark)

    @F.pandas_udf("double")
    def mean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([stable_mean(v.tolist()) if v is not None and len(v) else None for v in batch], dtype="float64")

    return mean(values)


def hex_text(x: Column) -> Column:
    """A finite double in hexadecimal, all 13 digits: 0x1.91eb851eb851fp+5, 0x0.0p+0 for zero.

    Scaling by powers of two is exact, so the digits are those of the double; the
    exponent from the logarithm is corrected by one where that was rounded.
    """
    size = F.abs(x)
    power = lambda e: F.pow(F.lit(2.0), e)
    guess = F.greatest(F.floor(F.log2(size)), F.lit(-1022))
    # from a half to under four: the guess is off by one at most
    near = size / power(guess)
    e = guess + F.when(near >= 2, 1).when(near < 1, -1).otherwise(0)
    normal = size >= F.lit(2.0**-1022)
    digits = F.when(normal, (size / power(e) - 1) * F.lit(2.0**52)).otherwise(size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    exponent = F.when(normal, e).otherwise(-1022)
    text = F.concat(
        F.when(normal, "0x1.").otherwise("0x0."), F.lpad(F.lower(F.hex(digits)), 13, "0"), F.lit("p"),
        F.when(exponent < 0, "-").otherwise("+"), F.abs(exponent).cast("string"),
    )
    return F.concat(F.when(x < 0, "-").otherwise(""), F.when(size == 0, F.lit("0x0.0p+0")).otherwise(text))
