"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, so
that every executor can read them again after another one is lost.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import itertools
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstream import cluster

BATCH = 1000  # rows that a task hands to Python at a time: texts may be long

__all__ = ["clash_free", "frozen", "give_back", "packed", "row_key", "same_row", "shared_dir", "ship", "table", "unpacked", "with_dense_index", "with_global_rank"]


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, and lower the session's Arrow
    batch to BATCH rows, which bounds the workers' memory where texts are long."""
    cluster.ship(spark)
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH:  # 0: no bound
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def give_back() -> None:
    """At the end of a Python stage's task: return freed memory to the system, since
    workers live on and the next stage's need adds to what they hold."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only where it is unset and the master is
    local (as in tests on one machine) a local folder is made and set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def frozen(df: DataFrame, name: str, level: int = 3, page: int = 1 << 20) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage is cut
    and values that depend on the partitioning cannot change any more. ``level``
    is how hard zstd tries, ``page`` the bytes it sees at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": str(level), "parquet.page.size": str(page)}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_global_rank(df: DataFrame, order: list[Column], name: str, rank: str = "rank") -> DataFrame:
    """Add a dense position from 0 in the given total order.

    Rows are range-partitioned and sorted once; only the number of rows per
    partition (a list as long as there are partitions) goes to the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kept = frozen(ordered.withColumn("_mid", F.monotonically_increasing_id()), name)
    return with_dense_index(kept, "_mid", rank).drop("_mid")


def with_dense_index(df: DataFrame, mid: str, index: str) -> DataFrame:
    """Turn a stored ``monotonically_increasing_id`` into a dense index."""
    spark = df.sparkSession
    part = F.shiftright(F.col(mid), 33)
    counts = sorted((r[0], r[1]) for r in df.groupBy(part.alias("p")).count().collect())
    bases, total = [], 0
    for p, n in counts:
        bases.append((p, total))
        total += n
    small = spark.createDataFrame(bases, "_p long, _base long")
    return (
        df.withColumn("_p", part)
        .join(F.broadcast(small), "_p")  # a row per partition
        .withColumn(index, F.col("_base") + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_p", "_base")
    )


def clash_free(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators whose own columns begin with an underscore: such columns of the
    user's table are called otherwise while the operator works, and have their names
    again in its result. The table is the first argument that is one; names in other arguments follow."""

    @functools.wraps(operator)
    def call(*args: Any, **more: Any) -> DataFrame:
        at = next(k for k, a in enumerate(args) if isinstance(a, DataFrame))
        docs = args[at]
        odd = [c for c in docs.columns if c.startswith("_")]
        if not odd:
            return operator(*args, **more)
        free = (f"user{k}" for k in itertools.count() if f"user{k}" not in docs.columns)
        safe = {c: next(free) for c in odd}
        named = lambda a: safe.get(a, a) if isinstance(a, str) else a
        rest = [docs.withColumnsRenamed(safe) if k == at else named(a) for k, a in enumerate(args)]
        return operator(*rest, **{k: named(a) for k, a in more.items()}).withColumnsRenamed({v: k for k, v in safe.items()})

    return call


def packed(df: DataFrame, replaced: list[str], **own: Column) -> DataFrame:
    """The user's columns but the replaced ones as one struct ``row``, beside an
    operator's own columns: whatever the user's are called, no names clash."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in replaced]
    return df.select(F.struct(*(kept or [F.lit(0).alias("_none")])).alias("row"), *[c.alias(n) for n, c in own.items()])


def unpacked(df: DataFrame, *results: str | Column) -> DataFrame:
    """The user's columns again, with an operator's results after them."""
    out = df.select("row.*", *results)
    return out.drop("_none") if df.schema["row"].dataType.names == ["_none"] else out


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that tell the rows of a document table apart. Rows that agree in
    them hold the same id and text, so decisions on them agree too."""
    return [F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_th")]


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Null-safe equality of ``row_key`` columns."""
    return a["_id"].eqNullSafe(b["_id"]) & (a["_th"] == b["_th"])
