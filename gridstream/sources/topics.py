"""Measurement scans: stored tables, files and topics.

Topic and Protobuf access needs Spark's matching packages; without them the
file forms of the same functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstream.schema import MEASUREMENTS


def read_measurements(df: DataFrame) -> DataFrame:
    """The measurement columns in their order and types; absent ones are null."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in MEASUREMENTS.fields])


def read_measurement_files(spark: SparkSession, path: str) -> DataFrame:
    return read_measurements(spark.read.parquet(path))


def read_measurement_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A stream over files of the measurement schema."""
    reader = spark.readStream.schema(MEASUREMENTS)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def read_topic(spark: SparkSession, servers: str, topic: str, message: str, descriptor: str, start: str = "earliest") -> DataFrame:
    """A stream over a topic of Protobuf messages; needs Spark's Kafka and Protobuf packages."""
    from pyspark.sql.protobuf.functions import from_protobuf

    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start).load()
    return raw.select(F.col("key").cast("string").alias("kafka_key"), "topic", "partition", "offset", F.col("timestamp").alias("kafka_ts"), from_protobuf("value", message, descFilePath=descriptor).alias("message"))
