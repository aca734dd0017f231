"""Schemas of the measurement tables."""

from __future__ import annotations

from pyspark.sql import types as T

VALUE_COLUMNS = {
    "double": "double_value", "int": "int_value", "uint": "uint_value",
    "bool": "bool_value", "string": "string_value", "timestamp": "timestamp_value",
}
FLAGS = ["valid", "substituted", "operator_blocked", "overflow", "old_data"]
QUALITY = [f"quality_{f}" for f in FLAGS]

_time = T.TimestampNTZType()

MEASUREMENTS = T.StructType(
    [
        T.StructField("mrid", T.StringType()), T.StructField("kafka_key", T.StringType()), T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()), T.StructField("kafka_ts", _time),
        T.StructField("arrival_seq", T.LongType()), T.StructField("timestamp_mccs", _time), T.StructField("mccs_sec", T.LongType()),
        T.StructField("mccs_nanos", T.IntegerType()), T.StructField("timestamp_field", _time), T.StructField("timestamp_gateway", _time),
        T.StructField("received_at", _time), T.StructField("value_type", T.StringType()), T.StructField("double_value", T.DoubleType()),
        T.StructField("int_value", T.LongType()), T.StructField("uint_value", T.LongType()), T.StructField("bool_value", T.BooleanType()),
        T.StructField("string_value", T.StringType()), T.StructField("timestamp_value", _time),
        *[T.StructField(q, T.BooleanType()) for q in QUALITY],
    ]
)

#: Session artifacts: the order of the columns is part of the format; their field ids are 1 to 18.
ARTIFACT_VERSION = 2
SESSION_VALUES = [
    ("blob_id", "string", False), ("session_id", "string", False), ("timestamp_mccs", "timestamp", False), ("mrid", "string", False),
    ("value_type", "string", False), ("double_value", "double", True), ("int_value", "bigint", True), ("uint_value", "bigint", True),
    ("bool_value", "boolean", True), ("string_value", "string", True), ("timestamp_value", "timestamp", True),
    ("timestamp_field", "timestamp", True), ("timestamp_gateway", "timestamp", True), *[(q, "boolean", True) for q in QUALITY],
]
