"""Writers and readers of stored tables."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, groupby
from typing import Any
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstream.functions.columns import numeric_value
from gridstream.operators.aggregate import session_order
from gridstream.schema import ARTIFACT_VERSION, SESSION_VALUES


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the one that all executors share; a local one only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and own.isDefined():
        base = own.get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def frozen(df: DataFrame, name: str) -> DataFrame:
    """A table written to the shared folder and read again, where several steps
    after one another each read their input twice."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_live_store(df: DataFrame, path: str, max_rows: int = 10_000_000, ts: str = "timestamp_mccs") -> None:
    """Append without roll-up in hourly folders, files of at most ``max_rows`` rows."""
    hour = F.date_format(F.col(ts), "yyyy-MM-dd-HH")
    df.withColumn("event_hour", hour).repartition("event_hour", F.pmod(F.xxhash64("mrid"), F.lit(16))).write.mode("append").partitionBy("event_hour").option("maxRecordsPerFile", max_rows).option("compression", "zstd").parquet(path)


def session_rows(df: DataFrame) -> DataFrame:
    """The artifact's columns in their order and types, with the format's field ids
    and version; required columns are written as such."""
    none = {"string": F.lit(""), "timestamp": F.timestamp_seconds(F.lit(0))}

    def column(k: int, name: str, kind: str, optional: bool) -> Column:
        value = F.col(name).cast(kind) if optional else F.coalesce(F.col(name).cast(kind), none[kind])
        return value.alias(name, metadata={"parquet.field.id": k, "schema_version": ARTIFACT_VERSION})

    return df.select(*[column(k, *field) for k, field in enumerate(SESSION_VALUES, 1)])


_arrow = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}
_version_key = b"wama.parquet.schema_version"  # fixed value: where a file has the version of its format


def _opened(uri: str) -> tuple:
    """File system and path of a URI as Spark or Hadoop writes it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", unquote(uri) if uri.startswith("file:") else uri))


PIECE = 65_536  # rows of a session that a writer holds


def _artifact_schema() -> pa.Schema:
    """The artifact's columns for Arrow."""
    return pa.schema([pa.field(n, _arrow[k], optional, {"PARQUET:field_id": str(i)}) for i, (n, k, optional) in enumerate(SESSION_VALUES, 1)])


@contextmanager
def _artifact_writer(out: Any, schema: pa.Schema, small: bool) -> Iterator[pq.ParquetWriter]:
    """Most sessions have a few rows, and what a file says about its columns is the larger part of it. So the schema
    is written once, as Parquet's own (ids and required columns are part of it), with the format's version; statistics
    are those of time and mrid; and a session of one piece has no dictionaries."""
    options = {"store_schema": False, "write_statistics": ["timestamp_mccs", "mrid"], "use_dictionary": not small}
    with pq.ParquetWriter(out, schema, compression="zstd", **options) as writer:
        writer.add_key_value_metadata({_version_key: str(ARTIFACT_VERSION)})
        yield writer


def _artifact(base: str, session: str | None, name: str, flat: bool = False) -> str:
    """URI of a session's file, in a folder named as Spark names one of a partition, or, if ``flat``, beside others in
    one of 256. Session ids are UUIDs; other characters are escaped once more each time that ``_opened`` takes an escape off."""
    folder = quote(quote(session, safe="")) if session else "__HIVE_DEFAULT_PARTITION__"
    own = quote(folder) if base.startswith("file:") else folder
    if flat:
        return f"{base}/_part={zlib.crc32((session or '').encode()) % 256:02x}/{name}-{own}.zstd.parquet"
    return f"{base}/_session={own}/{name}.zstd.parquet"


@contextmanager
def _new_file(uri: str, again: bool = False) -> Iterator[Any]:
    """A file that gets its name when it is whole, so that a task that is run twice does no harm."""
    store, at = _opened(uri)
    folder, name = at.rsplit("/", 1)
    store.create_dir(folder, recursive=True)
    own = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        yield out
    store.move(own, at)
    if again:
        from pyarrow import fs

        for old in store.get_file_info(fs.FileSelector(folder)):
            if old.path != at and old.base_name.endswith(".parquet"):
                store.delete_file(old.path)


def write_session_artifacts(df: DataFrame, path: str, again: bool = False, flat: bool = False) -> DataFrame:
    """One zstd file for each session, rows in the session order; gives the list of them (session_id,
    path, n, and the sha256 and byte_length of what was written). Sessions are bounded, so the work is spread over sessions. With ``again`` the folders (if
    ``flat``, the files) of the sessions at hand are replaced and others are left alone.

    Tasks write the files to where they stay and pass on their names: a commit by the driver would
    move each file, and a reader without the list would have each folder listed. A folder for each
    session can be read as a column ``_session``, but takes a block and an inode of a disk like the file in it;
    ``flat`` puts the files into 256 folders.
    """
    from gridstream import cluster

    spark = df.sparkSession
    cluster.ship(spark)
    store, folder = _folder(spark, path)
    if store.exists(folder) and not again:
        raise ValueError(f"{path} exists already")
    store.mkdirs(folder)
    base = store.makeQualified(folder).toString()
    plain = session_rows(df.withColumn("session_id", F.coalesce("session_id", F.lit(""))))
    schema, names = _artifact_schema(), [n for n, *_ in SESSION_VALUES]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = session_order(plain.repartition(tasks, "session_id"), "session_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
        for batch in batches:
            sessions = batch.column("session_id")
            ids = sessions.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            typed = pa.RecordBatch.from_arrays([batch.column(n).cast(schema.field(n).type) for n in names], schema=schema)
            for start, end in zip(cuts, cuts[1:], strict=False):
                if end > start:
                    yield sessions[start].as_py(), typed.slice(start, end - start)

    def row_groups(own: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for piece in own:
            held.append(piece)
            if sum(map(len, held)) >= PIECE:
                yield pa.Table.from_batches(held)
                held = []
        if held:
            yield pa.Table.from_batches(held)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for session, own in groupby(pieces(batches), key=lambda p: p[0]):
            uri, n, groups = _artifact(base, session, "part", flat), 0, row_groups(p for _, p in own)
            first = next(groups)
            with _new_file(uri, again and not flat) as out, _artifact_writer(out, schema, len(first) < PIECE) as writer:
                for table in chain([first], groups):
                    writer.write_table(table)
                    n += len(table)
            done.append((session, uri, n, *_digest(*_opened(uri))))
            if len(done) == 1000:
                yield _listed(done)
                done = []
        if done:
            yield _listed(done)

    return frozen(rows.mapInArrow(write, LISTED), "artifact-list")


LISTED = "session_id string, path string, n long, sha256 string, byte_length long"


def _listed(files: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split(" ") for c in LISTED.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == "long" else pa.string()) for c, k in zip(zip(*files, strict=True), kinds, strict=True)], names=list(names))


def _digest(store: Any, at: str) -> tuple[str, int]:
    """SHA-256 and length of a file, read in pieces."""
    digest, size = hashlib.sha256(), 0
    with store.open_input_stream(at) as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
            size += len(piece)
    return digest.hexdigest(), size


def write_empty_artifacts(found: DataFrame, path: str, flat: bool = False) -> DataFrame:
    """An artifact without rows for each session_id of ``found``, whose signals had none; gives the list of them.
    ``flat`` is that of ``write_session_artifacts``."""
    from gridstream import cluster

    spark = found.sparkSession
    cluster.ship(spark)
    store, folder = _folder(spark, path)
    base = store.makeQualified(folder).toString()
    schema = _artifact_schema()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for session in batch.column(0).to_pylist():
                uri = _artifact(base, session, "part-empty", flat)
                with _new_file(uri) as out, _artifact_writer(out, schema, True) as writer:
                    writer.write_table(schema.empty_table())
                done.append((session, uri, 0, *_digest(*_opened(uri))))
            if done:
                yield _listed(done)

    return frozen(found.select("session_id").mapInArrow(write, LISTED), "empty-artifact-list")


def _dealt(files: DataFrame) -> DataFrame:
    """A list of files dealt out evenly: the rows are small, the work behind them is not."""
    return files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism)


def read_artifact_rows(files: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the rows of the artifacts listed in ``path``, with that path. Tasks open the
    files by their names; no folder is listed and no list passes through the driver."""
    from gridstream import cluster

    cluster.ship(files.sparkSession)
    kinds = {n: k for n, k, _ in SESSION_VALUES}
    schema = pa.schema([("path", pa.string()), *[(c, _arrow[kinds[c]]) for c in columns]])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, at = _opened(uri)
                with store.open_input_file(at) as f:
                    for piece in pq.ParquetFile(f).iter_batches(PIECE, columns=columns):
                        held.append(pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(uri), len(piece)), *[piece.column(c) for c in columns]], schema=schema))
                        if sum(map(len, held)) >= 10_000:
                            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                            held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return _dealt(files.select("path")).mapInArrow(read, "path string, " + ", ".join(f"{c} {kinds[c]}" for c in columns))


def _format_faults(store: Any, at: str) -> list[str]:
    """Differences of a file's columns to the artifact format: names and order, types, ids, required, version."""
    with store.open_input_file(at) as f:
        schema = pq.ParquetFile(f).schema_arrow
    if schema.equals(_artifact_schema().with_metadata({_version_key: str(ARTIFACT_VERSION)}), check_metadata=True):
        return []
    found = [] if schema.names == [n for n, *_ in SESSION_VALUES] else ["columns"]
    found += [] if (schema.metadata or {}).get(_version_key) == str(ARTIFACT_VERSION).encode() else ["version"]
    for i, (name, kind, optional) in enumerate(SESSION_VALUES, 1):
        if name in schema.names:
            field, want = schema.field(name), _arrow[kind]
            if field.type != want and not (pa.types.is_timestamp(field.type) and pa.types.is_timestamp(want)):
                found.append(f"type:{name}")
            if (field.metadata or {}).get(b"PARQUET:field_id") != str(i).encode():
                found.append(f"field_id:{name}")
            if field.nullable != optional:
                found.append(f"required:{name}")
    return found


def file_facts(spark: SparkSession, found: str | DataFrame) -> DataFrame:
    """path, sha256, byte_length and ``format`` (faults, none is "") of every artifact under a
    folder, or of those whose ``path`` a table lists, each read in pieces by one task."""
    from gridstream import cluster

    cluster.ship(spark)

    @F.pandas_udf("sha256 string, byte_length long, format string")
    def facts(paths: pd.Series) -> pd.DataFrame:
        rows = []
        for uri in paths:
            store, at = _opened(uri)
            rows.append((*_digest(store, at), ",".join(_format_faults(store, at))))
        return pd.DataFrame(rows, columns=["sha256", "byte_length", "format"])

    if isinstance(found, str):
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(found)
    else:
        listed = _dealt(found.select("path"))
    return listed.select("path", facts("path").alias("_f")).select("path", "_f.*")


def _folder(spark: SparkSession, uri: str) -> tuple:
    """Spark's own file system and path of a URI."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    store, folder = _folder(spark, f"{path}/_SUCCESS")
    return store.exists(folder)


def remove_files(files: DataFrame) -> None:
    """Remove the files of a column ``path``, inside tasks; what is gone already is no fault."""
    from gridstream import cluster

    cluster.ship(files.sparkSession)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, at = _opened(uri)
                if store.get_file_info(at).type == fs.FileType.File:
                    store.delete_file(at)
            yield batch

    files.select("path").mapInArrow(remove, "path string").write.format("noop").mode("overwrite").save()


def read_session_values(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of exactly the registered files; folders are not listed."""
    return spark.read.parquet(*paths)


def write_selection_csv(df: DataFrame, path: str) -> None:
    """Header and rows time, mrid, value_type, value; lines end with a line feed."""
    rows = df.select(F.date_format("timestamp_mccs", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time"), "mrid", "value_type", numeric_value().alias("value"))
    rows.write.mode("errorifexists").option("header", True).option("lineSep", "\n").csv(path)


def keyed_records(df: DataFrame, key: str, value: Column, ts: str) -> DataFrame:
    """Sink columns key, value (null: tombstone) and timestamp."""
    return df.select(F.col(key).cast("string").alias("key"), value.cast("string").alias("value"), F.col(ts).alias("timestamp"))


def publish_compacted(df: DataFrame, key: str, value: Column, ts: str, path: str) -> None:
    """Append keyed records to a stored change log."""
    keyed_records(df, key, value, ts).write.mode("append").parquet(path)


def publish_topic(df: DataFrame, key: str, value: Column, ts: str, servers: str, topic: str) -> None:
    """The same to a topic; needs Spark's Kafka package."""
    keyed_records(df, key, value, ts).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def read_catalog_table(df: DataFrame) -> DataFrame:
    """Sources with nested signals to one row per signal, with its reference."""
    rest = [c for c in df.columns if c != "signals"]
    return df.select(*rest, F.inline("signals")).withColumn("reference", F.concat("source_id", F.lit("."), "signal_id"))


def date_in_order(spark: SparkSession, path: str) -> None:
    """Give the files of a folder modification times in the order of their names,
    which is the order in which a stream reads them.

    Some object stores keep no times that are set. There the times of writing
    must already be in order (as of files that were written one after another);
    where they are not, this raises, since a stream would take the files in the wrong order.
    """
    jvm = spark.sparkContext._jvm
    store, folder = _folder(spark, path)
    files = lambda: {f.getPath().toString(): f.getModificationTime() for f in store.listStatus(folder) if f.getPath().getName().endswith(".parquet")}
    for k, name in enumerate(sorted(files())):
        store.setTimes(jvm.org.apache.hadoop.fs.Path(name), 1_700_000_000_000 + 1000 * k, -1)
    found = files()
    times = [found[name] for name in sorted(found)]
    if any(a >= b for a, b in zip(times, times[1:], strict=False)):
        raise ValueError(f"the store of {path} does not keep the order of files, so they cannot be replayed in it")
