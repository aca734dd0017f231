"""Training-order materialisation: a keyed permutation gives every token
sequence a slot, and range partitions write shards of fixed stride."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstream.llm.common import frozen, give_back, ship, with_dense_index
from gridstream.llm.tokens import encoder

LENGTH = 512  # ids of 16 bits in a record
SHARD = 4096  # records in a shard
END = 49407
PAD = 0xFFFF  # no id: it tells the fill of a short record from text
ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _feistel(x: np.ndarray, half: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (_mix(left ^ k) & mask), left
        else:
            left, right = right, left ^ (_mix(right ^ k) & mask)
    return left << np.uint64(half) | right


def permute(x: np.ndarray, n: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed bijection on 0..n-1, or its inverse. Values that leave the range
    walk on along their cycle until they are in it again."""
    half = max(1, -(-(max(2, n) - 1).bit_length() // 2))
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % (1 << 64)))
    out = _feistel(x.astype(np.uint64), half, keys, back)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _feistel(out[outside], half, keys, back)
    return out.astype(np.int64)


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token sequences (doc_ids, start, n_tokens, ids) of exactly ``length`` ids.

    The texts of a partition follow one another, each closed by END (a null or
    empty text is that mark alone), and are cut at ``length``; only the last
    sequence of a partition may be shorter. ``doc_ids`` lists the documents in
    a sequence, ``start`` is how many ids of the first lie before it; ids are
    little-endian 16-bit, and larger ones raise an error. Repeated rows are
    taken each; other columns are left out, whatever their names.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[doc_id]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer)
        rest, begin, owners = np.zeros(0, "<u2"), np.zeros(0, np.int64), None  # not yet cut: ids, where each document begins, documents

        def rows(n: int, ids: np.ndarray) -> pa.RecordBatch:
            at = np.arange(n) * length
            ends = np.minimum(at + length, len(ids))
            first, last = np.searchsorted(begin, at, "right") - 1, np.searchsorted(begin, ends - 1, "right") - 1
            size = last - first + 1
            inside = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), owners.take(pa.array(inside)))
            body = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.append(2 * at, 2 * ends[-1]).astype(np.int32)), pa.py_buffer(ids.tobytes())])
            return pa.RecordBatch.from_arrays([lists, pa.array(at - begin[first]), pa.array((ends - at).astype(np.int32)), body], ["doc_ids", "start", "n_tokens", "ids"])

        for batch in batches:
            found = [ids_of.encode(x) if x else b"" for x in batch.column(1).to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4 + 1
            stream = np.full(int(sizes.sum()), END, np.int64)
            real = np.ones(len(stream), bool)
            real[np.cumsum(sizes) - 1] = False
            stream[real] = np.frombuffer(b"".join(found), "<u4")
            if stream.max(initial=0) >= PAD:
                raise ValueError(f"ids of {PAD} and more do not fit in 16 bits")
            begin = np.concatenate([begin, len(rest) + np.cumsum(sizes) - sizes])
            owners = batch.column(0) if owners is None else pa.concat_arrays([owners, batch.column(0)])
            ids = np.concatenate([rest, stream.astype("<u2")])
            n = len(ids) // length
            if n:
                yield rows(n, ids[: n * length])
                held = max(0, int(np.searchsorted(begin, n * length, "right")) - 1)
                rest, begin, owners = ids[n * length :], begin[held:] - n * length, owners.slice(held)
            else:
                rest = ids
        if len(rest):
            yield rows(1, rest)
        ids_of.forget()
        give_back()

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, f"doc_ids array<{kind}>, start long, n_tokens int, ids binary")


def with_slots(rows: DataFrame, key: int) -> DataFrame:
    """Store the rows, number them densely, and add ``slot``, the permuted number.
    Rows are told apart by their place, so repeated ones get a slot each; input
    columns named ``slot``, ``_mid`` or ``_index`` are replaced. An empty table gives none."""
    kept = frozen(rows.withColumn("_mid", F.monotonically_increasing_id()), "sequences", level=9, page=8 << 20)
    n = kept.count()

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(np.int64), n, key))

    return with_dense_index(kept, "_mid", "_index").withColumn("slot", slot("_index")).drop("_mid", "_index")


def shards(slotted: DataFrame, length: int = LENGTH, per_shard: int = SHARD, path: str | None = None) -> DataFrame:
    """Deal the records out in ranges of slots, sort each by slot, and lay every
    shard's records out at a stride of 2 * ``length`` bytes, filled with PAD.

    Slots are dense, so the ranges are known and nothing is sampled; a range
    holds whole shards. With a ``path`` (any URI that Arrow's file systems know)
    every shard becomes a file there, written under a name of its own and
    renamed when complete, so that a repeated task only writes the same file
    again. Returns per record: doc_ids, start, n_tokens, slot, shard, position
    and crc32 of the record as read back from the shard's file, or without a
    ``path`` from its bytes. Other columns are left out.
    """
    ship(slotted.sparkSession)
    spark = slotted.sparkSession
    stride = 2 * length
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = max(1, -(-(-(-slotted.count() // per_shard)) // parts))  # shards in a range
    shard = F.floor(F.col("slot") / per_shard).cast("long")
    placed = slotted.select("doc_ids", "start", "n_tokens", "slot", shard.alias("shard"), "ids")
    dealt = placed.repartitionById(parts, F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("slot")
    kind = dict(slotted.dtypes)["doc_ids"]
    filler = int(PAD).to_bytes(2, "little")

    def finish(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        number = whole.column(4)[0].as_py()
        body: bytes = b"".join([x if len(x) == stride else x + filler * (length - len(x) // 2) for x in whole.column(5).to_pylist()])
        if path is not None:
            from pyarrow import fs

            store, at = fs.FileSystem.from_uri(path)
            store.create_dir(at, recursive=True)
            name = f"{at}/shard-{number:08d}.bin"
            own = f"{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(body)
            store.move(own, name)
            with store.open_input_file(name) as stored:
                body = stored.read()
            if len(body) != len(whole) * stride:
                raise OSError(f"{name} holds {len(body)} bytes for {len(whole)} records")
        sums = [zlib.crc32(body[k : k + stride]) for k in range(0, len(body), stride)]
        return pa.RecordBatch.from_arrays([*whole.columns[:5], pa.array(np.arange(len(whole))), pa.array(sums, pa.int64())], ["doc_ids", "start", "n_tokens", "slot", "shard", "position", "crc32"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch.column(4).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and b > a and held[0].column(4)[0].as_py() != numbers[a]:
                    yield finish(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield finish(held)

    return dealt.mapInArrow(write, f"doc_ids {kind}, start long, n_tokens int, slot long, shard long, position long, crc32 long")


def read_from(path: str, slot: int, count: int, length: int = LENGTH, per_shard: int = SHARD) -> Iterator[np.ndarray]:
    """Records from a slot on, by position alone: how training resumes."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    while count > 0:
        shard, first = divmod(slot, per_shard)
        name = f"{at}/shard-{shard:08d}.bin"
        if store.get_file_info(name).type == fs.FileType.NotFound:
            return
        with store.open_input_file(name) as f:
            f.seek(first * 2 * length)
            body = f.read(min(count, per_shard - first) * 2 * length)
        found = np.frombuffer(body, "<u2").reshape(-1, length)
        yield from found
        slot, count = slot + len(found), count - len(found)
        if slot % per_shard:
            return
