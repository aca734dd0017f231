"""Best-fit packing of token pieces into sequences, in bulk-synchronous steps.

Lengths lie between 1 and the capacity, so pieces sorted by length fall into at
most ``capacity`` classes, and so do the open sequences sorted by gap. A step
takes one class of pieces, longest first. Its successor sweep goes up the gap
classes from the smallest that fits; the piece of rank r in the class gets the
r-th gap met, so no two pieces claim one gap; the filled gaps move down to
their new class, and the next step sees them. What fits nowhere opens new
sequences. Only class counts are swept at once (their number depends on the
capacity, never on the data); ranks are computed and matches are resolved for
all pieces by distributed jobs.

The sweep's size is bounded by the capacity alone. A class of pieces opens at
most two runs of sequences with equal gaps and splits at most one, so there are
at most 3 * capacity runs; a match fills some of the gap of its run, so a run is
matched fewer than capacity times; and a class lays at most capacity layers.
However many pieces there are, the plan has under 3 * capacity**2 matches, and
some ten thousand with real lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstream.llm.common import frozen, give_back, ship
from gridstream.llm.tokens import encoder

CAPACITY = 2048
END = 0
_rank_bits = 44


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut each document's ids (the text's, then ``end``) into pieces.

    Null texts count as empty, so every row has at least one piece. Returns the
    id (named doc_id), piece, start, length, ids_crc32, and each piece's rank
    among those of its length in its task (``_part``, ``_rank``). Other columns
    are left out, whatever their names. Repeated rows are packed each.
    """
    ship(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        last = int(end).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for key, body in zip(batch["doc_id"], batch["text"], strict=True):
                ids = (ids_of.encode(body) if body else b"") + last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((key, piece, at // 4, n, zlib.crc32(own), part, seen[n]))
                    seen[n] += 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"])
        ids_of.forget()
        give_back()

    # ids pass as text: pandas would turn a column of integers with a null into floats
    kind = dict(docs.dtypes)[doc_id]
    found = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInPandas(
        cut, "doc_id string, piece int, start long, length long, ids_crc32 long, _part int, _rank long"
    )
    return found.withColumn("doc_id", F.col("doc_id").cast(kind))


def sweep(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Matches (length, first rank, pieces, first sequence, offset) of all steps."""
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    open_gaps, opened, found = 0, 0, []

    def put(gap: int, first: int, n: int) -> None:
        nonlocal open_gaps
        if gap and n:
            gaps[gap].append((first, n))
            open_gaps |= 1 << gap

    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            fitting = open_gaps >> length
            if not fitting:
                break
            gap = length + (fitting & -fitting).bit_length() - 1
            first, size = gaps[gap].pop()
            take = min(size, n - rank)
            if take < size:
                gaps[gap].append((first + take, size - take))
            if not gaps[gap]:
                open_gaps &= ~(1 << gap)
            found.append((length, rank, take, first, capacity - gap))
            put(gap - length, first, take)
            rank += take
        if rank < n:
            each = capacity // length
            new = -(-(n - rank) // each)
            lacking = new * each - (n - rank)  # the last sequence has so many pieces less
            for layer in range(each):
                take = new if layer < each - lacking else new - 1
                if take:
                    found.append((length, rank, take, opened, layer * length))
                rank += take
            put(capacity - each * length, opened, new - 1)
            put(capacity - (each - lacking) * length, opened + new - 1, 1)
            opened += new
    return found


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece of ``token_pieces`` a sequence and its place in it.

    Pieces of one length are alike, so which of them takes which gap is free;
    sequences have no gaps between pieces. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    kept = frozen(pieces, "pieces")
    by_task = frozen(kept.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    found = sweep(counts, capacity)
    plan = np.array(sorted(found), np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast((plan[:, 0] << _rank_bits | plan[:, 1], plan[:, 3], plan[:, 4]))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("_part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    ranked = kept.join(bases, ["_part", "length"]).withColumn("_rank", F.col("_rank") + F.col("_base"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        firsts, sequence, offset = held.value
        key = length.to_numpy(np.int64) << _rank_bits | rank.to_numpy(np.int64)
        at = np.searchsorted(firsts, key, side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + key - firsts[at], "offset": offset[at]})

    return ranked.withColumn("_to", place("length", "_rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "_to.sequence_id", "_to.offset")
