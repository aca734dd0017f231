"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints of a block are stored as bit planes (one machine word holds one
bit of 64 fingerprints). A query is compared with a whole word of fingerprints
at once: the differing bits of three planes at a time enter carry-save
counters, and a block is abandoned once every distance in it exceeds the radius.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstream.llm.common import clash_free, frozen, give_back, row_key, same_row, ship
from gridstream.llm.components import components

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
EXPECTED = 2048  # fingerprints that a bucket of evenly spread ones may hold
UNIT = 8192  # fingerprints compared in one unit of a larger bucket
PAIRS = 1 << 20  # (query, block) pairs compared at a time
_ones = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles_of(text: str | None, size: int = SHINGLE) -> list[bytes]:
    """Runs of ``size`` words as UTF-8, repeats included; of fewer words, the whole."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII only
    if not words:
        return []
    if len(words) <= size:
        return [b" ".join(words)]
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    return [joined[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=False)]


def fingerprints_of(texts: list[str | None]) -> np.ndarray:
    """Unsigned fingerprints; a bit is set where over half the shingles' hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    hashes: list[np.ndarray] = []
    owners: list[int] = []

    def count() -> None:
        sizes = np.array([len(h) for h in hashes])
        bits = np.unpackbits(np.concatenate(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.int32)
        out[owners] = np.packbits(2 * sums > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        hashes.clear()
        owners.clear()

    waiting = 0
    for k, text in enumerate(texts):
        if found := shingles_of(text):
            hashes.append(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found)))
            owners.append(k)
            waiting += len(found)
            if waiting > 100_000:
                count()
                waiting = 0
    if hashes:
        count()
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``th`` (hash of the text, to tell rows apart) and ``fp`` (the
    fingerprint's bits as a long) of every row."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(fingerprints_of(batch.tolist()).view(np.int64))
        give_back()

    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), fp(F.col(text)).alias("fp"))


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the block sets of which two fingerprints within the radius
    share at least one: all ways to leave ``radius`` of the blocks out."""
    cuts = [round(k * BITS / blocks) for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(kept) for kept in combinations(parts, blocks - radius)]


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """How many blocks: the fewest whose buckets stay small for n spread fingerprints."""
    blocks = radius + 1
    while blocks < BITS // 4 and n > EXPECTED * 2 ** min(m.bit_count() for m in masks(blocks, radius)):
        blocks += 1
    return blocks


def planes_of(padded: np.ndarray) -> np.ndarray:
    """(BITS, blocks) words from fingerprints laid out 64 to a block."""
    rows = padded.reshape(-1, 64)
    return np.stack([np.packbits(((rows >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0] for b in range(BITS)])


def near(planes: np.ndarray, queries: np.ndarray, block: np.ndarray, skip: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Which (query, block) pairs have fingerprints within the radius: the pairs'
    numbers, and a word with a bit set for each. Bits in ``skip`` agree anyway."""
    if not 1 <= radius <= 4:
        raise ValueError("the counters hold a radius of 1 to 4")
    todo = [b for b in range(BITS) if not skip >> b & 1]
    alive = np.arange(len(queries))
    c0, c1, c2, dead = (np.zeros(len(queries), np.uint64) for _ in range(4))
    for k in range(0, len(todo), 3):
        x = [planes[b].take(block) ^ -((queries >> np.uint64(b)) & np.uint64(1)) for b in todo[k : k + 3]]
        x += [np.zeros_like(c0)] * (3 - len(x))
        part = x[0] ^ x[1]
        ones, twos = part ^ x[2], (x[0] & x[1]) | (x[2] & part)
        up = c0 & ones
        c0 ^= ones
        part = c1 ^ twos
        c2 ^= (c1 & twos) | (up & part)
        c1 = part ^ up
        # a count over the radius stays over it: at most 4 + 3 fits in three bits
        over = {4: c2 & (c0 | c1), 3: c2, 2: c2 | (c1 & c0), 1: c2 | c1}[radius]
        dead |= over
        if k in (21, 30, 42):
            stay = np.flatnonzero(dead != _ones)
            if len(stay) < 0.8 * len(alive):
                alive, queries, block, c0, c1, c2, dead = (v[stay] for v in (alive, queries, block, c0, c1, c2, dead))
    hit = np.flatnonzero(dead != _ones)
    return alive[hit], ~dead[hit]


def forest(fps: np.ndarray, group: np.ndarray, skip: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (row, root) that connect the same rows as all links inside the
    groups do; ``group`` is sorted, and memory is bounded by PAIRS."""
    n = len(fps)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(first, n))
    blocks = -(-sizes // 64)
    base = np.cumsum(blocks) - blocks
    own = np.repeat(np.arange(len(first)), sizes)
    inside = np.arange(n) - first[own]
    block = base[own] + inside // 64
    last = (base + blocks - 1)[own]
    lane = block * 64 + inside % 64
    padded, row_of = np.zeros(int(blocks.sum()) * 64, np.uint64), np.full(int(blocks.sum()) * 64, -1)
    padded[lane], row_of[lane] = fps, np.arange(n)
    planes = planes_of(padded)
    counts = np.where(sizes[own] > 1, last - block + 1, 0)  # each row against its own and the later blocks
    ends = np.cumsum(counts)
    parent = np.arange(n)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        rows = np.repeat(np.arange(at, upto), counts[at:upto])
        step = np.arange(len(rows)) - np.repeat(np.cumsum(counts[at:upto]) - counts[at:upto], counts[at:upto])
        where = block[rows] + step
        pair, words = near(planes, fps[rows], where, skip, radius)
        for a in range(0, len(pair), 1 << 15):
            own_pair, own_words = pair[a : a + (1 << 15)], words[a : a + (1 << 15)]
            k, bit = np.nonzero(np.unpackbits(own_words.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            one, two = rows[own_pair[k]], row_of[where[own_pair[k]] * 64 + bit]
            one, two = one[two > one], two[two > one]
            while len(one):
                x, y = parent[one], parent[two]
                differ = x != y
                one, two, x, y = one[differ], two[differ], x[differ], y[differ]
                np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
                while (parent[parent] != parent).any():
                    parent = parent[parent]
        at = upto
    rows = np.flatnonzero(parent != np.arange(n))
    return rows, parent[rows]


def links(nodes: DataFrame, count: int, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """Edges (u, v) that span the links between distinct fingerprints ``fp``.

    Two fingerprints within the radius agree in all but ``radius`` of the bit
    blocks, so they meet in a bucket of some block set. Buckets of more than
    UNIT fingerprints are dealt out as pairs of chunks, each a unit of its own.
    """
    ship(nodes.sparkSession)
    spark = nodes.sparkSession
    sets = masks(blocks or blocks_for(count, radius), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in sets]
    put = F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(signed)]))
    placed = nodes.select("fp", put)
    full = placed.groupBy("c", "key").count().where(F.col("count") > UNIT).select("c", "key", F.ceil(F.col("count") / UNIT).alias("k"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("k"))
    units = F.when(F.col("k").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda t: F.struct(F.least(t, chunk).alias("i"), F.greatest(t, chunk).alias("j")))
    )
    dealt = placed.join(full, ["c", "key"], "left").select("fp", "c", "key", F.inline(units))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_units = dealt.repartition(parts, "c", "key", "i", "j").sortWithinPartitions("c", "key", "i", "j")

    def span(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def done(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for c, own in rows.groupby("c", sort=False):
                ids = own.groupby(["key", "i", "j"], sort=False).ngroup().to_numpy()
                fps = own["fp"].to_numpy(np.int64)
                a, b = forest(fps.view(np.uint64), ids, sets[c], radius)
                yield pd.DataFrame({"u": fps[a], "v": fps[b]})

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held) < 1 << 16:
                continue
            tail = (held[["c", "key", "i", "j"]] == held[["c", "key", "i", "j"]].iloc[-1]).all(axis=1).to_numpy()
            cut = int(np.flatnonzero(~tail)[-1]) + 1 if not tail.all() else 0  # the last unit may go on
            if cut:
                yield from done(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield from done(held)

    return sorted_units.select("c", "key", "i", "j", "fp").mapInPandas(span, "u long, v long")


@clash_free
def near_duplicates(docs: DataFrame, radius: int = RADIUS, blocks: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ``th``, ``fp`` and ``component_id`` (smallest id reachable over links) of every row.

    Texts without words (null and empty ones) have fingerprint 0 and are linked
    like any others. Equal fingerprints are joined before any comparison, so
    copies cost nothing there. Repeated rows stay; a null id is ignored in the
    smallest id (null if there is no other). Other columns are left out.
    """
    prints = frozen(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = frozen(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    roots = components(links(nodes, nodes.count(), radius, blocks))
    rooted = nodes.join(roots, nodes["fp"] == roots["u"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    labels = frozen(rooted.join(least, "root").select("fp", "component_id"), "fingerprint-components")
    return prints.join(labels, "fp").select("doc_id", "th", "fp", "component_id")


@clash_free
def first_of_groups(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the smallest id of each component, one row of each: of
    several with that id, the one of the smallest text hash; of equal rows, one.
    Rows without an id stay only where no
    row near them has one, one of each fingerprint."""
    groups = near_duplicates(docs, radius, doc_id=doc_id, text=text)
    smallest = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    named = smallest.where(F.col("component_id").isNotNull()).groupBy(F.col("component_id").alias("_id")).agg(F.min("th").alias("_th"))
    # without an id, a component is only told by its fingerprints: keep one row of each
    unnamed = smallest.where(F.col("component_id").isNull()).groupBy("fp").agg(F.min("th").alias("_th")).select(F.lit(None).cast(dict(groups.dtypes)["doc_id"]).alias("_id"), "_th")
    chosen = named.unionByName(unnamed)
    rows = docs.select(*docs.columns, *row_key(doc_id, text))
    kept = rows.join(chosen, same_row(rows, chosen), "left_semi")
    again = Window.partitionBy("_id", "_th").orderBy("_th")
    return kept.withColumn("_n", F.row_number().over(again)).where(F.col("_n") == 1).select(*docs.columns)
