"""Exact n-gram Jaccard join with prefix trees.

1. A text's set is its distinct shingles, as 64-bit hashes in ascending order.
   Equal sets are one set from here on.
2. Similar sets differ in few shingles, so if the hash range is cut into more
   parts than that, some part holds the same shingles in both. The sums of the parts are
   signatures; sets that share one are connected, which gives clusters outside
   of which no link is possible.
3. The sets of a cluster are put in a prefix tree, in one order (rarest first) for
   all sets that meet in it. A set runs down the tree: the overlap with a
   path is counted once for all sets below, and a subtree is left as soon as the
   shingles that remain on either side cannot make up the overlap that is needed.

Only links that connect what was apart are kept: they span the same components.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstream.llm.common import frozen, give_back, row_key, same_row, ship
from gridstream.llm.components import components

SHINGLE = 4
PERCENT = 85  # of the union that must be shared
UNIT = 1 << 21  # shingles in one tree
SEEN = 100_000  # sets that a task remembers not to send twice
FILTER = 1 << 24  # bits by which texts are chosen before they are dealt
_u = np.uint64


# --- sets ------------------------------------------------------------------------

BLOCK = 1 << 16
_BASE = 0x9E3779B97F4A7C13  # odd, 3 modulo 8
_TABLE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POWERS, _INVERSE = _powers(_BASE, BLOCK), _powers(pow(_BASE, -1, 1 << 64), BLOCK)


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers."""
    h = (h ^ (h >> _u(30))) * _u(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _u(27))) * _u(0x94D049BB133111EB)
    return h ^ (h >> _u(31))


def _sums(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The polynomial's sums over the first ``at`` bytes (ascending), block by block."""
    out, base, low = np.empty(len(at), np.uint64), _u(0), 0
    for s in range(0, len(data), BLOCK):
        part = data[s : s + BLOCK]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_TABLE[part] * _POWERS[: len(part)], out=sums[1:])
        sums = sums * _u(pow(_BASE, s, 1 << 64)) + base
        high = int(np.searchsorted(at, s + len(part), side="right"))
        out[low:high] = sums[at[low:high] - s]
        base, low = sums[-1], high
    return out


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct runs of ``size`` words, A-Z lower-cased; of
    fewer words the whole is one; without words there are none. Each run's bytes
    are hashed as a polynomial, from sums over the whole text."""
    joined = b" ".join((text or b"").lower().split())  # of bytes: ASCII only
    if not joined:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(joined, np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.append(0, ends[:-1] + 1)
    k = min(size, len(starts))
    starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
    blocks = np.array([pow(_BASE, -b * BLOCK, 1 << 64) for b in range(int(starts[-1]) // BLOCK + 1)], np.uint64)
    h = (_sums(data, ends) - _sums(data, starts)) * _INVERSE[starts % BLOCK] * blocks[starts // BLOCK]
    return np.unique(mixed(h ^ mixed((ends - starts).astype(np.uint64))))


def set_id(grams: np.ndarray) -> int:
    """What tells sets apart: 64 hash bits as a signed number."""
    h = xxhash.xxh3_64_intdigest(grams.tobytes())
    return h - (1 << 64) if h >> 63 else h


# --- signatures --------------------------------------------------------------------


class Scheme:
    """Size classes, and for each the most shingles in which two linked sets of which
    the smaller is in it can differ. A linked set is in the same or the next class."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.lows = percent, [1]

    def class_of(self, n: int) -> int:
        while self.lows[-1] <= n:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        return bisect_right(self.lows, n) - 1

    def differing(self, k: int) -> int:
        largest = self.lows[k + 1] - 1
        return (100 - self.percent) * (largest + largest * 100 // self.percent) // (100 + self.percent)

    def spare(self, k: int) -> int:
        """Parts beyond those needed: as many as are likely to be empty."""
        need = self.differing(k) + 1
        empty = need * (1 - 1 / need) ** self.lows[k]
        return math.ceil(empty + 2 * math.sqrt(empty)) if need > 1 else 0

    def signatures(self, grams: np.ndarray) -> np.ndarray:
        """Hashes of which any two linked but different sets share one.

        With ``differing`` + 1 + ``spare`` parts, more than ``spare`` parts agree. A set with at
        most so many empty parts has a full one among them; a set with more takes
        part with ever more parts until it has not. The one of two sets that stops
        first has met the other in its last try. In the end each shingle is a part.
        """
        n, out = len(grams), []
        own = self.class_of(n)
        values, places = mixed(grams ^ _u(0x5851F42D4C957F2D)), grams >> _u(32)
        for k in {own, max(0, own - 1)}:
            need = self.differing(k) + 1
            if need == 1:  # only equal sets are linked
                continue
            spare = self.spare(k)
            while True:
                parts = need + spare
                if parts >= 4 * n:
                    out.append(mixed(grams ^ _u(k + 1)))
                    break
                part = (places * _u(parts)) >> _u(32)
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                sums = np.add.reduceat(values, first)
                out.append(mixed(sums ^ mixed(part[first] ^ _u((k + 1) << 40 | spare << 20))))
                if len(first) >= need:
                    break
                spare = 4 * spare + 4
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


# --- the tree ------------------------------------------------------------------------


class PrefixTree:
    """Sets of ranks (ascending) as a path-compressed tree. ``order`` lists the sets as they
    lie in it; a node holds those from ``lo`` to ``hi`` and the ranks from ``start`` to ``end`` of their path."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u4").tobytes())
        own = [sets[k] for k in self.order]
        self.size = np.array([len(x) for x in own])
        self.base = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(own)
        shared = np.zeros(len(own), np.int64)  # ranks at the begin that a set shares with the one before
        for k in range(1, len(own)):
            m = min(len(own[k]), len(own[k - 1]))
            apart = np.flatnonzero(own[k][:m] != own[k - 1][:m])
            shared[k] = apart[0] if len(apart) else m
        lo, hi, start, end, child, upto = [0], [len(own)], [0], [0], [0], [0]
        at = 0
        while at < len(lo):
            a, b = lo[at], hi[at]
            end[at] = int(shared[a + 1 : b].min()) if b - a > 1 else int(self.size[a])
            child[at] = upto[at] = len(lo)
            if b - a > 1:
                cuts = [a, *(np.flatnonzero(shared[a + 1 : b] == end[at]) + a + 1).tolist(), b]
                for x, y in zip(cuts, cuts[1:], strict=False):
                    for column, value in ((lo, x), (hi, y), (start, end[at]), (end, 0), (child, 0), (upto, 0)):
                        column.append(value)
                upto[at] = len(lo)
            at += 1
        self.lo, self.hi, self.start, self.end, self.child, self.upto = map(np.array, (lo, hi, start, end, child, upto))
        self.least = np.array([self.size[a:b].min() for a, b in zip(lo, hi, strict=True)])
        self.most = np.array([self.size[a:b].max() for a, b in zip(lo, hi, strict=True)])
        self.marks = np.zeros(int(self.flat.max()) + 1, bool)

    def similar(self, ranks: np.ndarray, skip: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """Places in ``order`` of the sets that are linked with the given one, but for those in ``skip`` (a flag for each place)."""
        a = len(ranks)
        self.marks[ranks] = True
        node, p, o, found = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), []
        width = 16
        while len(node):
            # the next ranks of each path, up to the node's end
            step = np.minimum(self.end[node] - p, width)
            lane = np.arange(int(step.max()) if len(step) else 0)
            path = self.base[self.lo[node]] + p
            inside = lane < step[:, None]
            o = o + (self.marks[self.flat[np.where(inside, path[:, None] + lane, 0)]] & inside).sum(axis=1)
            p = p + step
            # what remains of the given set behind the last rank of the path
            last = self.flat[np.maximum(self.base[self.lo[node]] + p - 1, 0)]
            rest = a - np.where(p > 0, np.searchsorted(ranks, last, side="right"), 0)
            # the size below this node for which the most can be missing or still come
            size = np.clip(rest + p, self.least[node], self.most[node])
            alive = (100 + percent) * (o + np.minimum(rest, size - p)) >= percent * (a + size)
            node, p, o = node[alive], p[alive], o[alive]
            done = p == self.end[node]
            single = self.hi[node] - self.lo[node] == 1
            leaf = done & single
            hit = (100 + percent) * o[leaf] >= percent * (a + p[leaf])
            found.append(self.lo[node[leaf][hit]])
            inner = done & ~single
            many = self.upto[node[inner]] - self.child[node[inner]]
            below = np.repeat(self.child[node[inner]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            below_o, below_p = np.repeat(o[inner], many), np.repeat(p[inner], many)
            wanted = ~((self.hi[below] - self.lo[below] == 1) & skip[self.lo[below]])
            node = np.concatenate([node[~done], below[wanted]])
            p, o = np.concatenate([p[~done], below_p[wanted]]), np.concatenate([o[~done], below_o[wanted]])
            width = max(16, min(4 * width, 1024, (1 << 22) // max(1, len(node))))
        self.marks[ranks] = False
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def span(sets: list[np.ndarray], asks: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (as places in the list) that connect whatever the links of sets in ``asks``
    with all others connect."""
    whole, ranks, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(whole), np.uint32)
    rank[np.lexsort((whole, counts))] = np.arange(len(whole), dtype=np.uint32)
    ordered = [np.sort(x) for x in np.split(rank[ranks], np.cumsum([len(x) for x in sets])[:-1])]
    tree = PrefixTree(ordered)
    asking, group, out = asks[tree.order], np.arange(len(sets)), []
    for at in np.flatnonzero(asking).tolist():
        skip = group == group[at]
        skip[:at] |= asking[:at]  # those have asked already
        for other in tree.similar(ordered[tree.order[at]], skip, percent).tolist():
            if group[other] != group[at]:
                group[group == group[other]] = group[at]
                out.append((tree.order[at], tree.order[other]))
    return out


# --- Spark -------------------------------------------------------------------------


def _sets(rows: DataFrame, kept: list[str], size: int) -> DataFrame:
    """Columns ``kept``, and ``n``, ``s`` (null without shingles) and ``grams`` of each row's ``text``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), size) for t in batch.column("text")]
            new = [pa.array([len(g) for g in sets], pa.int64()), pa.array([set_id(g) if len(g) else None for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + new, [*kept, "n", "s", "grams"])
        give_back()

    kinds = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in kept)
    return rows.mapInArrow(work, f"{kinds}, n long, s long, grams binary")


def _signatures(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """``sig`` and ``s`` of every set; a task leaves out most repeats."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, seen = Scheme(percent), set()
        for batch in batches:
            sigs, owners = [], []
            for text in batch.column("text"):
                grams = shingle_set(text.as_py(), size)
                if not len(grams) or (own := set_id(grams)) in seen:
                    continue
                seen.add(own)
                sigs.append(scheme.signatures(grams))
                owners.append(np.full(len(sigs[-1]), own, np.int64))
            if len(seen) > SEEN:
                seen.clear()
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(owners))], ["sig", "s"])
        give_back()

    return rows.select("text").mapInArrow(work, "sig long, s long")


def _maybe_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose long ``key`` may be among the wanted ones: all of those, and few others
    while those are fewer than FILTER. Their places in FILTER bits, at most 512 maps of
    4 KB, go to every task, so that other texts need not be dealt to be joined."""
    place = lambda k: F.pmod(k, F.lit(FILTER)) + 1
    maps = wanted.select(place(F.col(key)).alias("_p")).groupBy(F.call_function("bitmap_bucket_number", F.col("_p")).alias("_map"))
    maps = maps.agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("_p"))).alias("_bits"))
    bit = F.call_function("bitmap_bit_position", place(F.col(key)))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_there = F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int")).bitwiseAND(1) == 1
    held = rows.withColumn("_map", F.call_function("bitmap_bucket_number", place(F.col(key))))
    return held.join(F.broadcast(maps), "_map").where(set_there).drop("_map", "_bits")


def _stars(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Edges (u, v) from each set to the first of those that share its key. Rows come in order
    past a window, so that a frequent key is never gathered."""
    first = F.first("s").over(Window.partitionBy(key).orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return frozen(rows.select(F.col("s").alias("u"), first.alias("v")).where(F.col("u") != F.col("v")).distinct(), name)


def _labelled(edges: DataFrame) -> DataFrame:
    """``s`` and ``cluster`` of all ends of edges."""
    nodes = edges.select(F.explode(F.array("u", "v")).alias("s")).distinct()
    roots = components(edges)
    return nodes.join(roots, nodes["s"] == roots["u"], "left").select("s", F.coalesce("root", "s").alias("cluster"))


def _links(units: DataFrame, percent: int, name: str) -> DataFrame:
    """Edges (u, v) of units (cluster, i, j), each of which is a tree: rows s, grams, asks."""
    keys = ["cluster", "i", "j"]
    n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) < 2:
                return
            ids = list(held)
            found = span([np.frombuffer(held[s][0], np.uint64) for s in ids], np.array([held[s][1] for s in ids]), percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in ends], pa.int64()) for ends in zip(*found, strict=True)], ["u", "v"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "s", "grams", "asks")]
            for *unit, s, grams, asks in zip(*columns, strict=True):
                if unit != now:
                    yield from done()
                    now, held = unit, {}
                held[s] = (grams, asks or (s in held and held[s][1]))
        yield from done()
        give_back()

    dealt = units.select(*keys, "s", "grams", "asks").repartition(n, *keys).sortWithinPartitions(*keys)
    return frozen(dealt.mapInArrow(work, "u long, v long"), name)


def _chunk(total: Column, unit: int) -> Column:
    return F.pmod(F.xxhash64("s"), F.ceil(total / unit))


def _whole(sets: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return sets.select("cluster", zero.alias("i"), zero.alias("j"), "s", "grams", F.lit(True).alias("asks"))


def _totals(sets: DataFrame) -> DataFrame:
    return sets.groupBy("cluster").agg(F.sum("n").alias("total"))


def _refined(sets: DataFrame, percent: int) -> DataFrame:
    """Clusters anew, of sets that share a shingle among the rarest by which linked sets must
    meet: few texts are alike in these by a common passage alone. Sets without a partner go."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.frombuffer(g.as_py(), np.int64) for g in batch.column("grams")]
            sizes = [len(g) for g in grams]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(c).to_numpy(), sizes)) for c in ("s", "n")] + [pa.array(np.concatenate(grams))], ["s", "n", "gram"])

    rows = sets.select("s", "n", "grams").mapInArrow(work, "s long, n long, gram long")
    counts = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("s").orderBy("df", "gram"))
    ahead = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    front = rows.join(counts, "gram").withColumn("_place", place).where(F.col("_place") <= ahead)
    return sets.drop("cluster").join(_labelled(_stars(front, "gram", "rare-edges")), "s")


def _spanned(sets: DataFrame, percent: int, unit: int) -> DataFrame:
    """Edges of clusters that are too large for one tree.

    Chunks are linked inside, then one set of each component found so far. In
    most clusters one component is left; sets outside of the largest one are
    strays, and only they are compared with all chunks.
    """
    sized = frozen(sets.join(_totals(sets), "cluster").withColumn("j", _chunk(F.col("total"), unit)), "large-sets")
    edges = _links(sized.select("cluster", F.col("j").alias("i"), "j", "s", "grams", F.lit(True).alias("asks")), percent, "chunk-links")

    def labelled() -> DataFrame:
        roots = components(edges)
        return frozen(sized.join(roots, sized["s"] == roots["u"], "left").select(*sized.columns, F.coalesce("root", "s").alias("label")), "chunk-labels")

    first = labelled().groupBy("cluster", "label").agg(F.min("s").alias("s")).select("s")
    ahead = sized.join(first, "s", "left_semi").drop("total", "j")
    ahead = ahead.join(_totals(ahead), "cluster").withColumn("j", _chunk(F.col("total"), unit))
    edges = edges.unionByName(_links(ahead.select("cluster", F.col("j").alias("i"), "j", "s", "grams", F.lit(True).alias("asks")), percent, "first-links"))
    now = labelled()
    main = now.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    strays = frozen(now.join(main, "cluster").where(F.col("label") != F.col("main")), "strays")
    if strays.isEmpty():
        return edges
    amount = strays.groupBy("cluster").agg(F.ceil(F.sum("n") / unit).alias("_k"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asking = strays.join(amount, "cluster").withColumn("i", F.pmod(F.xxhash64("s"), F.col("_k"))).select("cluster", "i", upto(F.ceil(F.col("total") / unit)).alias("j"), "s", "grams", F.lit(True).alias("asks"))
    asked = now.join(amount, "cluster").select("cluster", upto(F.col("_k")).alias("i"), "j", "s", "grams", F.lit(False).alias("asks"))
    return edges.unionByName(_links(asking.unionByName(asked), percent, "stray-links"))


def similar_sets(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, doc_id: str = "doc_id", text: str = "text", unit: int = UNIT) -> DataFrame:
    """doc_id, ``th`` (hash of the text), ``n_shingles`` and ``component_id`` (smallest id reachable
    over links, itself included) of every row.

    Sets of shingles are linked if they share ``percent`` of their union; the test is exact on
    64-bit hashes. Null texts and texts without words have no shingles and no links.
    Repeated rows stay. A null id is ignored in the smallest id (null if there
    is no other). Other columns are left out. ``unit`` is the most shingles in one tree
    and changes no result.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).cast("binary").alias("text"))
    keyed = frozen(_sets(rows, ["doc_id", "th"], size).drop("grams"), "shingle-sets")
    full = keyed.where(F.col("s").isNotNull())
    distinct = frozen(full.groupBy("s").agg(F.min("n").alias("n"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("r")), "distinct-sets")

    clusters = _labelled(_stars(_signatures(rows, size, percent), "sig", "signature-edges"))
    chosen = frozen(distinct.join(clusters, "s").select("cluster", F.col("r.doc_id").alias("_id"), F.col("r.th").alias("_th")), "chosen-sets")
    own = docs.select(*row_key(doc_id, text), F.col(text).cast("binary").alias("text"))
    own = _maybe_in(own, chosen, "_th")
    sets = frozen(_sets(own.join(chosen, same_row(own, chosen)).select("cluster", "text"), ["cluster"], size), "candidate-sets")
    edges = _tree_links(sets, percent, unit)

    roots = components(edges)
    rooted = distinct.join(roots, distinct["s"] == roots["u"], "left").select("s", "least", F.coalesce("root", "s").alias("root"))
    labels = frozen(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("s", "component_id"), "set-components")
    return keyed.join(labels, "s", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("s").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _tree_links(sets: DataFrame, percent: int, unit: int) -> DataFrame:
    """Edges of all clusters: those that fit go to one tree each, others are first
    clustered more narrowly, and what is still too large is chunked."""
    totals = frozen(_totals(sets), "cluster-sizes")
    parted = lambda rows, sizes, large: rows.join(sizes.where((F.col("total") > unit) == F.lit(large)).select("cluster"), "cluster")
    if totals.where(F.col("total") > unit).isEmpty():
        return _links(_whole(sets), percent, "set-links")
    narrow = frozen(_refined(parted(sets, totals, True), percent), "narrow-sets")
    sizes = frozen(_totals(narrow), "narrow-sizes")
    fitting = _whole(parted(sets, totals, False)).unionByName(_whole(parted(narrow, sizes, False)))
    edges = _links(fitting, percent, "set-links")
    if sizes.where(F.col("total") > unit).isEmpty():
        return edges
    return edges.unionByName(_spanned(parted(narrow, sizes, True), percent, unit))
