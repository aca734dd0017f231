"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is a bounded block of rows inside a task; a longer text is cut into
several that overlap. Its words are indexed once
(suffix order, Burrows-Wheeler transform in a wavelet matrix, sampled suffix
positions); all test phrases are then searched backwards together, their
occurrences located, and the spans of a document merged.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstream.llm.common import clash_free, give_back, row_key, same_row, ship

WINDOW = 10
SHARD_WORDS = 1 << 18
SAMPLE = 8
BLOCK_BYTES = 4 << 20  # benchmark text searched at a time: some 30 MB of windows
PASS_BLOCKS = 16  # blocks sent to the tasks, packed, and searched in one index

_table = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_word = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


def words_of(text: str | None) -> list[bytes]:
    """Words (digits, letters, all beyond ASCII) with A-Z lower-cased; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_table).split()


class Phrases:
    """The distinct windows of a block of items, and which items have each.

    A window is a run of ``window`` words of an item; an item of fewer words,
    but not none, is one window. Items without words have none. Windows are
    rows of the block's own word numbers, last word first, filled with 0; all
    is kept in arrays, of 4 bytes for each word of a window.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        numbers: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        place = {name: k for k, name in enumerate(self.names)}
        flat, owner, sizes = [], [], []
        for name, text in items:
            words = words_of(text)
            if words:
                flat.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in words], np.int32))
                owner.append(place[name])
                sizes.append(len(words))
        self.words = list(numbers)
        size = np.array(sizes, np.int64)
        many = np.maximum(1, size - window + 1)
        row_item = np.repeat(np.arange(len(size)), many)
        at = np.arange(len(row_item)) - np.repeat(np.cumsum(many) - many, many)
        length = np.minimum(size[row_item], window)
        text = np.concatenate([*flat, np.zeros(1, np.int32)])
        last = (np.cumsum(size) - size)[row_item] + at + length - 1
        rows = np.zeros((len(row_item), window), np.int32)
        for k in range(window):
            rows[:, k] = np.where(k < length, text[np.maximum(last - k, 0)], 0)
        _, first, which = np.unique(rows.view([("", np.int32)] * window).reshape(-1), return_index=True, return_inverse=True)
        self.backward, self.lengths = rows[first], length[first].astype(np.int32)
        pairs = np.unique(which.reshape(-1) * len(place) + np.array(owner, np.int64)[row_item]) if len(row_item) else row_item
        self.of = (pairs % max(1, len(place))).astype(np.int32)  # items, window after window
        self.ends = np.cumsum(np.bincount(pairs // max(1, len(place)), minlength=len(first))).astype(np.int32)

    def items_of(self, window: int) -> list[str]:
        """Names of the items that have a window."""
        return [self.names[k] for k in self.of[self.ends[window - 1] if window else 0 : self.ends[window]]]

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """The windows in a shard's word numbers (a word's number is the place of
        its hash among the shard's sorted ones, from 1); 0 for words that it lacks."""
        own = np.fromiter(map(hash, self.words), np.int64, len(self.words))
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        return np.append(0, np.where(hashes[at] == own, at + 1, 0))[self.backward]

    def spelt(self, window: int) -> list[bytes]:
        """The words of a window."""
        return [self.words[w - 1] for w in self.backward[window, : self.lengths[window]][::-1]]


class Blocks:
    """Blocks of phrases as they are sent to the tasks: packed, and unpacked one
    after the other for each index; a single one is unpacked once."""

    def __init__(self, blocks: Iterator[Phrases]):
        self.packed = [zstandard.compress(pickle.dumps(b, 5)) for b in blocks if len(b.lengths)]
        self.only: Phrases | None = None

    def __len__(self) -> int:
        return len(self.packed)

    def __iter__(self) -> Iterator[Phrases]:
        if len(self) == 1:
            self.only = self.only or pickle.loads(zstandard.decompress(self.packed[0]))
            yield self.only
        else:
            yield from (pickle.loads(zstandard.decompress(b)) for b in self.packed)


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order. Zeros end a run; each is
    smaller than any word and than the zeros after it, so no comparison goes
    on beyond the end of a run. Prefix doubling; settled suffixes are left out."""
    n = len(symbols)
    zero = symbols == 0
    first = np.where(zero, np.cumsum(zero) - 1, symbols.astype(np.int64) + zero.sum()) + 1
    base, step = int(first.max(initial=0)) + 1, 1
    value = first
    while base ** (step + 1) < 1 << 62 and step < 3:  # as many symbols as fit in a word are sorted at once
        value = value * base + np.concatenate([first[step:], np.zeros(min(step, n), np.int64)])
        step += 1
    order = np.argsort(value)
    value = value[order]
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(np.concatenate([[True], value[1:] != value[:-1]]), at, 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    while True:
        single = np.concatenate([start[1:] != start[:-1], [True]]) & (start == at)
        todo = np.flatnonzero(~single)
        if not len(todo):
            return order
        own = order[todo]
        ahead = own + step
        key = rank[own] * (n + 1) + np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        turn = np.argsort(key)
        own, key = own[turn], key[turn]
        order[todo] = own
        start[todo] = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), todo, 0))
        rank[own] = start[todo]
        step *= 2


class Index:
    """FM-index over symbols (words over 0, each run ended by a 0)."""

    def __init__(self, symbols: np.ndarray):
        order = suffix_order(symbols)
        n = self.n = len(symbols)
        last = np.where(order > 0, symbols[order - 1], 0).astype(np.int64)
        top = int(symbols.max()) if n else 0
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))]).astype(np.int64)
        self.bits = max(1, top.bit_length())
        self.zeros = np.zeros((self.bits, n + 1), np.int32)  # zeros before each place, by level
        rows = last.astype(np.int32)
        for level in range(self.bits):
            one = (rows >> (self.bits - 1 - level)) & 1
            np.cumsum(1 - one, out=self.zeros[level, 1:])
            rows = np.concatenate([rows[one == 0], rows[one == 1]])
        # every SAMPLE-th place is kept, and the first of each run: no walk leaves its run
        starts = np.concatenate([[True], symbols[:-1] == 0]) if n else np.zeros(0, bool)
        kept = (order % SAMPLE == 0) | starts[order]
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.samples = order[kept]

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        low, high = np.zeros_like(place), place
        for level in range(self.bits):
            zeros, one = self.zeros[level], (symbol >> (self.bits - 1 - level)) & 1
            a, b = zeros[low], zeros[high]
            total = zeros[-1]
            low, high = np.where(one, total + low - a, a), np.where(one, total + high - b, b)
        return high - low

    def previous(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one place earlier, by reading and ranking the
        transform's symbol together."""
        symbol, low, high = np.zeros_like(row), np.zeros_like(row), row
        for level in range(self.bits):
            zeros = self.zeros[level]
            one = (zeros[high + 1] == zeros[high]).astype(np.int64)
            symbol = symbol << 1 | one
            a, b, total = zeros[low], zeros[high], zeros[-1]
            low, high = np.where(one, total + low - a, a), np.where(one, total + high - b, b)
        return self.before[symbol] + high - low

    def search(self, backward: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row ranges (first, end) of the phrases that occur, and their numbers.
        A phrase is a row of symbols, last one first; 0 occurs nowhere."""
        which = np.flatnonzero(lengths > 0)
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.n)
        for k in range(backward.shape[1]):
            symbol = backward[which, k]
            on = lengths[which] > k
            known = on & (symbol > 0) & (symbol < len(self.before) - 1)
            ask = np.where(known, symbol, 0)
            low = np.where(known, self.before[ask] + self.rank(ask, low), np.where(on, 0, low))
            high = np.where(known, self.before[ask] + self.rank(ask, high), np.where(on, 0, high))
            some = high > low
            which, low, high = which[some], low[some], high[some]
        return low, high, which

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, walking back to the nearest sample."""
        out, steps, todo = np.empty(len(row), np.int64), 0, np.arange(len(row))
        while len(todo):
            here = self.kept_before[row]
            found = self.kept_before[row + 1] > here
            out[todo[found]] = self.samples[here[found]] + steps
            todo, row = todo[~found], self.previous(row[~found])
            steps += 1
        return out


def scan_shard(shard: list[list[bytes]], blocks: Blocks) -> list[tuple[list[tuple[int, int]], list[str]]]:
    """Merged word spans (first, end) and items found, for each document's words.
    The index holds every word of the shard, each document ended by a 0; it is
    built once, and one block of phrases after the other is searched in it."""
    found: list[tuple[list[tuple[int, int]], list[str]]] = [([], []) for _ in shard]
    sizes = np.array([len(x) for x in shard], np.int64)
    if not len(blocks) or not sizes.sum():
        return found
    flat = np.zeros(int(sizes.sum()) + len(shard), np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    hashes, number = np.unique(np.fromiter(map(hash, chain.from_iterable(shard)), np.int64, int(sizes.sum())), return_inverse=True)
    flat[np.arange(len(number)) + np.repeat(np.arange(len(shard)), sizes)] = number + 1
    index = Index(flat)
    mark = np.zeros(len(flat) + 1, np.int32)
    items: dict[int, set[str]] = {}
    for phrases in blocks:
        low, high, which = index.search(phrases.numbered(hashes), phrases.lengths)
        if not len(which):
            continue
        size = high - low
        rows = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        window = np.repeat(which, size)
        place = index.locate(rows)
        # two words may share a hash: compare the words themselves
        spelt = {w: phrases.spelt(w) for w in which.tolist()}
        owner = np.searchsorted(starts, place, side="right") - 1
        true = [shard[k][a : a + len(spelt[w])] == spelt[w] for k, a, w in zip(owner.tolist(), (place - starts[owner]).tolist(), window.tolist(), strict=True)]
        place, window, owner = place[true], window[true], owner[true]
        np.add.at(mark, place, 1)
        np.add.at(mark, place + phrases.lengths[window], -1)
        n = len(phrases.lengths)
        pairs = np.unique(owner * n + window)
        for k, w in zip((pairs // n).tolist(), (pairs % n).tolist(), strict=True):
            items.setdefault(k, set()).update(phrases.items_of(w))
    hit = np.diff(np.concatenate([[0], (np.cumsum(mark) > 0).astype(np.int8), [0]]))
    a, b = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
    for k, s, t in zip((np.searchsorted(starts, a, side="right") - 1).tolist(), a.tolist(), b.tolist(), strict=True):
        found[k][0].append((s - int(starts[k]), t - int(starts[k])))
    return [(spans, sorted(items.get(k, ()))) for k, (spans, _) in enumerate(found)]


def _scan(docs: DataFrame, blocks: Blocks, window: int, text: str, shard_words: int) -> DataFrame:
    """Add ``_s``: n_words, spans and items of each row."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(blocks)  # of about PASS_BLOCKS * BLOCK_BYTES of text, packed

    @F.pandas_udf("n_words long, spans array<struct<first:int,end:int>>, items array<string>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        blocks = held.value
        overlap = window - 1

        for batch in batches:
            sizes, found = [], [([], set()) for _ in batch]
            shard, owners, waiting = [], [], 0

            def done(shard: list[list[bytes]], owners: list[tuple[int, int]], found: list = found) -> None:
                for (row, at), (spans, items) in zip(owners, scan_shard(shard, blocks), strict=True):
                    found[row][0].extend({"first": at + s, "end": at + e} for s, e in spans)
                    found[row][1].update(items)

            for row, body in enumerate(batch):
                words = words_of(body)
                sizes.append(len(words))
                for at in range(0, len(words), shard_words):  # a longer text is several pieces that share a window less a word
                    piece = words[at : at + shard_words + overlap]
                    shard.append(piece)
                    owners.append((row, at))
                    waiting += len(piece)
                    if waiting >= shard_words:
                        done(shard, owners)
                        shard, owners, waiting = [], [], 0
            done(shard, owners)
            yield pd.DataFrame({"n_words": sizes, "spans": [merged(s) if n > shard_words else s for n, (s, _) in zip(sizes, found, strict=True)], "items": [sorted(i) for _, i in found]})
        give_back()

    return docs.withColumn("_s", scan(F.col(text)))


def merged(spans: list) -> list[dict[str, int]]:
    """Disjoint spans in order that cover the same words."""
    out: list[dict[str, int]] = []
    for s in sorted((x["first"], x["end"]) for x in spans):
        if out and s[0] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s[1])
        else:
            out.append({"first": s[0], "end": s[1]})
    return out


@clash_free
def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, pass_blocks: int = PASS_BLOCKS) -> DataFrame:
    """Add ``n_words``, ``spans`` (merged word spans to remove) and ``items``
    (ids as sorted strings of the test items with a window in the text).

    Null texts have no words; a null item_id counts as the empty string; equal
    items count once. All rows stay, repeated ones get equal results; input
    columns named like results are replaced. The documents are not shuffled.
    The benchmark is searched in blocks of about ``block_bytes`` of text (items are
    dealt by hash; a longer item is a block), ``pass_blocks`` of them in one index of
    each shard. What a larger benchmark has beyond that (64 MB) takes more
    passes over the documents, each building the index anew, whose hits are merged.
    """
    ship(docs.sparkSession)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t")).distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    load = lambda k: Phrases([(r["i"], r["t"]) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()], window)
    turns = [range(k, min(k + pass_blocks, blocks)) for k in range(0, blocks, pass_blocks)]
    rest = [c for c in docs.columns if c not in ("n_words", "spans", "items")]
    base = _scan(docs.select(*rest, *row_key(doc_id, text)), Blocks(map(load, turns[0])), window, text, shard_words)
    if len(turns) == 1:
        return base.select(*rest, "_s.n_words", "_s.spans", "_s.items")
    more = None
    for turn in turns[1:]:
        hits = _scan(docs.select(*row_key(doc_id, text), F.col(text)), Blocks(map(load, turn)), window, text, shard_words).where(F.size("_s.spans") > 0).select("_id", "_th", "_s.spans", "_s.items")
        more = hits if more is None else more.unionByName(hits)
    more = more.groupBy("_id", "_th").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
    none = lambda c: F.coalesce(c, F.array())

    @F.pandas_udf("array<struct<first:int,end:int>>")
    def merge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([merged(list(x)) for x in batch], dtype=object)

    joined = base.join(more, same_row(base, more), "left")
    return joined.select(
        *[base[c] for c in rest], base["_s.n_words"].alias("n_words"), merge(F.concat(base["_s.spans"], none(more["_spans"]))).alias("spans"),
        F.array_sort(F.array_distinct(F.concat(base["_s.items"], none(more["_items"])))).alias("items"),
    )


def n_hit(spans: Column) -> Column:
    """Number of words inside merged spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["first"]))


@clash_free
def without_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Remove each span of words, from its first to its last letter, from the text."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, gone in batches:
            out = []
            for body, runs in zip(bodies, gone, strict=True):
                if body and runs is not None and len(runs):
                    at = [m.span() for m in _word.finditer(body)]
                    parts, last = [], 0
                    for r in runs:
                        parts.append(body[last : at[r["first"]][0]])
                        last = at[r["end"] - 1][1]
                    body = "".join([*parts, body[last:]])
                out.append(body)
            yield pd.Series(out, dtype=object)

    return docs.withColumn(text, cut(F.col(text), F.col(spans)))
