"""Deduplication of runs of consecutive sentences across a corpus.

Texts are cut into sentences and every sentence's runs are hashed in one pass over
the text. Hashes are dealt to buckets; a task's later occurrences of a hash are
known to be repeats at once, so only its first one travels, however often a
passage is repeated. The buckets find the first occurrence of all, and the bytes
under the others are cut out of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstream.llm.common import clash_free, give_back, row_key, same_row, ship

MIN_SENTENCES = 2
MIN_WORDS = 20
LONGEST = 10  # words; longer sentences are cut into parts, so that one long sentence is several too
PIECE = 1 << 18  # characters that are cut at once; a longer text is cut alone
HELD = 1 << 18  # runs that a task gathers before it deals them out
BUCKETS = 8  # for each shuffle partition
SPACE, ALONE, END, WIDE_END, COMMA, LINE, CLOSING = 1, 2, 4, 8, 16, 32, 64


def _classes() -> np.ndarray:
    """What each code point is to the cuts."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x3001):
        if chr(code).isspace():
            table[code] = SPACE
    # scripts without spaces: Thai, Lao, Myanmar, Khmer, kana, Han, full-width forms
    for a, b in ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3001, 0x312F), (0x31A0, 0x9FFF), (0xF900, 0xFAFF), (0xFF01, 0xFF9F), (0x20000, 0x323AF)):
        table[a : b + 1] |= ALONE
    for marks, bit in ((".!?…؟۔।॥።։", END), ("。！？．｡", WIDE_END), (",،、，；､", COMMA), ("\n", LINE), ("」』）】》", CLOSING)):
        for mark in marks:
            table[ord(mark)] |= bit
    return table


CLASSES = _classes()
_u = np.uint64


def _mixed(x: np.ndarray, by: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    x = (x ^ (x >> _u(31))) * _u(by)
    return x ^ (x >> _u(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class Cut(NamedTuple):
    """Sentences of several texts: each one's text, first word, bytes from and to
    in its text, and two hashes of its words; number of words in all."""

    doc: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    one: np.ndarray
    two: np.ndarray
    words: int


def cut_texts(texts: list[str]) -> Cut:
    """Cut texts into sentences that tile them (the white space after a sentence belongs to it).

    A word is what stands between white space, and each character of a script
    without spaces. A sentence ends after . ! ? or such a mark of other scripts
    before white space, after a full-width mark, and at a line break. Where
    LONGEST places between words hold no end, the window's last comma is a cut,
    or else the place with the smallest hash of the two words around it: so
    every cut is decided by fewer than 2 * LONGEST words around it, wherever
    counting began, and no sentence is longer than LONGEST.
    """
    joined = "".join(texts)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    codes = _codes(joined)
    kinds = CLASSES[codes]
    solid = (kinds & SPACE) == 0
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    alone = (kinds & ALONE) != 0
    scripts = bool(alone.any())
    if scripts:
        begins[1:] |= solid[1:] & (alone[1:] | alone[:-1])
    heads = begin[sizes > 0]
    begins[heads] = solid[heads]
    at = np.flatnonzero(begins)
    n = len(at)
    none = np.zeros(0, np.int64)
    if not n:
        return Cut(none, none, none, none, none.astype(_u), none.astype(_u), 0)
    ends = np.flatnonzero(solid & np.append(~solid[1:] | begins[1:], True))  # the last character of each word

    low = joined.replace("İ", "i").replace("Σ", "σ").lower()  # as long as the text, each letter by itself
    place = np.arange(len(codes)) - np.repeat(np.append(0, at), np.diff(np.concatenate([[0], at, [len(codes)]])))
    chars = _mixed(_codes(low).astype(_u) * _u(0xD6E8FEB86659FD93) + place.astype(_u) * _u(0xC4CEB9FE1A85EC53))
    chars *= solid
    value = _mixed(np.add.reduceat(chars, at))

    rank = np.zeros(n, _u)  # of a cut before each word: 0 for sentence ends
    rank[1:] = _mixed(value[:-1] + _mixed(value[1:])) | _u(2)
    before, spaced = kinds[ends[:-1]], ends[:-1] + 1 < at[1:]
    rank[1:][(before & COMMA) != 0] = 1
    stop = ((before & END) != 0) & spaced
    stop |= (np.bitwise_or.reduceat(kinds, at)[:-1] & LINE) != 0
    if scripts:
        closed = (kinds[at[1:]] & (CLOSING | WIDE_END)) != 0
        after_wide = (before & WIDE_END) != 0
        after_wide[1:] |= ((before[1:] & CLOSING) != 0) & after_wide[:-1]
        stop |= after_wide & ~closed
    rank[1:][stop] = 0
    owner = np.searchsorted(begin, at, "right") - 1
    opens = np.append(True, owner[1:] != owner[:-1])
    rank[opens] = 0
    cut = rank == 0
    if n > LONGEST:  # windows that reach into another text hold its first word, which is a cut already
        windows = np.lib.stride_tricks.sliding_window_view(rank[::-1], LONGEST)  # the last of equal places
        cut[n - 1 - (np.arange(len(windows)) + windows.argmin(axis=1))] = True
    first = np.flatnonzero(cut)
    doc = owner[first]

    width = np.diff(np.append(first, n))
    inside = (np.arange(n) - np.repeat(first, width)).astype(_u)
    one = np.add.reduceat(_mixed(value + inside * _u(0xA24BAED4963EE407)), first)
    two = np.add.reduceat(_mixed(value * _u(0x9FB21C651E98DF25) + inside * _u(0xD1B54A32D192ED03), 0xBF58476D1CE4E5B9), first)

    bytes_at = None if joined.isascii() else np.append(np.flatnonzero((np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80), len(joined.encode("utf-8", "surrogatepass")))
    byte = (lambda k: k) if bytes_at is None else (lambda k: bytes_at[k])
    start = np.where(opens[first], begin[doc], at[first])
    end = np.append(start[1:], 0)
    close = np.append(doc[1:] != doc[:-1], True)
    end[close] = (begin + sizes)[doc[close]]
    base = byte(begin[doc])
    return Cut(doc, first, byte(start) - base, byte(end) - base, one, two, n)


class Runs(NamedTuple):
    """Runs of sentences: text, first sentence (in the text), number of sentences, bytes from, number of bytes, 128 hash bits (of which 96 are compared)."""

    doc: np.ndarray
    first: np.ndarray
    count: np.ndarray
    start: np.ndarray
    size: np.ndarray
    h: np.ndarray
    g: np.ndarray


def runs_in(c: Cut, min_sentences: int, min_words: int) -> Runs:
    """From every sentence, and to every sentence, goes one run: the shortest
    with at least ``min_sentences`` sentences and ``min_words`` words, so that a
    repeated passage is covered up to its last cut. A shorter text is one run as
    a whole. Case and white space do not matter."""
    n = len(c.doc)
    index = np.arange(n)
    heads = np.flatnonzero(np.append(True, c.doc[1:] != c.doc[:-1])) if n else index
    spans = np.diff(np.append(heads, n))
    head, tail = np.repeat(heads, spans), np.repeat(heads + spans - 1, spans)
    ends = np.append(c.first[1:], c.words)[:n]
    last = np.maximum(np.searchsorted(ends, c.first + min_words), index + min_sentences - 1)
    back = np.minimum(np.searchsorted(c.first, ends - min_words, "right") - 1, index - min_sentences + 1)
    fits = last <= tail
    more = back >= head
    more &= last[np.maximum(back, 0)] != index
    short = heads[~fits[heads]]
    a = np.concatenate([index[fits], back[more], short])
    b = np.concatenate([last[fits], index[more], tail[short]])
    length = b - a + 1
    turn = np.argsort(-length, kind="stable")
    a, b, length = a[turn], b[turn], length[turn]
    h, g = length.astype(_u), ~length.astype(_u)
    for k in range(int(length[0]) if len(length) else 0):
        m = np.searchsorted(-length, -k)  # runs of more than k sentences
        h[:m] = _mixed(h[:m] * _u(0x94D049BB133111EB) + c.one[a[:m] + k])
        g[:m] = _mixed(g[:m] * _u(0xFF51AFD7ED558CCD) + c.two[a[:m] + k], 0xC4CEB9FE1A85EC53)
    start = c.start[a]
    return Runs(c.doc[a], a - head[a], length, start, c.end[b] - start, h, g)


def sentences_of(text: str) -> list[tuple[int, int]]:
    """Character spans of a text's sentences (see ``cut_texts``)."""
    c = cut_texts([text])
    if not len(c.doc):
        return [(0, len(text))] if text else []
    raw = text.encode("utf-8", "surrogatepass")
    sizes = [len(raw[a:b].decode("utf-8", "surrogatepass")) for a, b in zip(c.start.tolist(), c.end.tolist(), strict=True)]
    edges = np.cumsum([0, *sizes]).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def runs_of(text: str, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> tuple[int, list[int], list[int], list[tuple[int, int]]]:
    """Number of sentences; first and last sentence and hash of each run of one text."""
    c = cut_texts([text])
    r = runs_in(c, min_sentences, min_words)
    return max(len(c.doc), int(bool(text))), r.first.tolist(), (r.first + r.count - 1).tolist(), list(zip(r.h.tolist(), r.g.tolist(), strict=True))


def split_repeats(ids: pa.Array, th: np.ndarray, first: np.ndarray, h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (by hash) of each hash's first place (by id, null ids first,
    then text hash and sentence), and of the places after it. Rows of one place count once."""
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = np.append(False, same) | np.append(same, False) if len(order) else np.zeros(0, bool)
    own = order[twice]
    key = pc.rank(ids.take(pa.array(own)), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy() if len(own) else own
    turn = np.lexsort((first[own], th[own], key, g[own], h[own]))
    own, key = own[turn], key[turn]
    new = np.append(True, (h[own][1:] != h[own][:-1]) | (g[own][1:] != g[own][:-1]))[: len(own)]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    differs = (key != key[lead]) | (th[own] != th[own[lead]]) | (first[own] != first[own[lead]])
    # several rows of one later place say the same: the first of them is enough
    again = np.append(False, ~new[1:] & (key[1:] == key[:-1]) & (th[own][1:] == th[own][:-1]) & (first[own][1:] == first[own][:-1]))[: len(own)]
    firsts = np.concatenate([order[~twice], own[new]])
    return firsts[np.argsort(h[firsts])], own[differs & ~again]


# What is sent of a place besides the id; hashes only of places that may be the first.
PLACE = {"th": "<i8", "first": "<i4", "count": "<i4", "start": "<i4", "size": "<i4"}
HASHED = PLACE | {"h": "<u8", "g": "<u4"}


def packed(columns: list[np.ndarray], kinds: dict[str, str]) -> bytes:
    """Numbers of several columns, byte by byte: high bytes are alike, and shuffles compress them away."""
    return b"".join(np.ascontiguousarray(c.astype(k)).view(np.uint8).reshape(len(c), -1).T.tobytes() for c, k in zip(columns, kinds.values(), strict=True))


def unpacked(raw: bytes, rows: int, kinds: dict[str, str]) -> list[np.ndarray]:
    """The columns again."""
    out, at = [], 0
    for k in kinds.values():
        size = np.dtype(k).itemsize
        out.append(np.frombuffer(raw, np.uint8, rows * size, at).reshape(size, rows).T.copy().view(k).reshape(-1))
        at += rows * size
    return out


def _dealt(ids: pa.Array, ths: np.ndarray, runs: list[Runs], sentences: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row per bucket with the first places of its hashes, and one (in a bucket
    of its own choice) with the later places and each text's number of sentences
    (as ``start`` of a place -1)."""
    doc, first, count, start, size, h, g = (np.concatenate([r[k] for r in runs]) for k in range(7))
    th = ths[doc]
    held = ids.take(pa.array(doc))
    keep, later = split_repeats(held, th, first, h, g & _u(0xFFFFFFFF))
    bucket = ((h >> _u(33)) * _u(buckets) >> _u(31)).astype(np.int64)
    keep = keep[np.argsort(bucket[keep] * len(ths) + doc[keep])]
    edges = np.flatnonzero(np.append(True, np.diff(bucket[keep]) != 0))[: len(keep)].tolist()
    place = [th, first, count, start, size, h, g & _u(0xFFFFFFFF)]
    rows = [packed([c[keep[a:b]] for c in place], HASHED) for a, b in zip(edges, [*edges[1:], len(keep)], strict=True)]
    none = np.zeros(len(ths), np.int64)
    rows.append(packed([np.concatenate([c[later], d]) for c, d in zip(place[:5], (ths, none - 1, none, sentences, none), strict=True)], PLACE))
    offsets = np.array([*edges, len(keep), len(keep) + len(later) + len(ths)], np.int32)
    lists = pa.ListArray.from_arrays(offsets, pa.concat_arrays([held.take(pa.array(np.concatenate([keep, later]))), ids]))
    buckets_of = [*bucket[keep[edges]].tolist(), int(ths[0] % buckets)]
    return pa.RecordBatch.from_arrays([pa.array(buckets_of, pa.int32()), pa.array([True] * len(edges) + [False]), lists, pa.array(rows, pa.binary())], ["_bucket", "_hashed", "_ids", "_places"])


def run_places(docs: DataFrame, min_sentences: int, min_words: int, buckets: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The runs of all rows, dealt to buckets by their hash (see ``_dealt``)."""
    kind = dict(docs.dtypes)[doc_id]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ths, sentences, runs, waiting, docs_before = [], [], [], [], 0, 0
        for batch in batches:
            whole = batch.filter(pc.greater(pc.fill_null(pc.binary_length(batch.column(2)), 0), 0))
            sizes = pc.binary_length(whole.column(2)).to_numpy()
            at = 0
            while at < len(whole):
                upto = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), PIECE)) + at)
                part = whole.slice(at, upto - at)
                at = upto
                c = cut_texts(part.column(2).to_pylist())
                found = runs_in(c, min_sentences, min_words)
                runs.append(found._replace(doc=found.doc + docs_before))
                docs_before += len(part)
                waiting += len(found.doc)
                ids.append(part.column(0))
                ths.append(part.column(1).to_numpy())
                sentences.append(np.maximum(1, np.bincount(c.doc, minlength=len(part))))
                if waiting >= HELD:
                    yield _dealt(pa.concat_arrays(ids), np.concatenate(ths), runs, np.concatenate(sentences), buckets)
                    ids, ths, sentences, runs, waiting, docs_before = [], [], [], [], 0, 0
        if ids:
            yield _dealt(pa.concat_arrays(ids), np.concatenate(ths), runs, np.concatenate(sentences), buckets)
        give_back()

    return docs.select(*row_key(doc_id, text), F.col(text).alias("_text")).mapInArrow(hashed, f"_bucket int, _hashed boolean, _ids array<{kind}>, _places binary")


def later_places(dealt: DataFrame, doc_kind: str) -> DataFrame:
    """Places of runs that occurred before, and each text's number of sentences, from rows sorted by bucket."""

    def resolve(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        for hashed in (True, False):
            own = table.filter(pc.equal(table.column(1), hashed)).combine_chunks()
            if not len(own):
                continue
            sizes, kinds = pc.list_value_length(own.column(2)).to_pylist(), HASHED if hashed else PLACE
            ids = own.column(2).combine_chunks().flatten()
            place = [np.concatenate(c) for c in zip(*[unpacked(x, n, kinds) for x, n in zip(own.column(3).to_pylist(), sizes, strict=True)], strict=True)]
            if hashed:
                later = split_repeats(ids, place[0], place[1], place[5], place[6])[1]
                ids, place = ids.take(pa.array(later)), [c[later] for c in place[:5]]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, place)], ["_id", "_th", "_first", "_count", "_start", "_size"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and b > a and held[0].column(0)[0].as_py() != bucket[a]:
                    yield from resolve(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from resolve(held)
        give_back()

    return dealt.mapInArrow(found, f"_id {doc_kind}, _th long, _first int, _count int, _start int, _size int")


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text with its places: number of sentences, of removed ones, and the byte spans that stay."""
    for batch in batches:
        lists = batch.column(2)
        owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
        first, count, start, size = (lists.flatten().field(k).to_numpy().astype(np.int64) for k in range(4))
        n_sentences = np.zeros(len(batch), np.int64)
        np.maximum.at(n_sentences, owner[first < 0], start[first < 0])
        real = np.flatnonzero(first >= 0)
        order = real[np.lexsort((first[real], owner[real]))]
        d, f, e, a, b = owner[order], first[order], (first + count)[order], start[order], (start + size)[order]
        wide = np.int64(1) << 32
        reach = np.maximum.accumulate(d * wide + e) if len(d) else e
        new = np.flatnonzero(np.append(True, (d * wide + f)[1:] > reach[:-1])[: len(d)])  # spans that touch are one
        top = np.maximum.reduceat(e, new) if len(new) else e
        end = np.maximum.reduceat(b, new) if len(new) else b
        removed = np.bincount(d[new], weights=top - f[new], minlength=len(batch)).astype(np.int64)
        per = np.bincount(d[new], minlength=len(batch)) + 1  # spans that stay: before, between and after
        offsets = np.concatenate([[0], np.cumsum(per)])
        begin, stop = np.zeros(offsets[-1], np.int64), np.full(offsets[-1], 2**31 - 1)
        slot = np.arange(len(new)) + d[new]
        stop[slot] = a[new]
        begin[slot + 1] = end
        spans = pa.StructArray.from_arrays([pa.array((begin + 1).astype(np.int32)), pa.array((stop - begin).astype(np.int32))], ["at", "size"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_sentences), pa.array(removed), pa.ListArray.from_arrays(offsets.astype(np.int32), spans)], ["_id", "_th", "_n", "_removed", "_stay"])


@clash_free
def dedup_spans(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", kept: str = "kept") -> DataFrame:
    """Add ``kept`` (the text without repeated sentences), ``n_sentences`` and ``n_removed``.

    A run that occurs more than once stays only at its first place, by id, then
    position (null ids first); sentences covered by any later occurrence go, in
    the same document too. A text shorter than the minimum is one run. Rows that
    agree in id and text count as one row and get the same result. Null and
    empty texts stay as they are, with no sentence; white space alone is one.
    Other columns pass; input columns named like results are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)[doc_id]
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = run_places(docs, min_sentences, min_words, buckets, doc_id, text).repartition("_bucket").sortWithinPartitions("_bucket")
    places = later_places(dealt, kind).groupBy("_id", "_th").agg(F.collect_list(F.struct("_first", "_count", "_start", "_size")).alias("_places"))
    left = places.mapInArrow(_left, f"_id {kind}, _th long, _n long, _removed long, _stay array<struct<at: int, size: int>>")
    taken = (kept, "n_sentences", "n_removed", "_id", "_th", "_n", "_removed", "_stay", "_raw")
    names = [c for c in docs.columns if c not in taken]
    rest = docs.select(*[c for c in names if c != text], *row_key(doc_id, text), F.col(text).cast("binary").alias("_raw"))
    joined = rest.join(left, same_row(rest, left), "left")
    pieces = F.transform("_stay", lambda s: F.substring(F.col("_raw"), s["at"], s["size"]).cast("string"))
    whole = F.col("_raw").cast("string")
    cut = F.when(F.col("_removed") > 0, F.array_join(pieces, "")).otherwise(whole)
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select(*[whole.alias(c) if c == text else rest[c] for c in names], cut.alias(kept), none(F.col("_n")).alias("n_sentences"), none(F.col("_removed")).alias("n_removed"))
