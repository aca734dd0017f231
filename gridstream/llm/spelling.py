"""Spelling variants by composing a minimised acceptor with a one-edit transducer.

Two words one edit apart agree before the edit (in ``lcp`` code points) and
after it. A composed machine A o T o A is in the state (q, q) until the edit;
the words whose edit lies behind one prefix and before one suffix are a
partition of that machine by its initial state (q of the prefix). Each
partition is built and enumerated by itself: its acceptor is minimal, the two
copies leave (q, q) by a replaced or an inserted code point, and what both
accept from there on is found once for each pair of states.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstream.llm.common import frozen, give_back, ship

LEAST = 7  # code points of a word
LEAST_N = 2  # occurrences of a word
RATIO = 10  # how many times as frequent a form is
DROP = 31  # a run whose hash it divides loses a code point
UNIT = 4096  # words of a partition; larger ones are divided
HELD = 100_000  # words that a task counts before it hands them on
KEY = ["len", "a", "b", "lo", "hi", "key"]
Pair = tuple[str, str, int]


# --- words ---------------------------------------------------------------------


def runs_of(doc_id: str | None, text: bytes | None, least: int = LEAST) -> Counter:
    """Words of one text with their counts: maximal runs of letters, A-Z lower-cased,
    of which those whose hash DROP divides lose a code point."""
    found: Counter = Counter()
    if text:
        # runs that are too short cannot become longer; lower() of bytes is ASCII only
        runs = re.findall(f"[A-Za-zÀ-ÿ]{{{least},}}", text.lower().decode("utf-8", "replace"))
        base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        for run, k in Counter(runs).items():
            h = zlib.crc32(run.encode(), base)
            if h % DROP == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                found[run] += k
    return found


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST, least_n: int = LEAST_N) -> DataFrame:
    """``word`` and ``n`` (occurrences over all rows, repeated ones included) of the words
    with at least ``least`` code points and ``least_n`` occurrences. Null texts have no
    words; a null id counts as an empty one."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for own_id, own_text in zip(batch.column(0), batch.column(1), strict=True):
                held.update(runs_of(own_id.as_py(), own_text.as_py(), least))
                if len(held) > HELD:
                    yield hand_on()
        yield hand_on()
        give_back()

    parts = docs.select(F.col(doc_id).cast("string"), F.col(text).cast("binary")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


# --- the composition -------------------------------------------------------------


class Acceptor:
    """The minimal deterministic acceptor of sorted, distinct words."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.arcs: list[dict[str, int]] = []
        self.common: dict[tuple[int, int], list[str]] = {}
        known: dict[tuple, int] = {}
        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]
        last = ""

        def closed(node: tuple[list[bool], dict[str, int]]) -> int:
            key = (node[0][0], *node[1].items())
            if key not in known:
                known[key] = len(self.final)
                self.final.append(node[0][0])
                self.arcs.append(node[1])
            return known[key]

        def close(depth: int) -> None:
            while len(path) - 1 > depth:
                node = path.pop()
                path[-1][1][last[len(path) - 1]] = closed(node)

        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            close(same)
            path += [([False], {}) for _ in word[same:]]
            path[-1][0][0] = True
            last = word
        close(0)
        self.start = closed(path[0])

    def both(self, p: int, q: int) -> list[str]:
        """What is accepted from both states."""
        key = (p, q) if p <= q else (q, p)
        if key not in self.common:
            one, two = self.arcs[p], self.arcs[q]
            out = [""] if self.final[p] and self.final[q] else []
            for c in one.keys() & two.keys():
                out += [c + rest for rest in self.both(one[c], two[c])]
            self.common[key] = out
        return self.common[key]


def one_edit_pairs(words: list[str], size: int, lo: int, hi: int) -> Iterator[tuple[str, str]]:
    """Pairs of the words (sorted and distinct) that one edit tells apart: a replaced
    code point in words of ``size``, or one inserted into a word of ``size``. The
    words agree in exactly lo to hi - 1 code points before they part. Each pair
    comes once, the shorter word first."""
    a = Acceptor(words)
    todo = [("", a.start)]
    while todo:
        head, q = todo.pop()
        depth, arcs = len(head), list(a.arcs[q].items())
        if depth + 1 < hi:
            todo += [(head + c, t) for c, t in arcs]
        if depth < lo:
            continue
        for k, (c, s) in enumerate(arcs):
            for d, t in arcs[k + 1 :]:
                for rest in a.both(s, t):
                    if depth + 1 + len(rest) == size:
                        yield head + c + rest, head + d + rest
            # c inserted: the shorter word goes on from q with something else, or ends
            if a.final[q] and a.final[s] and depth == size:
                yield head, head + c
            for d, t in arcs:
                if d != c and d in a.arcs[s]:
                    for rest in a.both(t, a.arcs[s][d]):
                        if depth + 1 + len(rest) == size:
                            yield head + d + rest, head + c + d + rest


# --- the partitions ----------------------------------------------------------------


def _halves(size: Column, a: Column, b: Column) -> Column:
    """How far the first half of what lies between prefix and suffix reaches."""
    return (a + F.floor((size - a - b) / 2)).cast("int")


def _divided(rows: DataFrame) -> DataFrame:
    """Each row (len, a, b, lo, hi, word, n) in both halves of its partition: the words part
    behind the first half of the middle, which then joins the prefix, or within it, and
    then the second half joins the suffix."""
    mid = F.col("_mid")
    suffix = (F.col("len") - mid).cast("int")
    half = lambda a, b, lo, hi: F.struct(a.alias("a"), b.alias("b"), lo.alias("lo"), hi.alias("hi"))
    both = F.array(half(mid, F.col("b"), F.greatest("lo", mid), F.col("hi")), half(F.col("a"), suffix, F.col("lo"), F.least("hi", mid)))
    cut = rows.withColumn("_mid", _halves(F.col("len"), F.col("a"), F.col("b"))).select("len", "word", "n", F.inline(both))
    text = F.concat(F.substring(F.col("word"), F.lit(1), F.col("a")), F.when(F.col("b") > 0, F.substring(F.col("word"), -F.col("b"), F.col("b"))).otherwise(""))
    return cut.withColumn("key", text)


def partitions(vocabulary: DataFrame, unit: int = UNIT) -> DataFrame:
    """KEY, ``word``, ``n``: the words in partitions of at most ``unit`` words.

    For each length of a pair's shorter word, words of it and of one more are put
    in by their first half and by their last half. A partition that is too
    large is divided again in the same way, until a single code point is free:
    then it holds no more words than there are letters and pairs of letters.
    """
    length = F.char_length("word")
    whole = lambda size: F.struct(size.cast("int").alias("len"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("lo"), (size + 1).cast("int").alias("hi"))
    rows = vocabulary.select("word", "n", F.inline(F.array(whole(length), whole(length - 1))))
    done, free = [], F.col("len") - F.col("a") - F.col("b")
    while True:
        dealt = frozen(_divided(rows), "word-parts")
        sizes = dealt.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_words"), F.min(F.char_length("word")).alias("_least"))
        alive = frozen(sizes.where((F.col("_words") > 1) & (F.col("_least") == F.col("len"))).select(*KEY, (F.col("_words") > unit).alias("_large")), "live-parts")
        kept = dealt.join(alive, KEY)
        large = F.col("_large") & (free > 1)
        done.append(kept.where(~large).drop("_large"))
        if alive.where(large).isEmpty():
            break
        rows = kept.where(large).drop("_large", "key")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def near_words(vocabulary: DataFrame, unit: int = UNIT) -> DataFrame:
    """``word``, ``near``, ``near_n``: all ordered pairs of words that exactly one inserted,
    deleted or replaced code point tells apart. A partition's rows come to a task
    one after another, and it holds those of one."""
    ship(vocabulary.sparkSession)
    n = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = partitions(vocabulary, unit).repartition(n, *KEY).sortWithinPartitions(*KEY, "word").select("len", "a", "b", "lo", "hi", "key", "word", "n")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, counts = None, [], []
        out: tuple[list, list, list] = ([], [], [])

        def enumerate_part() -> None:
            if len(words) < 2:
                return
            size, a, b, lo, hi, _ = now
            first, last = words[0][:a], words[0][len(words[0]) - b :]
            own = dict(zip(words, counts, strict=True))
            middles = sorted(w[a : len(w) - b] for w in words)
            for one, two in one_edit_pairs(middles, size - a - b, lo - a, hi - a):
                one, two = first + one + last, first + two + last
                for column, values in zip(out, ((one, two), (two, one), (own[two], own[one])), strict=True):
                    column.extend(values)

        def hand_on() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])
            for column in out:
                column.clear()
            return made

        for batch in batches:
            for *part, word, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    enumerate_part()
                    now, words, counts = part, [], []
                words.append(word)
                counts.append(count)
            if len(out[0]) > 10_000:
                yield hand_on()
        enumerate_part()
        yield hand_on()
        give_back()

    return dealt.mapInArrow(pairs, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: where the forms lead. A form is RATIO times as frequent as its
    word, so chains are short; each round doubles the steps taken."""
    now = frozen(forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        on = now.select(F.col("word").alias("_via"), F.col("root").alias("_next"))
        step = frozen(now.join(on, F.col("root") == F.col("_via"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "word-roots")
        now = step.drop("_moved")
        if step.where("_moved").isEmpty():
            return now


def variants(vocabulary: DataFrame, ratio: int = RATIO, unit: int = UNIT) -> DataFrame:
    """For each of the distinct words (``word``, ``n``): ``n_near`` (its near words), ``form`` (the
    most frequent of them, of several the smallest by code points, if it is at least
    ``ratio`` times as frequent; else null), ``form_n``, and ``root`` (the end of the chain of
    forms; without a form the word itself). An empty vocabulary gives no rows."""
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("_best")
    near = frozen(near_words(vocabulary, unit).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best), "near-words")
    joined = vocabulary.join(near, "word", "left")
    strong = -F.col("_best.m") >= ratio * F.col("n")
    found = frozen(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("_best.near")).alias("form"), F.when(strong, -F.col("_best.m")).alias("form_n")), "word-forms")
    roots = _roots(found.where(F.col("form").isNotNull()))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
