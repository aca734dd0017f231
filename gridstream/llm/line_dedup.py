"""Line-level deduplication with DataFrame functions only.

Normalised lines are hashed and exploded, the documents of each hash are
counted, and the text is reassembled by position without the lines of frequent
hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstream.llm.common import clash_free, frozen, row_key, same_row

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\f\r"
MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    """The line without ASCII white space around it, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


def lines_of(text: Column) -> Column:
    """Lines of a text; null or empty gives one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_positions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Positions (from 0) of the lines to drop: ``_id``, ``_th`` of ``row_key``
    and the sorted array ``_drop``; rows that keep all have none.

    Keys are told apart by 128 hash bits and stored once. The count per key is
    aggregated before the shuffle. The frequent keys are stored, so that the join back deals both
    sides out anew and Spark can split the partitions of very common lines.
    """
    # an exploded column is computed once, however often it is read
    keys = docs.select(*row_key(doc_id, text), F.posexplode(F.transform(lines_of(F.col(text)), line_key)).alias("_pos", "_key")).where(F.char_length("_key") >= min_chars)
    hashed = frozen(keys.select("_id", "_th", "_pos", F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit(7), "_key").alias("_g")), "line-keys")
    # lines are at least as many as documents, so this finds all candidates
    counted = hashed.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n"))
    candidates = frozen(counted.where(F.col("_n") >= min_docs).drop("_n"), "candidate-lines")
    held = frozen(hashed.join(candidates, ["_h", "_g"]), "candidate-places")
    # distinct first, dealt by all three, so that no task gathers a very common line's documents
    by_docs = held.select("_h", "_g", "_id").distinct().groupBy("_h", "_g").agg(F.count("_id").alias("_n"), F.max("_id").alias("_last"))
    frequent = frozen(by_docs.where(F.col("_n") >= min_docs).drop("_n"), "frequent-lines")
    hit = held.join(frequent, ["_h", "_g"]).where(~F.col("_id").eqNullSafe(F.col("_last")))
    return hit.groupBy("_id", "_th").agg(F.sort_array(F.collect_set("_pos")).alias("_drop"))


@clash_free
def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text", kept: str = "kept") -> DataFrame:
    """Add ``kept`` (the text without frequent lines), ``n_lines`` (before) and ``n_dropped``.

    A key of at least ``min_chars`` code points that occurs in at least
    ``min_docs`` documents loses its lines everywhere but in the document of
    the largest id that holds it, which keeps them all. A null id is smaller
    than any other and counts as no document, and rows of one id count as one;
    repeated rows of the largest id all keep their lines. A null text is one empty line. Other
    columns pass; input columns named like results are replaced.
    """
    drops = dropped_positions(docs, min_chars, min_docs, doc_id, text)
    rest = docs.select(*[c for c in docs.columns if c not in (kept, "n_lines", "n_dropped")], *row_key(doc_id, text))
    joined = rest.join(drops, same_row(rest, drops), "left").select(*[rest[c] for c in rest.columns if c not in ("_id", "_th")], lines_of(rest[text]).alias("_lines"), drops["_drop"])
    # the lines between one dropped position and the next
    edges = F.concat(F.array(F.lit(-1)), F.col("_drop"), F.array(F.size("_lines")))
    runs = F.transform(F.sequence(F.lit(0), F.size("_drop")), lambda k: F.slice("_lines", F.get(F.col("_edges"), k) + 2, F.get(F.col("_edges"), k + 1) - F.get(F.col("_edges"), k) - 1))
    cut = F.when(F.col("_drop").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(F.flatten(runs), "\n"))
    out = joined.withColumn("_edges", edges).withColumn(kept, cut)
    return out.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dropped", F.coalesce(F.size("_drop"), F.lit(0)).cast("long")).drop("_lines", "_drop", "_edges")
