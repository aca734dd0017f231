"""Importance resampling with hashed n-gram models of target and raw text."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstream.llm.common import clash_free, frozen, ship, with_global_rank

BUCKETS = 1 << 16
TARGET_ROWS = 20_000  # labelled rows that the target model is fitted on, at most
SEED = 11


def buckets_of(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Hash buckets of a text's words and word pairs, repeats included."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.int64)
    one = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]
    two ^= two >> np.uint64(29)
    two *= np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate([one, two >> np.uint64(32)]) % np.uint64(buckets)).astype(np.int64)


def model_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows; a task sends a row per bucket."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for body in batch["text"]:
                total += np.bincount(buckets_of(body, buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    rows = docs.select(F.col(text).alias("text")).mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets)
    for bucket, n in rows:
        out[bucket] = n
    return out


def log_weights(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio of the two smoothed bucket distributions."""
    p, q = (target + 1) / (target.sum() + len(target)), (raw + 1) / (raw.sum() + len(raw))
    return np.log(p) - np.log(q)


def weigh(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_ratio and gumbel_key of each row.

    The key is the log ratio plus Gumbel noise that a hash of id, text and seed
    determines, so that a lost task draws it again alike. Null texts and texts
    without words have no n-grams, ratio 0, and the least of all keys. Repeated
    rows get equal keys; other columns are left out, whatever their names.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(weights)  # a number per bucket

    @F.pandas_udf("n_grams long, log_ratio double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w = held.value
        for batch in batches:
            found = [buckets_of(x, len(w)) for x in batch]
            yield pd.DataFrame({"n_grams": [len(b) for b in found], "log_ratio": [round(float(w[b].sum()), 6) for b in found]})

    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.xxhash64(text)), 11) + 0.5) / float(1 << 53)
    scored = docs.select(F.col(doc_id).alias("doc_id"), uniform.alias("_u"), score(F.col(text)).alias("_s"))
    key = F.when(F.col("_s.n_grams") > 0, F.col("_s.log_ratio") - F.log(-F.log("_u"))).otherwise(float("-inf"))
    return scored.select("doc_id", "_s.n_grams", "_s.log_ratio", key.alias("gumbel_key"))


def resample(weighed: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` rows of the largest keys (Gumbel top-k: a sample without
    replacement in proportion to the ratios), with their rank. Rows without
    n-grams are never drawn, so fewer may be kept. Equal keys are ordered by id;
    the order is found by a range sort, not in one task."""
    drawn = frozen(weighed, "keys").where(F.col("n_grams") > 0)  # stored, since a range sort reads its rows twice
    ranked = with_global_rank(drawn, [F.desc("gumbel_key"), F.asc("doc_id"), F.asc("n_grams")], "weights")
    return ranked.where(F.col("rank") < keep)


@clash_free
def sample_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", target_rows: int = TARGET_ROWS) -> DataFrame:
    """Resample documents towards those labelled good and not toxic.

    The target model is fitted on at most ``target_rows`` labelled rows, chosen
    by a hash of the id; the raw model counts every row. As many rows are kept
    as the labels' share of good ones says. Repeated rows are separate rows.
    Without any good label the weights are 0 and nothing is kept.
    """
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    marked = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id").alias("_label_id"), F.coalesce(good, F.lit(False)).alias("_good"))
    share = marked.agg(F.avg(F.col("_good").cast("double"))).first()[0] or 0.0
    chosen = marked.where("_good").select("_label_id").distinct().orderBy(F.xxhash64("_label_id"), "_label_id").limit(target_rows)
    target = docs.join(F.broadcast(chosen), F.col(doc_id) == F.col("_label_id"), "left_semi")  # bounded by target_rows
    weights = log_weights(model_counts(target, text), model_counts(docs, text))
    return resample(weigh(docs, weights, doc_id, text), round(share * docs.count()))
