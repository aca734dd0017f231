"""A corpus pipeline of five operators; each stage works on what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``, with ``n_chars`` brought up to date where
the text changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstream.llm import fm_index, langid, line_dedup, packing, simhash
from gridstream.llm.common import clash_free, frozen, table
from gridstream.llm.queries import held_out, tokenizer_path

LEAST = 0.4  # probability of the best language, below which a text is in none


def _as_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    length = F.char_length("text").cast("long")
    return docs.withColumn("n_chars", length).select(columns) if "n_chars" in columns else docs.select(columns)


@clash_free
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language the network can tell: null texts, texts without
    a letter, and texts of which no language has LEAST of the probability go.
    Where no row has a label, every text with a letter stays."""
    model = langid.learn(docs, ~held_out() & F.col("doc_id").isNotNull())
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = langid.identify(docs, model, label="_lang", score="_sure")
    return told.where((F.col("_lang") != langid.UNKNOWN) & (F.col("_sure") >= LEAST)).select(docs.columns)


@clash_free
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that three documents share, but in the last one. Documents stay, if with fewer lines."""
    return _as_documents(line_dedup.dedup_lines(docs).withColumn("text", F.col("kept")), docs.columns)


@clash_free
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, keep the document of the smallest id."""
    return simhash.first_of_groups(docs)


@clash_free
def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the words of benchmark windows out of the texts; texts left without a word go."""
    found = fm_index.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    left = (F.size("spans") == 0) | (fm_index.n_hit(F.col("spans")) < F.col("n_words"))
    return _as_documents(fm_index.without_spans(found.where(left)), docs.columns)


@clash_free
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every token piece in sequences of at most 2048 tokens."""
    return packing.pack(packing.token_pieces(docs, tokenizer_path()))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None  # a trained network and a tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = frozen(docs, f"pipeline-{name}")
    return docs
