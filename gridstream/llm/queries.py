"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstream.llm import fm_index, html_lines, importance, infilling, jaccard, langid, line_dedup, media, oracles, packing, sentence_spans, simhash, spelling, training_order
from gridstream.llm.common import frozen, shared_dir, table


def op1_html_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_lines.extract_main_text(pages)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wave files and feature tensors of every text, stored, read back and described."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    waves = frozen(media.encode_media(docs).drop("text"), "waves")
    described = frozen(media.with_tensors(media.payload_digest(waves)).drop("media"), "tensors")
    return media.tensor_features(described)


def held_out() -> F.Column:
    """The fold that language identification must not learn from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.learn(docs, ~held_out() & F.col("doc_id").isNotNull())
    return langid.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more that three documents share, dropped but in the last."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary files lie."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot, shard and place of every token sequence, read back from the shard files."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = training_order.sequences(docs, tokenizer_path())
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    return training_order.shards(training_order.with_slots(rows, key=20240607), path=path)


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents resampled towards the labelled good ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.sample_documents(docs, table(spark, sf_dir, "labels"))


def op6_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text that lie in windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fm_index.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = fm_index.n_hit(F.col("spans"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without the sentences of repeated runs of two sentences and 20 words or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = sentence_spans.dedup_spans(docs)
    return kept.select("doc_id", "n_sentences", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.token_pieces(docs, tokenizer_path()))


def op11_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut into prefix, middle and suffix by its id, put together anew, and rebuilt."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = frozen(infilling.framed(docs), "framed-texts", level=1)
    return infilling.digested(infilling.infilled(stored))


def op12_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of shingles and component of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.similar_sets(docs).select("doc_id", "n_shingles", "component_id")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all texts with their near words, forms and roots."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(frozen(spelling.word_counts(docs), "vocabulary"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_lines": op1_html_lines,
    "op2_media": op2_media,
    "op3_training_order": op3_training_order,
    "op4_line_dedup": op4_line_dedup,
    "op5_importance": op5_importance,
    "op6_fm_index": op6_fm_index,
    "op7_sentence_spans": op7_sentence_spans,
    "op8_simhash": op8_simhash,
    "op9_best_fit": op9_best_fit,
    "op10_langid": op10_langid,
    "op11_infilling": op11_infilling,
    "op12_jaccard": op12_jaccard,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = oracles.ORACLES
