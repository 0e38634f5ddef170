"""Registered queries of this subpackage: opN_<name>, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, extraction, jaccard, media, mixing, nbsvm, negatives, packing, rules, secrets, substrings, toxicity
from .oracle import ORACLE_SQL as ORACLE_SQL
from .store import small_batches, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = stored(media.encode_media(table(spark, sf_dir, "documents")), "media")
    return media.media_features(written, arrays=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"select -1L conv_id, 0L turn, 'user' role, '{said}' text union all select -1L, 1L, 'assistant', '{said}'")
    events = chat.turn_events(rows.unionByName(probe))
    return chat.read_back(chat.render(chat.final_messages(events)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = rules.apply_rules(docs, rules.trusted_documents(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sizes = stored(mixing.sized(docs).drop("text"), "sizes")
    return mixing.mix_sized(sizes).select("doc_id", "size", "source_size", "target", "taken")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("row")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return stripped.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


_ALL = (
    op1_media_columns,
    op2_toxicity,
    op3_jaccard_join,
    op4_chat_formatting,
    op5_quality_rules,
    op6_quality_classifier,
    op7_source_mixing,
    op8_best_fit_packing,
    op9_secret_scan,
    op10_substring_dedup,
    op11_hard_negatives,
    op12_tokenizer_alignment,
    op13_html_extraction,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
