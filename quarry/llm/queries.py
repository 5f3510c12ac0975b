"""The registered query of each operator: thin digests of the operators' results over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import table

from . import (decontamination, filter_audit, jaccard_join, line_dedup, line_quality, order_minhash, quotations, repeated_bytes, secrets_scan,
               sentence_pieces, source_divergence, token_counts, warc)

PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"
MAX_TOKENS = 2048
PAGE_DATE = "2024-01-01T00:00:00Z"  # the pages have none


def tokenizer(name: str) -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of ``pages``, each seen as the payload of a response."""
    out = warc.derivatives(warc.responses(table(spark, sf_dir, "pages"), PAGE_DATE))
    return out.withColumnRenamed("key", "page_id")


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first cleaning over ``documents``: base counts, base verdict, method verdict."""
    out = line_quality.judged(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "n_bad_lines", "kept_chars")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over ``documents``: lines before, lines dropped, hash of the kept text."""
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of ``benchmark``, a few words substituted at most."""
    out = decontamination.all_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_matched", "n_window")


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of ``documents``, and whether decoding gives the text back."""
    out = sentence_pieces.round_trip(table(spark, sf_dir, "documents"), tokenizer(PIECES))
    return out.select(F.col("id").alias("doc_id"), "n_chars", "n_tokens", "ids", F.col("same").alias("round_trip"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in ``documents``: the base patterns, and strings that pass for random data."""
    out = secrets_scan.scan(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["order"] == k)).cast("long")
    return out.select(F.col("id").alias("doc_id"), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                      F.sha2(secrets_scan.span_text(F.col("base")), 256).alias("base_sha256"), secrets_scan.span_text(F.col("spans")).alias("spans"))


def op7_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of ``conversations`` without quotes, with their threads, parents and depths."""
    out = quotations.reply_ordered(table(spark, sf_dir, "conversations"))
    return out.select(F.col("conv").alias("conv_id"), "thread", "turn", "depth", "parent", "role", "text", "n_quotes", "n_linked")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``: five-word shingles, Jaccard similarity of 0.8 or more."""
    out = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of ``documents``, and whether a text is over the limit."""
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer(WORDS))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` in 50-byte strings that a smaller document holds, cut out."""
    out = repeated_bytes.cut_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes from ``documents``, per language, in every order of the filters."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of ``documents`` and of their edited texts, and how alike they are to each other and to the next document's."""
    out = order_minhash.compare_with_next(table(spark, sf_dir, "documents"))
    return out.withColumnRenamed("id", "doc_id")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the words of each source of ``documents`` differ from other sources of its language, and which words stand out."""
    return source_divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc_derivatives, op2_line_quality, op3_line_dedup, op4_decontamination, op5_sentence_pieces, op6_secret_scan,
                                   op7_quotations, op8_jaccard_join, op9_token_counts, op10_repeated_bytes, op11_filter_audit, op12_order_minhash,
                                   op13_source_divergence)}
