"""A corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  ``run`` applies them to the table, each stage written as
Parquet to the shared folder and read again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, jaccard_join, line_dedup, line_quality, sentence_pieces
from quarry.llm.common import col_of, stored, with_columns_of
from quarry.llm.queries import PIECES, tokenizer
from quarry.sources.tables import table


def _with_text(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` with a new text and, where there is such a column, its length."""
    given = {"doc_id": F.col("id"), "text": F.col(text), "n_chars": F.length(text).cast("long")}
    return with_columns_of(rows, docs.columns, **{c: v for c, v in given.items() if c in docs.columns})


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not among ``ids`` (a column doc_id); a null id is not."""
    left = docs.join(ids, "doc_id", "left_anti")
    return left.select(*[col_of(left, c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, and so do documents that are rejected."""
    judged = line_quality.judged(docs, carry=True)
    # A filter would move below the verdict and work it out a second time; a row that is kept is one element, any other none.
    kept = judged.select(F.inline(F.when(F.col("kept"), F.array(F.struct("row", "id", "cleaned")))))
    return _with_text(kept, docs, "cleaned")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller document keeps go; documents stay, also emptied ones."""
    return _with_text(line_dedup.dedup_lines(docs, carry=True), docs, "kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest document stays; rows without id stay."""
    found = jaccard_join.near_duplicates(docs)
    others = found.where("id <> component").select(F.col("id").alias("doc_id")).distinct()
    return _without(docs, others)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go; rows without id stay."""
    found = decontamination.all_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select(F.col("id").alias("doc_id")).distinct())


def sentence_piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of what is left, and whether they decode to the text."""
    out = sentence_pieces.round_trip(docs, tokenizer(PIECES))
    return out.select(F.col("id").alias("doc_id"), "n_chars", "n_tokens", "ids", F.col("same").alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard", near_duplicates),
    ("decontamination", decontaminate),
    ("sentence_pieces", sentence_piece_ids),
]
#: SQL can express neither the near-duplicate components in reasonable time nor the encoding; the tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}-{name}")
    return docs
