"""Line dedup: lines that many documents share stay in one document only.

Lines are exploded, normalised and hashed; distinct documents are counted per
hash; lines over the threshold are dropped, and each document is put together
again by line position.  DataFrame functions only.

Plan: one map-side combined aggregation per line hash, whose over-threshold
hashes are written; one join of the lines with these (a hot line is a skewed join
key, which adaptive execution splits, as both sides come from shuffles of their
own); one join of the positions with the documents.  No group of
lines or documents is collected; the only list is the dropped positions of one
document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CHARS, ascii_lower, col_of, let, others, stored


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE_CHARS)))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(col_of(docs, text_col), F.lit(""))
    return docs.select(col_of(docs, id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))


def keyed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per line whose key has at least ``min_chars`` code points: id, th (hash of the text), pos, and the key's two hashes."""
    lines = _texts(docs, id_col, text_col).where("id IS NOT NULL")
    lines = lines.select("id", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return lines.select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def shared_lines(lines: DataFrame, max_docs: int) -> DataFrame:
    """Hashes found in more than ``max_docs`` distinct documents, with the smallest document."""
    if max_docs == 1:  # more than one distinct document: the smallest and the largest differ
        over = F.min("id") != F.max("id")
    else:
        over = F.count_distinct("id") > max_docs
    return lines.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), over.alias("over")).where("over").drop("over")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                max_docs: int = 1, carry: bool = False) -> DataFrame:
    """Every row's text without the lines that other documents keep.

    A line's key is the line without white space at both ends, A-Z lower-cased.
    Keys of at least ``min_chars`` code points found in more than ``max_docs``
    documents lose all their lines except those of the smallest id.

    Returns one row per input row: id, n_lines, n_dropped, kept (text).
    Null or empty text: one empty line.  Null id: the row takes no part, its text
    stays.  Rows repeated with the same id count as one document.  Other input
    columns are ignored, or with ``carry`` kept in the struct ``row``.  Empty table: no rows.
    """
    lines = keyed_lines(docs, id_col, text_col, min_chars)
    over = stored(shared_lines(lines, max_docs), "lines")
    lost = (lines.join(over, ["h1", "h2"]).where(F.col("id") > F.col("keeper"))
            .groupBy("id", "th").agg(F.collect_set("pos").alias("lost")))
    carried = ["row"] if carry else []
    text = F.coalesce(col_of(docs, text_col), F.lit(""))
    rows = docs.select(*[others(docs, id_col, text_col) for _ in carried], col_of(docs, id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    rows = rows.join(lost, ["id", "th"], "left").select(*carried, "id", "text", F.coalesce("lost", F.array().cast("array<int>")).alias("lost"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1

    def kept(line_list: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(line_list) - 1), F.col("lost"))
        return F.array_join(F.transform(stay, lambda i: F.get(line_list, i)), "\n")

    text = F.when(F.size("lost") == 0, F.col("text")).otherwise(let(F.split("text", "\n", -1), kept))
    return rows.select(*carried, "id", n_lines.cast("long").alias("n_lines"), F.size("lost").cast("long").alias("n_dropped"), text.alias("kept"))

