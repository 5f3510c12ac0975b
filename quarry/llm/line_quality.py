"""Quality rules, line first: bad lines go, then documents that lost too much.

Every line is judged by three rules (punctuation, navigation, boilerplate);
failing lines are removed, and a document that loses more than a given share of
its characters is rejected, as is one that fails the base rules on its words.
All of it is row-local: DataFrame functions, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WHITE_CHARS, col_of, let, others, words_of

#: How a sentence ends (a mark of any script, closing marks, then a blank or the end; full stops of scripts without
#: blanks stand alone), what marks noise inside a line, what separates navigation links.
SENTENCE_END = r"[.!?…:;։؟۔।॥།༎။።፧፨។៕︒．：；][\"'”’»›)\]」』）】》〉]*([\x20\x09-\x0D]|$)|[。！？｡]"
NOISE = r"!!|\?\?|[#*$%&|<>]"
SEPARATOR = r"[|»›•·]"
SYMBOLS = r"[#*$%&|<>]"
#: Phrases of page furniture, lower case.
BOILERPLATE = [
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "click here",
    "sign up", "log in", "subscribe now", "subscribe to our", "enable javascript", "powered by", "lorem ipsum",
    "share this", "skip to content", "back to top", "read more", "copyright (c)", "©",
]
#: The phrases as they stand, and where no letter or digit touches their first or last letter.
PHRASE = "|".join(p.replace("(", r"\(").replace(")", r"\)") for p in BOILERPLATE)
WHOLE_PHRASE = rf"(?:(?<![\p{{L}}\p{{N}}])|(?=©))(?:{PHRASE})(?:(?![\p{{L}}\p{{N}}])|(?<=[©)]))"
MAX_PHRASE_PERCENT = 50
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_NOISE_PERCENT = 20
MIN_SEPARATORS = 3
MAX_LOST_PERCENT = 50


def n_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def chars_in_words(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[{WHITE}]+", ""))


def line_passes(line: Column) -> Column:
    """The three rules on one line that has a word; boilerplate fails a line that mostly consists of it."""
    bare = F.btrim(line, F.lit(WHITE_CHARS))
    n_words = n_matches(bare, f"[{WHITE}]+") + 1
    noise = n_matches(bare, NOISE)
    # One sign spoils no line; more are held against the words, or the characters of a line without blanks.
    clean = (noise <= 1) | (100 * noise <= MAX_NOISE_PERCENT * F.when(n_words == 1, F.length(bare)).otherwise(n_words))
    punctuation = bare.rlike(SENTENCE_END) & clean
    navigation = n_matches(bare, SEPARATOR) < MIN_SEPARATORS
    return punctuation & navigation & ~mostly_boilerplate(bare)


def mostly_boilerplate(bare: Column) -> Column:
    """Whether more than half of a line's letters, digits and signs are in boilerplate phrases."""
    def share(t: Column) -> Column:
        whole = chars_in_words(t)
        return 100 * (whole - chars_in_words(F.regexp_replace(t, WHOLE_PHRASE, ""))) > MAX_PHRASE_PERCENT * whole

    return F.lower(bare).rlike(PHRASE) & let(F.lower(bare), share)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, the first occurrence included.

    Windows are hashed and sorted with their positions; equal neighbours are
    repeats, and the positions that they cover are counted from left to right.
    """
    def windows(w: Column) -> Column:
        return F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p"))))

    def covered(s: Column) -> Column:
        h = lambda j: F.get(s, j)["h"]
        again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (h(j) == h(j - 1)) | (h(j) == h(j + 1)))
        at = F.sort_array(F.transform(again, lambda j: F.get(s, j)["p"]))
        return F.aggregate(at, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
                           lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + F.least(F.lit(3), p + 3 - a["end"])).alias("n")),
                           lambda a: a["n"])

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows(w), covered)))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           max_lost_percent: int = MAX_LOST_PERCENT, carry: bool = False) -> DataFrame:
    """One row per input row: id, text, the base counts, cleaned (text of the lines that pass) and the verdict.

    Words are maximal runs of characters other than white space.  n_words,
    word_chars (code points in words), n_symbols, n_dup_lines (lines with a word
    that equal an earlier line), n_repeat_words, base_failed (under 50 words, or
    over half of them in repeated windows), n_bad_lines, kept_chars, kept.
    Null or empty text: all counts 0, base_failed, not kept.  Lines without a word
    stay and count nothing.  Null ids and repeated rows are judged like any row.
    Other input columns are ignored, or with ``carry`` kept in the struct ``row``.
    Empty table: no rows.
    """
    carried = ["row"] if carry else []
    rows = docs.select(*[others(docs, id_col, text_col) for _ in carried], col_of(docs, id_col).alias("id"),
                       F.coalesce(col_of(docs, text_col), F.lit("")).alias("text"))
    rows = rows.select(*carried, "id", "text", words_of(F.col("text")).alias("words"), F.split("text", "\n", -1).alias("lines"))

    def blank(line: Column) -> Column:
        return F.btrim(line, F.lit(WHITE_CHARS)) == ""

    def twice(lines: Column) -> Column:
        return F.size(lines) - F.size(F.array_distinct(lines))

    rows = rows.select(
        *carried, "id", "text", F.size("words").cast("long").alias("n_words"), chars_in_words(F.col("text")).cast("long").alias("word_chars"),
        n_matches(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        let(F.filter("lines", lambda x: ~blank(x)), twice).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"), F.filter("lines", lambda x: blank(x) | line_passes(x)).alias("good"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.select("*", base_failed.alias("base_failed"), (F.col("n_lines") - F.size("good")).cast("long").alias("n_bad_lines"),
                       F.array_join("good", "\n").alias("cleaned"))
    rows = rows.select("*", F.when(F.col("n_bad_lines") == 0, F.col("word_chars"))
                       .otherwise(chars_in_words(F.col("cleaned"))).cast("long").alias("kept_chars"))
    enough = 100 * (F.col("word_chars") - F.col("kept_chars")) <= max_lost_percent * F.col("word_chars")
    return rows.select(*carried, "id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                       "n_bad_lines", "kept_chars", "cleaned", (~F.col("base_failed") & enough).alias("kept"))
