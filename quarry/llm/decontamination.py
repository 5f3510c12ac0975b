"""Benchmark decontamination by spaced seeds, in DataFrame functions.

Texts and benchmark items become words (runs of letters and digits, lower case; in scripts
written without blanks every character is one).
A mask reads some of eight neighbouring words and ignores the others; its hash over
every place of the corpus is joined with those of the benchmark.  Around each hit
the text is laid along the item word by word, and the best window of the item
decides: it must agree but for a few substituted words.  The two masks meet every such
window somewhere (the tests try all places of substitutions), so nothing is lost by seeding.
Items too short for the masks are found whole and unchanged, by a hash of all their words.

Plan: one scan and no shuffle of the corpus.  Places are exploded, hashed and
looked up inside one code-generated stage, in a sieve of bits of the benchmark's hashes (``MAX_BITS`` at most);
what it lets through leaves with the words around it, and is joined with the benchmark's places by shuffles, which decide.
The benchmark is taken in blocks whose text is measured to be at most ``BLOCK_BYTES``, one after another:
a larger benchmark takes more passes, not more memory.  Equal texts are searched once for all their items.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col_of, let, stored

#: The words that each mask reads, from its place on.
MASKS = [[0, 1, 3, 4, 7], [0, 3, 5, 6, 7]]
WINDOW = 13
MIN_ITEM_WORDS = 9
AROUND = WINDOW - 8  # words that a window may have before a mask's place, or after its eight words
BLOCK_BYTES = 1 << 24
SEED_BITS, MAX_BITS = 64, 1 << 28  # of a sieve: for each hash, and in all
NO_BLANKS = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}])"


def tokens(text: Column) -> Column:
    spaced = F.when(F.length(text) == F.octet_length(text), text).otherwise(F.regexp_replace(text, NO_BLANKS, " $1 "))
    return F.split(F.lower(spaced), r"[^\p{L}\p{N}]+")


def substitutions(window: Column) -> Column:
    """How many words of a window may differ: 2 of 13, in a shorter item one of each 6."""
    return F.when(window >= WINDOW, F.lit(2)).otherwise(F.floor(window / 6).cast("int"))


def _seeds(words: str, at: str) -> Column:
    """The masks' hashes at one place of a word list."""
    place = lambda k: F.get(F.col(words), F.col(at) + k)
    return F.array(*[F.xxhash64(F.lit(m), *[place(k) for k in mask]) for m, mask in enumerate(MASKS)])


def _best(words: Column, item: Column, shift: Column, window: Column) -> Column:
    """Most words that agree in a window of the item when the text is laid along it (text place = item place + shift)."""
    def agreeing(w: Column) -> Column:
        lo, hi = F.greatest(F.lit(0), -shift), F.least(F.size(item), F.size(w) - shift) - 1
        return F.when(hi - lo + 1 >= window, F.array_join(
            F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda t: F.when(F.get(item, t) == F.get(w, t + shift), "1").otherwise("0")), ""))

    def best(flags: Column) -> Column:
        return F.array_max(F.transform(F.sequence(F.lit(1), F.length(flags) - window + 1),
                                       lambda s: F.length(F.replace(F.substring(flags, s, window), F.lit("0"), F.lit("")))))

    return let(agreeing(words), lambda f: F.when(f.isNotNull(), best(f)))


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """item, item_words, size: each id with each of its texts; null ids take no part."""
    items = benchmark.select(col_of(benchmark, item_col).alias("item"), F.filter(tokens(col_of(benchmark, item_text_col)), lambda x: x != "").alias("item_words"),
                             F.octet_length(col_of(benchmark, item_text_col)).alias("size")).where(F.col("item").isNotNull())
    return items.groupBy("item", "item_words").agg(F.max("size").alias("size"))


def _texts(items: DataFrame) -> DataFrame:
    """item_words, first, version, size: each text once; its least item and its hash name it."""
    return items.groupBy("item_words").agg(F.min("item").alias("first"), F.max("size").alias("size")).withColumn("version", F.xxhash64("item_words"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col_of(docs, id_col).alias("id"), tokens(col_of(docs, text_col)).alias("words")).where("id IS NOT NULL")


def _marks(h: Column) -> Column:
    """The three bits of a hash in its word of a sieve."""
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, at).cast("int"))
    return bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52))


def _sieve(seeds: DataFrame):
    """Whether a hash may be among the ``h`` of a table; false for nearly all others."""
    n = seeds.select("h").distinct().count()
    words = 1 << (min(MAX_BITS, max(1 << 10, SEED_BITS * n)) - 1).bit_length() - 6
    word = lambda h: h.bitwiseAND(F.lit(words - 1)).cast("int")
    found = seeds.groupBy(word(F.col("h")).alias("word")).agg(F.bit_or(_marks(F.col("h"))).alias("marks")).toArrow()  # one row per word, at most
    bits = np.zeros(words, dtype=np.int64)
    bits[found["word"].to_numpy()] = found["marks"].to_numpy()
    sieve = seeds.sparkSession.createDataFrame(pa.table({"bits": pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array(bits))})).scalar()
    return lambda h: F.get(sieve, word(h)).bitwiseAND(_marks(h)) == _marks(h)


def _searched(items: DataFrame, places: DataFrame, around: Column, seeds_of, hits_of) -> DataFrame:
    """id, item, n_matched, n_window: the best of each document and item among the joined places.

    ``places``: id, words, i, h; ``around``: what goes with a place that the sieve lets through; ``seeds_of`` turns texts into their
    places (first, version, h, ..), ``hits_of`` joined places with their item_words into (id, first, version, n_matched, n_window).
    """
    texts = _texts(items)
    blocks = int((texts.agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES) + 1

    def searched(k: int) -> DataFrame:
        seeds = seeds_of(texts.where(F.pmod(F.xxhash64("item_words"), F.lit(blocks)) == k))
        let_through = places.where(_sieve(seeds)(F.col("h"))).select("id", "i", "h", around.alias("around"))
        hits = hits_of(let_through.join(seeds, "h").join(texts.select("first", "version", "item_words"), ["first", "version"]))
        hits = hits.groupBy("id", "first", "version").agg(F.max("n_matched").cast("long").alias("n_matched"), F.max("n_window").cast("long").alias("n_window"))
        return hits if blocks == 1 else stored(hits, "overlaps")  # one sieve at a time

    hits = reduce(DataFrame.unionByName, [searched(k) for k in range(blocks)])
    named = items.select("item", "item_words").join(texts.select("item_words", "first", "version"), "item_words").select("item", "first", "version")
    return (hits.join(named, ["first", "version"]).groupBy("id", "item")
            .agg(F.max("n_matched").alias("n_matched"), F.max("n_window").alias("n_window")))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
             item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it overlaps: id, item, n_matched, n_window.

    A document overlaps an item if n_window words of the item in a row (13, or the
    whole of a shorter item) stand in the document at the same distances, all but the
    allowed substitutions equal; n_matched is the best count.  Items of fewer than
    ``MIN_ITEM_WORDS`` words match nothing here, see ``short_overlaps``.  Null
    texts have no words; null ids take no part, in either table.  Repeated rows give
    one result row.  Other input columns are ignored.  An empty table on either side
    gives no rows.
    """
    rows = _rows(docs, id_col, text_col)
    places = rows.where(F.size("words") >= MIN_ITEM_WORDS).select("id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - 8)).alias("i"))
    places = places.select("id", "words", "i", F.explode(_seeds("words", "i")).alias("h"))
    items = _items(benchmark, item_col, item_text_col).where(F.size("item_words") >= MIN_ITEM_WORDS)

    def around(words: str, at: str) -> Column:
        """All words of the windows that hold the mask's eight."""
        before = F.least(F.col(at), F.lit(AROUND))
        return F.slice(words, F.col(at) - before + 1, before + 8 + AROUND)

    def seeds(texts: DataFrame) -> DataFrame:
        placed = texts.select("first", "version", "item_words", F.explode(F.sequence(F.lit(0), F.size("item_words") - 8)).alias("j"))
        return placed.select("first", "version", "j", F.explode(_seeds("item_words", "j")).alias("h"))

    def hits(joined: DataFrame) -> DataFrame:
        shift = F.least("i", F.lit(AROUND)) - F.least("j", F.lit(AROUND))
        window = F.least(F.lit(WINDOW), F.size("item_words"))
        best = joined.select("id", "first", "version", window.alias("n_window"), _best(F.col("around"), around("item_words", "j"), shift, window).alias("n_matched"))
        return best.where(F.col("n_matched") >= F.col("n_window") - substitutions(F.col("n_window")))

    return _searched(items, places, around("words", "i"), seeds, hits)


def short_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text") -> DataFrame | None:
    """Like ``overlaps``, for the items of 1 to ``MIN_ITEM_WORDS`` - 1 words: a document overlaps one if it holds all its words in a row.

    n_matched and n_window are the item's words.  None where the benchmark has no such item.
    """
    items = _items(benchmark, item_col, item_text_col).where(F.size("item_words").between(1, MIN_ITEM_WORDS - 1))
    sizes = sorted(r[0] for r in items.select(F.size("item_words")).distinct().collect())
    if not sizes:
        return None
    rows = _rows(docs, id_col, text_col)
    places = rows.where(F.size("words") >= sizes[0]).select("id", "words", F.explode(F.sequence(F.lit(0), F.size("words") - sizes[0])).alias("i"))
    hashes = F.array(*[F.xxhash64(F.lit(n), *[F.get(F.col("words"), F.col("i") + k) for k in range(n)]) for n in sizes])
    places = places.select("id", "words", "i", F.explode(hashes).alias("h"))
    n = F.size("item_words")

    def seeds(texts: DataFrame) -> DataFrame:
        key = F.coalesce(*[F.when(n == m, F.xxhash64(F.lit(m), *[F.get(F.col("item_words"), F.lit(j)) for j in range(m)])) for m in sizes])
        return texts.select("first", "version", key.alias("h"))

    def hits(joined: DataFrame) -> DataFrame:
        return joined.where(F.slice("around", F.lit(1), n) == F.col("item_words")).select("id", "first", "version", n.alias("n_matched"), n.alias("n_window"))

    return _searched(items, places, F.slice("words", F.col("i") + 1, F.lit(sizes[-1])), seeds, hits)


def all_overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 item_text_col: str = "text") -> DataFrame:
    """``overlaps`` of the long items and ``short_overlaps`` of the others."""
    columns = (id_col, text_col, item_col, item_text_col)
    short, long = short_overlaps(docs, benchmark, *columns), overlaps(docs, benchmark, *columns)
    if short is None:
        return long
    # An item id may have a long and a short text.
    return long.unionByName(short).groupBy("id", "item").agg(F.max(F.struct("n_window", "n_matched")).alias("m")).select("id", "item", "m.n_matched", "m.n_window")
