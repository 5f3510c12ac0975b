"""Source divergence audit: how the words of each source of a language differ from other sources and from the language.

Terms are counted in Arrow compute inside ``mapInArrow``: lower case, a split at a
pattern, a dictionary of the terms, grouped counts.  A task hands on one row per
language, source and term, so a term that every document holds is a few rows.  Merged
counts are dealt out in shards by term: a shard holds its terms' counts in all sources as
columns and returns its share of every pair's sum and its first terms; Spark adds up
and ranks the shares.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_rows import slices
from .common import col_of, stored

#: Fixed value: what stands between terms, all ASCII but the letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]"
MIN_DOCS = 10
TOP_TERMS = 10
SCALE_STEPS, STEP = 3, 1000  # shares are in units of STEP ** -SCALE_STEPS
SLICE_BYTES = 4 << 20
HELD_ROWS = 300_000
SHARD_ROWS = 100_000
BLOCK_CELLS = 1 << 19

COUNTS = "lang string, source string, term string, n long, docs long"
SHARES = "lang string, source string, part string, item string, value long"


def _terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of some texts, and which text each is in."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=f"{BETWEEN}+")
    terms, at = pc.list_flatten(lists), pc.list_parent_indices(lists)
    filled = pc.not_equal(terms, "")
    return terms.filter(filled), at.filter(filled)


def _document_counts(texts: pa.Array) -> pa.Table:
    """Occurrences ``n`` of each term of each text (row number ``at``)."""
    terms, at = _terms(texts)
    words = terms.dictionary_encode()
    found = pa.table({"at": at, "code": words.indices}).group_by(["at", "code"]).aggregate([([], "count_all")])
    return pa.table({"at": found["at"], "term": words.dictionary.take(found["code"].combine_chunks()), "n": found["count_all"]})


def _pieces(text: str, size: int) -> list[str]:
    """A long text cut between terms, about ``size`` characters each; a longer term stays whole."""
    out, lo, between = [], 0, re.compile(BETWEEN)
    while len(text) - lo > size:
        cut = between.search(text, lo + size)
        if not cut:
            break
        out.append(text[lo:cut.start()])
        lo = cut.start()
    return [*out, text[lo:]]


def _slice_counts(part: pa.RecordBatch) -> pa.Table:
    """One row per language, source and term of a slice: n occurrences in docs documents."""
    texts = part.column("text")
    if part.num_rows == 1 and pc.binary_length(texts)[0].as_py() > SLICE_BYTES:
        found = pa.concat_tables([_document_counts(pa.array([p])) for p in _pieces(texts[0].as_py(), SLICE_BYTES)])
        found = found.group_by(["at", "term"]).aggregate([("n", "sum")]).rename_columns(["at", "term", "n"])
        found = found.set_column(0, "at", pa.array(np.zeros(found.num_rows, np.int64)))
    else:
        found = _document_counts(texts)
    at = found["at"].combine_chunks()
    rows = pa.table({"lang": part.column("lang").take(at), "source": part.column("source").take(at), "term": found["term"], "n": found["n"]})
    out = rows.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("n", "count")])
    return out.rename_columns(["lang", "source", "term", "n", "docs"])


def _partial_counts(batches):
    """Counts of a task's documents, added up as long as they are at most ``HELD_ROWS`` rows."""
    def merged(tables):
        out = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return out.rename_columns(["lang", "source", "term", "n", "docs"])

    held, rows = [], 0
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            held.append(_slice_counts(part))
            rows += held[-1].num_rows
            if rows > HELD_ROWS:
                held = [merged(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS // 2:
                    yield from held.pop().combine_chunks().to_batches(max_chunksize=20_000)
                    rows = 0
    if held:
        yield from merged(held).combine_chunks().to_batches(max_chunksize=20_000)


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it).

    Terms are maximal runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased.
    Null text, language and source are ''.  Ids and other columns are ignored, so that a
    repeated row counts as often as it stands there.  A text over ``SLICE_BYTES`` is read in pieces.  Empty table: no rows.
    """
    rows = docs.select(*[F.coalesce(col_of(docs, c).cast("string"), F.lit("")).alias(n)
                         for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    return rows.mapInArrow(_partial_counts, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)), exact for totals up to 9e15: long division, three digits a step."""
    rest, whole = np.asarray(count, np.int64) + 2, np.asarray(total, np.int64) + 2 * terms
    out = np.zeros(np.broadcast(rest, whole).shape, np.int64)
    for _ in range(SCALE_STEPS):
        rest = rest * STEP
        out = out * STEP + rest // whole
        rest = rest % whole
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))."""
    return (p - q) ** 2 // (p + q)


def _pair_sums(at: np.ndarray, term: np.ndarray, n: np.ndarray, totals: np.ndarray, n_terms: int, size: int) -> np.ndarray:
    """Sums of the divergences of all pairs of sources over a shard's terms, in blocks of terms."""
    order = np.argsort(term, kind="stable")
    at, term, n = at[order], term[order], n[order]
    sums, width = np.zeros((len(totals), len(totals)), np.int64), max(1, BLOCK_CELLS // len(totals))
    for lo in range(0, size, width):
        hi = min(size, lo + width)
        a, b = np.searchsorted(term, [lo, hi])
        counts = np.zeros((len(totals), hi - lo), np.int64)
        counts[at[a:b], term[a:b] - lo] = n[a:b]
        p = share(counts, totals[:, None], n_terms)
        for k in range(len(totals) - 1):
            sums[k, k + 1:] += divergence(p[k], p[k + 1:]).sum(axis=1)
    return sums


def _first_terms(at: np.ndarray, term: np.ndarray, p: np.ndarray, q: np.ndarray, words: pa.Array, top: int) -> pa.Table:
    """Each source's terms with p > q, the ``top`` of greatest divergence."""
    over = np.flatnonzero(p > q)
    rows = pa.table({"at": at[over], "item": words.take(pa.array(term[over])), "value": divergence(p[over], q[over])})
    rows = rows.sort_by([("at", "ascending"), ("value", "descending"), ("item", "ascending")])
    source = rows["at"].to_numpy()
    return rows.filter(pa.array(np.arange(len(source)) - np.searchsorted(source, source) < top))


def _shard_shares(top: int):
    def shares(key: tuple[pa.Scalar, ...], counts: pa.Table, groups: pa.Table) -> pa.Table:
        """One shard: counts (source, term, n) of its terms; groups (source, total, n_terms, lang_total) of the language."""
        names = pc.unique(groups["source"]).sort()
        groups = groups.take(pc.sort_indices(groups["source"]))
        totals, n_terms, whole = groups["total"].to_numpy(), groups["n_terms"][0].as_py(), groups["lang_total"][0].as_py()
        at = pc.index_in(counts["source"], value_set=names).to_numpy().astype(np.int64)
        coded = counts["term"].combine_chunks().dictionary_encode()
        term, n = coded.indices.to_numpy().astype(np.int64), counts["n"].to_numpy()
        of_lang = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(of_lang, term, n)
        first = _first_terms(at, term, share(n, totals[at], n_terms), share(of_lang, whole, n_terms)[term], coded.dictionary, top)
        sums = _pair_sums(at, term, n, totals, n_terms, len(of_lang))
        a, b = np.triu_indices(len(totals), 1)
        size = len(a) + first.num_rows
        return pa.table({
            "lang": pa.array([key[0].as_py()] * size, pa.string()),
            "source": pa.concat_arrays([names.take(pa.array(a)), names.take(first["at"].combine_chunks())]),
            "part": pa.array(["pair"] * len(a) + ["term"] * first.num_rows, pa.string()),
            "item": pa.concat_arrays([names.take(pa.array(b)), first["item"].combine_chunks().cast(pa.string())]),
            "value": pa.concat_arrays([pa.array(sums[a, b]), first["value"].combine_chunks()])})
    return shares


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, lang_col: str = "lang", source_col: str = "source",
          text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: what tells each source of a language from the others.

    A language keeps the V terms that at least ``min_docs`` of its documents hold.  A
    group (source or whole language) gives a kept term the share p = 1 + floor(10^9 * (count + 2) / (N + 2 V)), N being its
    occurrences of kept terms.  Part ``pair``: item is another source, value the sum of floor((p - q)^2 / (p + q)) over
    all kept terms, 0 where none is kept.  Part ``term``: item is a kept term that the source holds
    with a greater share than the language; the ``top`` of greatest value.  rank counts from 1 per source and
    part: value descending, ties by item in byte order.

    Sources that hold no term are there as well; a language of one source has no pairs.  Odd
    input as in ``term_counts``.  Counts and shares are stored; a shard is a group of about ``SHARD_ROWS`` counts and the language's sources.
    Results hold a row per ordered pair of sources, so the sources of one language are bounded by that.
    """
    counts = stored(term_counts(docs, lang_col, source_col, text_col), "source-terms")
    kept_terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    kept = stored(counts.join(kept_terms, ["lang", "term"]).drop("docs"), "source-kept")
    n_shards = kept.count() // SHARD_ROWS + 1
    sizes = kept.groupBy("lang").agg(F.sum("n").alias("lang_total")).join(kept_terms.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms")), "lang")

    occurring = docs.select(*[F.coalesce(col_of(docs, c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col))]).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = occurring.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = stored(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "n_terms", "lang_total"), "source-groups")

    dealt = kept.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(n_shards)))
    sent = dealt.select(F.col("lang").alias("of_lang"), F.col("shard").alias("to_shard")).distinct()
    sent = sent.join(groups.withColumnRenamed("lang", "of_lang"), "of_lang")
    shares = dealt.groupBy("lang", "shard").cogroup(sent.groupBy("of_lang", "to_shard")).applyInArrow(_shard_shares(top), SHARES)
    shares = stored(shares, "source-shares")

    pairs = shares.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "value", F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))))
    bare = groups.where("n_terms IS NULL").select("lang", "source")  # languages without a kept term: all sums are 0
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").unionByName(
        none.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value")))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs.unionByName(shares.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
