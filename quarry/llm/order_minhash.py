"""Document fingerprints by order MinHash: signatures that follow edit distance, not only common pieces.

A text's k-mers are numbered by occurrence, so that repeats count.  Each of the hash functions
picks the ``PICKED`` least numbered k-mers; in the order in which they stand in the text they are
hashed to one entry of the fingerprint.  Two texts agree in an entry if the same k-mers were
picked and stand in the same order, which moved or replaced passages break.

``compare_with_next`` also fingerprints each text with its end replaced by the
next document's start.  Documents are dealt out in runs of neighbours, a run a
stretch of ids, and every text moves once.  The first text of a run is also sent to the run before.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col_of

KMER = 8  # code points, a power of two
PICKED = 2
ENTRIES = 64
DIGITS = 8  # hexadecimal digits of an entry
BLOCK = 4096  # k-mers that meet all hash functions at a time
PASS_SIZE = 1 << 20  # k-mers of a text that are numbered at a time
RUN_BYTES = 8 << 20
RUNS_A_TASK = 16  # runs are dealt out by hash: with many a task, tasks are about as long as each other
MAX_RUNS = 1 << 16
OUT_ROWS = 500

FINGERPRINTS = "id long, n_chars long, fingerprint string"
COMPARED = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_NONE = np.uint32(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit number to a random-looking one, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


_SEEDS = mixed(np.arange(1, ENTRIES + 1, dtype=np.uint64) * ODD)
#: The hash functions: a numbered k-mer v of 32 bits becomes (v ^ MASKS[i]) * FACTORS[i].
MASKS = _SEEDS.astype(np.uint32)[:, None]
FACTORS = mixed(_SEEDS).astype(np.uint32)[:, None] | np.uint32(1)


def _kmers(text: str, lo: int, hi: int) -> np.ndarray:
    """Hashes of the k-mers that start at lo to hi - 1; a text shorter than a k-mer is one.

    The hash is a polynomial of the code points: those of 2, 4 and 8 of them come from two halves.
    """
    width, odd = min(KMER, len(text)), int(ODD)
    h = np.frombuffer(text[lo:hi + width - 1].encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    half, powers = 1, [np.uint64(pow(odd, j, 1 << 64)) for j in range(KMER)]
    if width < KMER:
        h = np.add.reduce(h * np.array(powers[:width][::-1]), keepdims=True)
    else:
        while half < KMER:
            h = h[:-half] * powers[half] + h[half:]
            half *= 2
    return mixed(h + np.uint64(width * pow(odd, width, 1 << 64) % (1 << 64)))


def _numbered(h: np.ndarray) -> np.ndarray:
    """k-mer hashes, in text order, with their occurrence number mixed in, as 32 bits.

    Sorting the hash above the position puts equal k-mers side by side in text order.
    """
    bits = np.uint64(max(1, int(len(h)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64))
    again = np.flatnonzero((key[1:] ^ key[:-1]) <= low) + 1  # places of k-mers that stood before
    out = h.copy()
    if len(again):
        first = np.concatenate([[True], again[1:] != again[:-1] + 1])
        begins = np.maximum.accumulate(np.where(first, np.arange(len(again)), 0))
        out[(key[again] & low).astype(np.int64)] += (np.arange(len(again)) - begins + 1).astype(np.uint64) * ODD
    return (mixed(out) >> np.uint64(32)).astype(np.uint32)


class _Least:
    """For each hash function the ``PICKED`` least values of every block, where they stand and the k-mer there."""

    def __init__(self):
        self.values, self.places, self.kmers = [], [], []

    def add(self, numbered: np.ndarray, at: np.ndarray, kmers: np.ndarray) -> None:
        every, work = np.arange(ENTRIES), np.empty((ENTRIES, min(BLOCK, len(numbered))), np.uint32)
        for lo in range(0, len(numbered), BLOCK):
            part = numbered[None, lo:lo + BLOCK]
            x = work[:, :part.shape[1]]
            np.multiply(np.bitwise_xor(part, MASKS, out=x), FACTORS, out=x)
            for _ in range(min(PICKED, x.shape[1])):
                k = x.argmin(axis=1)
                self.values.append(x[every, k])
                self.places.append(at[lo + k])
                self.kmers.append(kmers[lo + k])
                x[every, k] = _NONE

    def entries(self) -> np.ndarray:
        """The k-mers of the least values, in text order, hashed to one number for each function."""
        out = np.zeros(ENTRIES, np.uint64)
        if self.values:
            values, places, kmers = (np.stack(c, axis=1) for c in (self.values, self.places, self.kmers))
            if values.shape[1] > PICKED:
                least = np.lexsort((places, values), axis=1)[:, :PICKED]
                places, kmers = (np.take_along_axis(c, least, 1) for c in (places, kmers))
            kmers = np.take_along_axis(kmers, np.argsort(places, axis=1), 1)
            for j in range(kmers.shape[1]):
                out = mixed(out * ODD + kmers[:, j] + np.uint64(1))
        return (out >> np.uint64(64 - 4 * DIGITS)).astype(">u4")


def entries_of(text: str) -> np.ndarray:
    """The entries of one text's fingerprint.

    A text of more than ``PASS_SIZE`` k-mers is read once per so many k-mers, each pass numbering a part of the
    k-mers' hashes, so that the memory beside the text does not grow with it.
    """
    n, least = max(1, len(text) - KMER + 1) if text else 0, _Least()
    passes = -(-n // PASS_SIZE)
    for k in range(passes):
        found = []
        for lo in range(0, n, PASS_SIZE):
            h, at = _kmers(text, lo, min(n, lo + PASS_SIZE)), np.arange(lo, min(n, lo + PASS_SIZE))
            mine = h % np.uint64(passes) == k if passes > 1 else slice(None)
            found.append((h[mine], at[mine]))
        h, at = found[0] if passes == 1 else (np.concatenate(c) for c in zip(*found))
        if len(h):
            least.add(_numbered(h), at, h)
    return least.entries()


def fingerprint_of(text: str) -> str:
    """The fingerprint of one text: ``ENTRIES`` entries of ``DIGITS`` hexadecimal digits; of an empty text all zeros."""
    return entries_of(text).tobytes().hex()


def likeness(a: Column, b: Column) -> Column:
    """The share of entries, 0 to 1, in which two fingerprints agree."""
    entry = lambda c, i: F.substr(c, i * DIGITS + 1, F.lit(DIGITS))
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(ENTRIES - 1)), lambda i: entry(a, i) == entry(b, i))) / F.lit(ENTRIES)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col_of(docs, id_col).cast("long").alias("id"), F.coalesce(col_of(docs, text_col), F.lit("")).alias("text"))


def _batch(rows: list[tuple], fields: list[tuple[str, str]]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for (_, kind), c in zip(fields, zip(*rows))], names=[n for n, _ in fields])


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(f.split()) for f in schema.split(", ")]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, fingerprint of the whole text.

    A null text is empty; equal texts have equal fingerprints, empty ones all zeros.  A text
    shorter than a k-mer is one k-mer.  Null ids and repeated rows are rows like any other, further
    columns are ignored, an empty table gives no rows.  Nothing is shuffled.
    """
    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                text = text.as_py()
                rows.append((i, len(text), fingerprint_of(text)))
            if rows:
                yield _batch(rows, _fields(FINGERPRINTS))

    return _texts(docs, id_col, text_col).mapInArrow(run, FINGERPRINTS)


def _rank_among(value: Column, bounds: list[int], or_equal: bool) -> Column:
    """How many of the ascending bounds are over the value (or equal to it): first among every so many of them, then in one stretch."""
    width = isqrt(len(bounds)) + 1
    stretches = [bounds[k:k + width] for k in range(0, len(bounds), width)]
    above = (lambda b: b >= value) if or_equal else (lambda b: b > value)
    numbers = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    heads = F.size(F.filter(numbers([s[-1] for s in stretches]), above))  # stretches whose last bound is over: only the first of these is in part
    part = F.get(F.array(*[numbers(s) for s in stretches]), F.lit(len(stretches)) - heads)
    whole = F.lit(len(bounds)) - F.least((F.lit(len(stretches)) - heads + 1) * width, F.lit(len(bounds)))
    return F.when(heads == 0, F.lit(0)).otherwise(whole + F.size(F.filter(part, above)))


def _runs(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text) with ``place`` (ascending in reading order), the number ``run`` of its stretch of ids and ``tie``.

    Bounds between runs are quantiles of the ids, so that a run has about ``RUN_BYTES``.  An id that is a bound more than once
    has several runs, among which its rows are dealt by their texts' hashes; so have the rows without id, which come last.
    """
    spark = rows.sparkSession
    size = rows.agg(F.count("id").alias("n"), F.count(F.lit(1)).alias("all"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_runs = min(MAX_RUNS, max(RUNS_A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions")), (size["bytes"] or 0) // RUN_BYTES))
    bounds: list[int] = []
    if size["n"]:
        at = [k / n_runs for k in range(1, n_runs)]
        bounds = rows.agg(F.percentile_approx("id", at, 10 * max(1000, n_runs)).alias("q")).first()["q"]
    n_null = max(1, n_runs * (size["all"] - size["n"]) // max(1, size["all"]))
    rows = rows.select("id", "text", F.bitwise_not("id").alias("place"), F.shiftrightunsigned(F.xxhash64("text"), 2).alias("tie"))
    share = lambda n: F.shiftright(F.shiftright("tie", 31) * n, 31)  # noqa: E731  the upper half of the 62 bits deals
    if not bounds:
        return rows.withColumn("run", share(F.lit(n_null)))
    lo, hi = _rank_among(F.col("id"), bounds, False), _rank_among(F.col("id"), bounds, True)
    rows = rows.withColumns({"lo": lo.cast("long"), "hi": hi.cast("long")})
    run = F.when(F.col("id").isNull(), F.lit(len(bounds) + 1) + share(F.lit(n_null))).otherwise(F.col("lo") + share(F.col("hi") - F.col("lo") + 1))
    return rows.withColumn("run", run).drop("lo", "hi")


def _compared(batches):
    """Rows in reading order, run by run; the last row of a run is the first of the next one, marked as a guest."""
    fields, rows, before, run = _fields(COMPARED), [], None, None
    for batch in batches:
        for r, guest, i, text in zip(*(batch.column(c) for c in ("run", "guest", "id", "text"))):
            r, guest, text = r.as_py(), guest.as_py(), text.as_py()
            if r != run:
                run, before = r, None
            elif before is None:  # a further guest: a copy of the first
                continue
            this = (i.as_py(), text, entries_of(text))
            if before:
                old_id, old, own = before
                cut = len(old) // 3
                edited = old[:len(old) - cut] + text[:cut]
                other = own if edited == old else entries_of(edited)
                rows.append((old_id, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.tobytes().hex(),
                             other.tobytes().hex(), float((own == other).mean()), float((own == this[2]).mean())))
            before = None if guest else this
            if len(rows) >= OUT_ROWS:
                yield _batch(rows, fields)
                rows = []
    if rows:
        yield _batch(rows, fields)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    near_edited and near_next are the shares of entries, 0 to 1, in which the fingerprint agrees with the edited text's and with the
    next document's, as ``likeness`` tells them.  The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or
    all) of the next document: the one with the next smaller id; after the last comes the first.  A single document is
    its own next.  Rows without id come last; rows of one id follow by a hash of their text.  A null text is
    empty and stays so.  Ids are whole numbers.  Rows that agree in id and text are alike and
    share a run.  Further columns are ignored; an empty table gives no rows.

    Only runs' first rows are broadcast (id and hash), at most ``MAX_RUNS`` of them.
    """
    rows = _runs(_texts(docs, id_col, text_col))
    first = rows.groupBy("run").agg(F.min(F.struct("place", "tie")).alias("at"))
    order = Window.orderBy("run")
    last = F.max("run").over(Window.partitionBy())
    first = first.select(F.col("at.place").alias("at"), F.col("at.tie").alias("at_tie"), F.coalesce(F.lag("run").over(order), last).alias("to"))
    sent = rows.join(F.broadcast(first), F.col("place").eqNullSafe(F.col("at")) & (F.col("tie") == F.col("at_tie")), "left")
    own, guest = (F.struct(F.col(c).alias("run"), F.lit(g).alias("guest")) for c, g in (("run", False), ("to", True)))
    sent = sent.select("place", "tie", "id", "text", F.inline(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(parts, "run").sortWithinPartitions("run", "guest", "place", "tie", "text")
    return sent.select("run", "guest", "id", "text").mapInArrow(_compared, COMPARED)
