"""N-gram Jaccard join: near-duplicate components by rare-first prefix filtering.

1. Texts become sets of shingle hashes.  Texts with equal sets form a class; only
   its smallest id takes part in the search.
2. Shingles are ordered rare first by their counts in a table of fixed size (a
   shingle's counter may hold others too; any order gives the whole result, a good
   one gives few candidates), ties by hash.  Two sets that are similar enough share a
   shingle among the first ones of both (the prefix).
3. Prefix rows join on the shingle.  Candidates must pass the length filter, the
   positional filter (what may still follow the shared shingle in either set) and
   the suffix filter (sizes of the parts of both sets under a fixed partition, whose
   differences bound the sets' distance from below).
4. Each surviving pair is verified once on the whole sets.

Components need fewer links than there are pairs: a first round pairs every
member of a prefix bucket with two leaders only (the smallest id, and the member whose
prefix is shared most), a second round takes the remaining pairs of members
that are not connected yet.  So a group of n near copies costs about 2n
verifications, and no link between different components is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_rows import list_column, slices
from .common import col_of, stored
from .components import components
from .shingles import mixed, shingle_sets

SLICE_BYTES = 1 << 20
COUNTER_BITS = 18
PARTS = 64


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    """First shingles of a set of n of which a similar set must share one."""
    return n - (percent * n + 99) // 100 + 1


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col_of(docs, id_col).cast("long").alias("id"), col_of(docs, text_col).cast("binary").alias("text"))


def _per_slice(batches, width: int):
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            sets = shingle_sets([t or b"" for t in part.column("text").to_pylist()], width)
            yield part.column("id"), sets, np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))


def signatures(rows: DataFrame, width: int) -> DataFrame:
    """id, n (set size), s1 and s2 (two sums over the set), parts (sizes of the set's parts, as 16-bit numbers)."""
    def run(batches):
        for ids, sets, n in _per_slice(batches, width):
            of = np.repeat(np.arange(len(sets)), n)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            ends = np.concatenate([[0], np.cumsum(n)])
            sums = []
            for salt in (0x1234567, 0xABCDEF1):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(flat ^ np.uint64(salt)))])
                sums.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
            part = np.bincount(of * PARTS + (flat >> np.uint64(58)).astype(np.int64), minlength=len(sets) * PARTS)
            part = np.minimum(part, 65535).astype(np.uint16).reshape(len(sets), PARTS)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.array([p.tobytes() for p in part], pa.binary())],
                                             ["id", "n", "s1", "s2", "parts"])

    return rows.mapInArrow(run, "id long, n long, s1 long, s2 long, parts binary")


def shingle_counters(rows: DataFrame, width: int, bits: int = COUNTER_BITS) -> np.ndarray:
    """How many documents have a shingle of each of 2^bits counters; a table of fixed size, summed over all documents."""
    def run(batches):
        counts = np.zeros(1 << bits, dtype=np.int64)
        for _, sets, _ in _per_slice(batches, width):
            if sets:
                counts += np.bincount((np.concatenate(sets) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["c", "n"])

    sums = rows.mapInArrow(run, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(1 << bits, dtype=np.int64)
    table[sums["c"].to_numpy()] = sums["n"].to_numpy()
    return table


def prefixes(rows: DataFrame, width: int, percent: int, counters: np.ndarray) -> DataFrame:
    """id, n, prefix: the rarest shingles of each set, rarest first."""
    table = rows.sparkSession.sparkContext.broadcast(counters)

    def run(batches):
        counts = table.value
        mask = np.uint64(len(counts) - 1)
        for ids, sets, n in _per_slice(batches, width):
            size = np.where(n > 0, prefix_size(n, percent), 0)
            first = [s[np.lexsort((s, counts[(s & mask).astype(np.int64)]))[:k]] for s, k in zip(sets, size.tolist())]
            flat = np.concatenate(first) if first else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), list_column(flat.view(np.int64), size)], ["id", "n", "prefix"])

    return rows.mapInArrow(run, "id long, n long, prefix array<long>")


def _may_link(n1: Column, r1: Column, n2: Column, r2: Column, percent: int) -> Column:
    """Length and positional filters for a shingle at places r1 and r2 of sets of n1 and n2."""
    needed = F.ceil(percent * (n1 + n2) / (100 + percent) - 1e-9)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (F.least(n1 - r1, n2 - r2) >= needed)


def _near_parts(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs that pass the suffix filter: their parts' sizes do not prove them too far apart."""
    left = sizes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("parts").alias("pa"))
    right = sizes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("parts").alias("pb"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, PARTS).astype(np.int32) for c in ("pa", "pb"))
            na, nb = (np.asarray(batch.column(c)) for c in ("na", "nb"))
            needed = -(-percent * (na + nb) // (100 + percent))
            near = np.abs(x - y).sum(axis=1) <= na + nb - 2 * needed
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    def sets_of(batches):
        for ids, sets, _ in _per_slice(batches, width):
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s in sets], pa.binary())], ["id", "set"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stored(rows.join(wanted, "id", "left_semi").mapInArrow(sets_of, "id long, set binary"), "sets")

    def run(batches):
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
                common = int((both[1:] == both[:-1]).sum())
                near.append(100 * common >= percent * (len(both) - common))
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long").distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per input row: id, n_shingles, component (the smallest id reachable by links, itself included).

    Two rows link when 100 * shared shingles >= percent * all shingles of both.  A
    null or wordless text has no shingles and no links.  Repeated rows are one
    document; rows with one id and different texts are each linked by their own text.
    A null id takes no part; its component is null.  Other input columns are
    ignored.  Empty table: no rows.
    """
    rows = _texts(docs, id_col, text_col)
    sizes = stored(signatures(rows, width), "signatures")
    classes = sizes.where("n > 0 AND id IS NOT NULL").groupBy("n", "s1", "s2").agg(F.min("id").alias("first"))
    firsts = classes.select(F.col("first").alias("id")).distinct()
    own = sizes.where("n > 0").join(firsts, "id", "left_semi").select("id", "n", "parts").distinct()

    counters = shingle_counters(rows, width)
    prefix = stored(prefixes(rows.where("id IS NOT NULL"), width, percent, counters).join(firsts, "id", "left_semi"), "prefixes")
    prefix = prefix.select("id", "n", F.posexplode("prefix").alias("r", "h"))
    shared = prefix.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("h")
    buckets = stored(prefix.join(shared, "h"), "buckets")

    # Round 1: every member with its buckets' leaders.
    degree = buckets.groupBy("id", "n").agg(F.count("*").alias("d"))
    ranked = buckets.join(degree.select("id", "n", (1e6 * F.col("d") / F.col("n")).cast("long").alias("share")), ["id", "n"])
    leaders = ranked.groupBy("h").agg(F.min(F.struct("id", "n", "r")).alias("lo"),
                                      F.max(F.struct("share", (-F.col("id")).alias("neg"), "n", "r")).alias("hi"))
    leaders = leaders.select("h", F.array(F.struct("lo.id", "lo.n", "lo.r"), F.struct((-F.col("hi.neg")).alias("id"), "hi.n", "hi.r")).alias("leaders"))
    star = ranked.join(leaders, "h").select("id", "n", "r", F.explode(F.array_distinct("leaders")).alias("l")).where("id <> l.id")
    star = _ordered(star.where(_may_link(F.col("n"), F.col("r"), F.col("l.n"), F.col("l.r"), percent)).select(F.col("id").alias("a"), F.col("l.id").alias("b")))
    tried = stored(_near_parts(star, own, percent), "tried")
    links = stored(verified(tried, rows, width, percent), "links")
    known = components(links)

    # Round 2: members of one bucket that are not connected yet, each pair once.
    labelled = buckets.join(known, "id", "left").select("h", "id", "n", "r", F.coalesce("component", "id").alias("c"))
    mixed_buckets = labelled.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("h")
    labelled = stored(labelled.join(mixed_buckets, "h"), "labelled")
    x, y = (labelled.select("h", *[F.col(c).alias(c + k) for c in ("id", "n", "r", "c")]) for k in "12")
    rest = x.join(y, (x.h == y.h) & (F.col("id1") < F.col("id2")) & (F.col("c1") != F.col("c2"))
                  & _may_link(F.col("n1"), F.col("r1"), F.col("n2"), F.col("r2"), percent))
    rest = _ordered(rest.select(F.col("id1").alias("a"), F.col("id2").alias("b"))).join(tried, ["a", "b"], "left_anti")
    more = verified(stored(_near_parts(rest, own, percent), "rest"), rows, width, percent)
    found = components(links.union(more))

    found = classes.join(found, F.col("first") == F.col("id"), "left").select("n", "s1", "s2", F.coalesce("component", "first").alias("component"))
    out = sizes.join(found, ["n", "s1", "s2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component"))
