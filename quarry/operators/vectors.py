"""Vector retrieval (V1-V7).

* ``hash_embed``: text -> dense vector of hashed token counts (md5 bucket),
  L2-normalised; built-in array functions only, no shuffle.
* ``knn``: exact k nearest neighbours, leave-one-out.  Queries and corpus are dealt once, by
  the cell of their nearest pivot, and packed in blocks.  Every pair of blocks meets in a
  cartesian product, which reads the stored blocks again and shuffles none; a query is scored only against
  blocks that can hold one of its k nearest rows, and a task emits its k best, never all pairs.
* ``cosine``: cosine similarity of two array columns, 0 for empty / missing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts as TX
from ..functions.columns import let
from ..session import stored

DIM = 64
TOKEN_RE = r"[a-z0-9]+"
SEARCH_ROWS = 256  # queries that are scored at once against a block
SENT_ROWS = 1 << 14  # rows that a task sends at once
PACKED_BYTES = 1 << 21  # vectors of a packed block
FILE_BYTES = 1 << 24  # vectors of a file of packed blocks
HELD_HITS = 1 << 18  # hits that a block of queries holds
MEASURED = 1 << 16  # pairs that are measured directly at once
TIE_DECIMALS = 9  # distances are ranked after rounding, so float noise cannot reorder ties


def token_bucket(tok: Column, dim: int = DIM) -> Column:
    """md5 bucket of a token (same value in DuckDB: first 8 hex digits mod dim)."""
    return F.pmod(F.conv(F.substring(F.md5(tok), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def token_buckets(text: Column, dim: int = DIM) -> Column:
    """Sorted md5 buckets of the lower-cased ASCII word tokens of ``text``."""
    return F.array_sort(F.transform(F.regexp_extract_all(F.lower(text), F.lit(TOKEN_RE), F.lit(0)),
                                    lambda t: token_bucket(t, dim)))


def _bucket_vectors(dim: int):
    @F.pandas_udf("array<double>")
    def counts_to_vec(b: pd.Series) -> pd.Series:
        """Per Arrow batch: one vectorised scatter-add of all rows' buckets, then L2 norm."""
        lens = b.map(len).to_numpy()
        m = np.zeros((len(b), dim), dtype=np.float64)
        if lens.sum() > 0:
            flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in b.to_numpy() if len(x)])
            np.add.at(m, (np.repeat(np.arange(len(b)), lens), flat), 1.0)
        norm = np.sqrt((m * m).sum(axis=1))
        nz = norm > 0
        m[nz] = m[nz] / norm[nz, None]
        return pd.Series(list(m))
    return counts_to_vec


def embed_buckets(buckets: Column, dim: int = DIM) -> Column:
    """L2-normalised counts of a bucket array (Arrow-batched, vectorised per batch)."""
    return _bucket_vectors(dim)(buckets)


def with_hash_embedding(df: DataFrame, text: str, out: str = "vec", dim: int = DIM) -> DataFrame:
    """V1: add ``out`` = L2-normalised hashed token counts of ``text`` (two projections)."""
    return (df.withColumn("_buckets", token_buckets(F.col(text), dim))
            .withColumn(out, embed_buckets(F.col("_buckets"), dim)).drop("_buckets"))


def with_sparse_embedding(df: DataFrame, text: str, out: str = "vec", dim: int = DIM) -> DataFrame:
    """V1 without its zeros: ``out`` = (bucket, weight) of the buckets that ``text`` has, the same weights, in order of bucket; no Python."""
    d = df.withColumn("_buckets", token_buckets(F.col(text), dim))
    counts = F.transform(F.array_distinct("_buckets"), lambda b: F.struct(b.alias("bucket"), F.size(F.filter("_buckets", lambda o: o == b)).cast("double").alias("n")))
    d = d.withColumn("_counts", counts)
    norm = F.sqrt(F.aggregate("_counts", F.lit(0.0), lambda s, c: s + c["n"] * c["n"]))
    return d.withColumn(out, let(norm, lambda n: F.transform("_counts", lambda c: F.struct(c["bucket"].alias("bucket"), (c["n"] / n).alias("weight"))))
                        ).drop("_buckets", "_counts")


def sparse(vec: Column) -> Column:
    """A dense vector as (bucket, weight) of its entries that are not zero; null if it is missing or empty."""
    pairs = F.transform(vec, lambda x, i: F.struct(i.alias("bucket"), x.cast("double").alias("weight")))
    return F.when(F.size(vec) > 0, F.filter(pairs, lambda p: p["weight"] != 0))


def cosine(a: Column, b: Column) -> Column:
    """V7: cosine similarity; 0 when either vector is missing or empty."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return (F.when(a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(F.try_divide(dot, na * nb)))


def _matrix(vectors) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _distances(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            d = 1.0 - (q @ c.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :])
        return np.nan_to_num(d, nan=1.0)
    d = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (q @ c.T)
    return np.maximum(d, 0.0)


def _block_search(k: int, metric: str, exclude_self: bool):
    """The k best corpus rows of one block for each query that was sent to it."""
    def fn(queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(corpus):
            return pd.DataFrame({"qid": [], "cid": [], "dist": []})
        c, cids = _matrix(corpus["vec"]), corpus["cid"].to_numpy()
        return pd.concat([some(queries.iloc[at:at + SEARCH_ROWS], c, cids) for at in range(0, len(queries), SEARCH_ROWS)])

    def some(queries: pd.DataFrame, c: np.ndarray, cids: np.ndarray) -> pd.DataFrame:
        q, qids = _matrix(queries["vec"]), queries["qid"].to_numpy()
        rough = _distances(q, c, metric)
        if exclude_self:
            rough[qids[:, None] == cids[None, :]] = np.inf
        n = min(k, rough.shape[1])
        kth = np.partition(rough, n - 1, axis=1)[:, n - 1]
        # The product form cancels for long vectors: what may be among the k is measured again, directly.
        slack = 2e-9 + 1e-12 * ((q * q).sum(1)[:, None] + (c * c).sum(1)[None, :])
        rows, cols = np.nonzero((rough <= kth[:, None] + slack) & np.isfinite(rough))
        dist = rough[rows, cols] if metric == "cosine" else ((q[rows] - c[cols]) ** 2).sum(axis=1)
        out = pd.DataFrame({"qid": qids[rows], "cid": cids[cols], "dist": dist})
        out["r"] = out["dist"].round(TIE_DECIMALS)
        return out.sort_values(["qid", "r", "cid"]).groupby("qid", sort=False).head(k)[["qid", "cid", "dist"]]

    return fn


def _spread(b: pd.DataFrame, chosen: np.ndarray, blocks: np.ndarray, first: np.ndarray):
    """A row per query and block of its chosen cells, in frames of about ``SENT_ROWS`` rows, or of one query's."""
    at_once = max(1, SENT_ROWS // max(1, int(blocks.sum())))
    for at in range(0, len(b), at_once):
        row, cell = np.nonzero(chosen[at:at + at_once])
        times = blocks[cell]
        step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        out = b.iloc[at + np.repeat(row, times)][["qid", "vec"]]
        yield out.assign(block=(np.repeat(first[cell], times) + step).astype("int32"))


def _searched(sent: DataFrame, placed: DataFrame, k: int, metric: str, exclude_self: bool, block_rows: int, types: tuple[str, str]) -> DataFrame:
    """Candidates of queries (qid, vec, block) among the corpus rows (cid, vec, block) of the same block.

    A block to which more than ``block_rows`` queries go is searched in several parts.
    """
    parts = sent.groupBy("block").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    left = sent.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int")).drop("parts")
    right = placed.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(
        _block_search(k, metric, exclude_self), f"qid {types[0]}, cid {types[1]}, dist double")


def _packed(rows: DataFrame, types: str, block_rows: int, n_files: int) -> DataFrame:
    """Rows (id, vec, cell, far, bound) stored as rows of up to ``block_rows`` vectors of one cell: tile, cell, radius, ids, vecs, bounds."""
    def pack(batches):
        held, n, cell, tiles = [], 0, None, 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids = t["id"].combine_chunks()
            vecs = _flat(t["vec"].combine_chunks())
            far = t["far"].to_numpy()
            far = far[~np.isnan(far)]
            return pa.RecordBatch.from_pydict({
                "tile": pa.array([(TaskContext.get().partitionId() << 32) + tiles]), "cell": pa.array([cell], pa.int32()),
                "radius": pa.array([far.max() if len(far) else -np.inf]), "ids": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids),
                "vecs": pa.array([vecs.tobytes()], pa.binary()), "bounds": pa.array([t["bound"].to_numpy().tobytes()], pa.binary())})

        for b in batches:
            cells = b.column("cell").to_numpy()
            lo = 0
            while lo < len(cells):
                if held and (n == block_rows or cells[lo] != cell):
                    yield block()
                    held, n, tiles = [], 0, tiles + 1
                cell = int(cells[lo])
                same = np.flatnonzero(cells[lo:lo + block_rows - n] != cell)
                take = int(same[0]) if len(same) else min(len(cells) - lo, block_rows - n)
                held.append(b.slice(lo, take))
                lo, n = lo + take, n + take
        if held:
            yield block()

    dealt = rows.repartitionByRange(n_files, "cell", F.xxhash64("id", "vec")).sortWithinPartitions("cell")
    return stored(dealt.mapInArrow(pack, f"tile long, cell int, radius double, ids array<{types}>, vecs binary, bounds binary"), "packed")


def _flat(vecs: pa.ListArray) -> np.ndarray:
    """The rows' vectors one below the other; all have one length."""
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vecs), len(flat) // max(1, len(vecs)))


def _ids(ids: pa.Array) -> np.ndarray:
    """Ids as numbers, or as objects where some are null."""
    return ids.to_numpy(zero_copy_only=False) if not ids.null_count else np.array([*ids.to_pylist(), None], dtype=object)[:-1]


class _Tile:
    """The k best corpus rows so far for each query of a block, and what their distance must not exceed."""

    def __init__(self, ids: pa.Array, vecs: np.ndarray, bounds: np.ndarray, pivots: np.ndarray, k: int, metric: str, exclude_self: bool):
        self.k, self.metric, self.exclude_self = k, metric, exclude_self
        self.qids, self.q, self.bounds, self.id_type = _ids(ids), vecs, bounds, ids.type
        self.to_pivots = np.sqrt(_distances(vecs, pivots, "l2")) if metric == "l2" else None
        self.found: list = []
        self.best = pd.DataFrame({"row": np.zeros(0, "int64"), "r": np.zeros(0), "dist": np.zeros(0), "cid": np.zeros(0, "object")})

    def add(self, cell: int, radius: float, ids: pa.Array, c: np.ndarray) -> None:
        """Scores a corpus block for the queries that the triangle inequality does not rule out."""
        rows = np.arange(len(self.q))
        if self.metric == "l2":
            rows = rows[self.to_pivots[:, cell] - radius <= np.sqrt(self.bounds + 2e-9) * (1 + 1e-9) + 1e-9]
        if not len(rows):
            return
        cids, norms = _ids(ids), (c * c).sum(1)
        lifted = np.column_stack([c, norms * (1 - 1e-12)]).T if self.metric == "l2" else None
        for at in range(0, len(rows), SEARCH_ROWS):
            for found in self._some(rows[at:at + SEARCH_ROWS], c, cids, norms, lifted):
                self.found.append(found)
                if sum(len(f[0]) for f in self.found) >= MEASURED:
                    self._keep()
        self._keep()

    def _some(self, rows: np.ndarray, c: np.ndarray, cids: np.ndarray, norms: np.ndarray, lifted: np.ndarray | None):
        """Rows, ids and distances of what may be among the k, in pieces of at most ``MEASURED``."""
        bounded = np.isfinite(self.bounds[rows])
        for part in (rows[bounded], rows[~bounded]):
            if not len(part):
                continue
            q, most = self.q[part], self.bounds[part]
            if self.metric == "l2" and np.isfinite(most[0]):
                # |q - c|^2 <= bound, in one product: q c - |c|^2 / 2 >= (|q|^2 - bound) / 2, with a slack for its rounding.
                near = np.column_stack([q, np.full(len(q), -0.5)]) @ lifted >= (((q * q).sum(1) * (1 - 1e-12) - most - 2e-9) / 2)[:, None]
                rough = None
            else:
                rough = _distances(q, c, self.metric)
                if not np.isfinite(most[0]):  # what may be among the block's own k
                    if self.exclude_self:
                        rough[self.qids[part][:, None] == cids[None, :]] = np.inf
                    n = min(self.k, len(c))
                    most = np.partition(rough, n - 1, axis=1)[:, n - 1]
                slack = 2e-9 + (1e-12 * ((q * q).sum(1)[:, None] + norms[None, :]) if self.metric == "l2" else 0)
                near = (rough <= most[:, None] + slack) & np.isfinite(rough)
            row, col = np.divmod(np.flatnonzero(near), near.shape[1])  # faster than nonzero of a matrix
            if self.exclude_self and len(row):
                other = self.qids[part][row] != cids[col]
                row, col = row[other], col[other]
            for at in range(0, len(row), MEASURED):
                i, j = row[at:at + MEASURED], col[at:at + MEASURED]
                dist = ((q[i] - c[j]) ** 2).sum(axis=1) if self.metric == "l2" else rough[i, j]
                yield part[i], cids[j], dist

    def _keep(self) -> None:
        if not self.found:
            return
        rows, cids, dist = (np.concatenate(x) for x in zip(*self.found))
        self.found = []
        r = dist.round(TIE_DECIMALS)
        nearer = (r <= self.bounds[rows] + 1e-9) & np.isfinite(dist)
        if not nearer.any():
            return
        new = pd.DataFrame({"row": rows[nearer], "r": r[nearer], "dist": dist[nearer], "cid": cids[nearer]})
        touched = np.zeros(len(self.q), dtype=bool)
        touched[new["row"]] = True
        old = touched[self.best["row"]]
        best = pd.concat([self.best[old], new]) if old.any() else new
        best = best.sort_values(["row", "r", "cid"], na_position="first")
        place = best.groupby("row").cumcount().to_numpy()
        last = best[place == self.k - 1]
        self.bounds[last["row"]] = np.minimum(self.bounds[last["row"]], last["r"] + 1e-9)
        self.best = pd.concat([self.best[~old], best[place < self.k]]) if not old.all() else best[place < self.k]

    def hits(self, cid_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.qids[self.best["row"]], self.id_type),
                                           pa.array(self.best["cid"].to_numpy(), cid_type, from_pandas=True), pa.array(self.best["dist"].to_numpy())], ["qid", "cid", "dist"])


def _tiles_search(pivots: np.ndarray, k: int, metric: str, exclude_self: bool):
    """The k best corpus rows for each query, out of pairs of packed blocks; the pairs of one block of queries come one after another."""
    def matrix(b: pa.RecordBatch, column: str, i: int) -> np.ndarray:
        return np.frombuffer(b.column(column)[i].as_buffer()).reshape(-1, pivots.shape[1])

    def fn(batches):
        tile, number = None, None
        for b in batches:
            ids, cids = b.column("ids"), b.column("cids")
            for i, (t, cell, radius) in enumerate(zip(b.column("tile").to_pylist(), b.column("ccell").to_pylist(), b.column("cradius").to_pylist())):
                if t != number:
                    if tile is not None:
                        yield tile.hits(cids.type.value_type)
                    bounds = np.frombuffer(b.column("bounds")[i].as_buffer()).copy()
                    tile, number = _Tile(ids[i].values, matrix(b, "vecs", i).copy(), bounds, pivots, k, metric, exclude_self), t
                tile.add(cell, radius, cids[i].values, matrix(b, "cvecs", i))
        if tile is not None:
            yield tile.hits(cids.type.value_type)

    return fn


def knn(queries: DataFrame, corpus: DataFrame, k: int = 3, metric: str = "l2",
        exclude_self: bool = True, block_rows: int = 4096, n_pivots: int | None = None) -> DataFrame:
    """V2-V4: k nearest corpus rows per query: (qid, rank, cid, dist), exact.

    ``queries``: qid, vec; ``corpus``: cid, vec; ids of any type.  Leave-one-out when
    ``exclude_self`` (qid == cid is skipped).  Fewer than k hits when the
    corpus is small; a query without any hit, or a row without vector, has no row (callers left-join).

    Corpus rows belong to the cell of their nearest pivot (``n_pivots`` corpus rows, a bounded sample: one for each
    ``block_rows`` rows of the corpus, 256 at most), cells to blocks of about ``block_rows``.  A query first searches one block of each of the nearest cells
    that hold more than k rows, which bounds its k-th distance.  Then queries and corpus are packed in blocks, stored once, and every
    pair of blocks meets; a query is scored only against blocks that the triangle inequality does not rule out
    (distance to the pivot less the block's radius).  Cosine distances are no metric and rule nothing out.
    What is written grows as the rows, only the work as their pairs.
    """
    types = dict(queries.dtypes)["qid"], dict(corpus.dtypes)["cid"]
    queries = queries.select("qid", F.col("vec").cast("array<double>").alias("vec")).where("vec IS NOT NULL AND qid IS NOT NULL")
    corpus = corpus.select("cid", F.col("vec").cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    n_pivots = n_pivots or min(256, max(1, corpus.count() // block_rows))
    picked = corpus.orderBy(F.xxhash64("cid"), "cid").select("vec").limit(n_pivots).toPandas()  # a bounded sample
    if not len(picked):
        return queries.sparkSession.createDataFrame([], f"qid {types[0]}, rank int, cid {types[1]}, dist double")
    pivots = _matrix(picked["vec"])

    def to_pivots(vectors) -> np.ndarray:
        return np.sqrt(_distances(_matrix(vectors), pivots, "l2"))

    def nearest(batches):
        for b in batches:
            d = to_pivots(b["vec"]) if len(b) else np.zeros((0, len(pivots)))
            cell = d.argmin(axis=1)
            yield b.assign(cell=cell.astype("int32"), far=d[np.arange(len(b)), cell])

    celled = corpus.mapInPandas(nearest, f"cid {types[1]}, vec array<double>, cell int, far double")
    size = np.zeros(len(pivots), dtype=np.int64)
    for row in celled.groupBy("cell").count().collect():  # one row per pivot
        size[row["cell"]] = row["count"]
    blocks = np.maximum(1, -(-size // block_rows))
    first = np.cumsum(blocks) - blocks
    numbers = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)
    placed = celled.select("cid", "vec", (numbers(first) + F.pmod(F.xxhash64("cid"), numbers(blocks)).cast("int")).alias("block"))
    whole = blocks.sum() <= 2  # too few blocks to choose among

    def near_cells(d: np.ndarray) -> np.ndarray:
        """Per query the nearest cells that hold more than k rows together."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(size[order], axis=1) - size[order]
        chosen = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(chosen, order, before <= k, axis=1)
        return chosen

    def send(batches):
        for b in batches:
            if len(b):
                d = to_pivots(b["vec"])
                yield from _spread(b, (whole | near_cells(d)) & (size > 0), blocks if whole else np.minimum(blocks, 1), first)

    by_rank = Window.partitionBy("qid").orderBy(F.round("dist", TIE_DECIMALS), "cid")
    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).select("qid", "rank", "cid", "dist")
    sent = queries.mapInPandas(send, f"qid {types[0]}, vec array<double>, block int")
    if not whole:
        placed = placed.where(F.col("block").isin([int(v) for v in first]))
    near = ranked(_searched(sent, placed, k, metric, exclude_self, block_rows, types))
    if whole:
        return near
    bound = stored(near.groupBy("qid").agg(F.when(F.count("*") >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("bound")), "bound")

    asked = queries.join(bound, "qid", "left").select(F.col("qid").alias("id"), "vec", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    asked = asked.mapInPandas(nearest, f"id {types[0]}, vec array<double>, bound double, cell int, far double")
    rows = max(1, min(block_rows, PACKED_BYTES // (8 * max(1, pivots.shape[1]))))
    least = math.ceil(2 * corpus.sparkSession.sparkContext.defaultParallelism ** 0.5)  # files of either side: some tasks a core
    files = lambda n: max(1, min(-(-n // rows), max(least, n * pivots.shape[1] * 8 // FILE_BYTES)))
    tiles = _packed(asked, types[0], max(1, min(rows, HELD_HITS // max(1, k))), files(queries.count()))
    there = celled.select(F.col("cid").alias("id"), "vec", "cell", "far", F.lit(0.0).alias("bound"))
    there = _packed(there, types[1], rows, files(int(size.sum()))).select(*[F.col(c).alias(f"c{c}") for c in ("cell", "radius", "ids", "vecs")])
    pairs = tiles.select("tile", "ids", "vecs", "bounds").hint("shuffle_replicate_nl").crossJoin(there)
    return ranked(pairs.mapInArrow(_tiles_search(pivots, k, metric, exclude_self), f"qid {types[0]}, cid {types[1]}, dist double"))


def best_distance(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """V5: best (smallest) distance per question, infinity when there is no hit."""
    b = hits.groupBy("qid").agg(F.min("dist").alias("best"))
    return (questions.select("qid").join(b, "qid", "left")
            .select("qid", F.coalesce("best", F.lit(float("inf"))).alias("best_distance")))


def few_shot_text(questions: DataFrame, hits: DataFrame, docs: DataFrame) -> DataFrame:
    """V6: per question, the header plus one example block per hit in rank order.

    ``docs``: cid, text, sql.  Each question has at most k hits, so the ordered
    collect is bounded by k.
    """
    h = hits.join(docs, "cid").select(
        "qid", "rank",
        F.format_string(TX.FEW_SHOT_EXAMPLE, "text", "sql").alias("block"))
    agg = h.groupBy("qid").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "").alias("blocks"))
    return (questions.select("qid").join(agg, "qid", "left")
            .select("qid", F.concat(F.lit(TX.FEW_SHOT_HEADER), F.coalesce("blocks", F.lit(""))).alias("rag_context")))
