"""Approximate nearest neighbours (V2): an inverted file of trained cells, several probes, exact distances.

The cells are the k-means centres of a bounded sample (``SAMPLE_ROWS``); every row of
the corpus is then placed in the cell of its nearest centre.  A query looks only into its nearest cells and
measures their rows exactly.  How many cells that takes is not guessed: a bounded number of corpus rows
(``CALIBRATION_ROWS``) is searched exactly, and the index keeps the least number of probes that finds
the wanted share of their neighbours.  ``vectors.knn`` remains the exact way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .vectors import TIE_DECIMALS, _distances, _matrix, _searched

SAMPLE_ROWS = 100_000
CALIBRATION_ROWS = 200
MAX_CELLS = 4096
TARGET_RECALL = 0.95
SEED = 11


@dataclass
class Index:
    """Rows (cid, vec, block), the centres, each cell's first block and number of blocks, and the probes that reach the target."""
    placed: DataFrame
    centers: np.ndarray
    first: np.ndarray
    blocks: np.ndarray
    n_probes: int
    block_rows: int


def _sample(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """About n rows (all, if there are fewer than 2 n), the same ones each time: those with the least hashes of their ids."""
    total = rows.count()
    return rows if total <= 2 * n else rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int((1 << 30) * n / total))


def _ranked(vectors, centers: np.ndarray) -> np.ndarray:
    """Per vector the cells from the nearest to the farthest."""
    return np.argsort(_distances(_matrix(vectors), centers, "l2"), axis=1, kind="stable")


def build_index(corpus: DataFrame, k: int, n_cells: int | None = None, target: float = TARGET_RECALL, block_rows: int = 4096) -> Index | None:
    """The index of a corpus (cid, vec); None for a corpus without vectors.

    ``n_cells``: the square root of the number of rows unless given, ``MAX_CELLS`` at most.  A cell is dealt out in blocks of about ``block_rows``
    rows, so one that holds a third of the corpus is searched by many tasks.  Rows without vector are left out.
    """
    corpus = corpus.select("cid", F.col("vec").cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    total = corpus.count()
    if not total:
        return None
    n_cells = n_cells or int(min(MAX_CELLS, max(1, total ** 0.5)))
    train = _sample(corpus, "cid", SAMPLE_ROWS).select(array_to_vector("vec").alias("features"))
    model = KMeans(k=n_cells, maxIter=10, initSteps=2, seed=SEED).fit(train) if n_cells > 1 else None
    centers = np.array(model.clusterCenters()) if model else _matrix(corpus.limit(1).toPandas()["vec"])

    def place(batches):
        for b in batches:
            yield b.assign(cell=_ranked(b["vec"], centers)[:, 0].astype("int32") if len(b) else np.zeros(0, "int32"))

    cid = dict(corpus.dtypes)["cid"]
    placed = stored(corpus.mapInPandas(place, f"cid {cid}, vec array<double>, cell int"), "cells")
    sizes = np.zeros(len(centers), dtype=np.int64)
    for row in placed.groupBy("cell").count().collect():  # one row per cell
        sizes[row["cell"]] = row["count"]
    blocks = np.maximum(1, -(-sizes // block_rows))
    first = np.cumsum(blocks) - blocks
    n_probes = _probes(placed, centers, k, target, cid)
    numbers = lambda values: F.array(*[F.lit(int(v)) for v in values])
    at = F.col("cell") + 1
    block = F.element_at(numbers(first), at) + F.pmod(F.xxhash64("cid"), F.element_at(numbers(blocks), at)).cast("int")
    return Index(placed.select("cid", "vec", block.alias("block")), centers, first, blocks, n_probes, block_rows)


def _probes(placed: DataFrame, centers: np.ndarray, k: int, target: float, cid: str) -> int:
    """The least number of probes with which the calibration rows find ``target`` of their exact neighbours."""
    asked = _sample(placed.select("cid", "vec"), "cid", CALIBRATION_ROWS).orderBy(F.xxhash64("cid"), "cid").limit(2 * CALIBRATION_ROWS).toPandas()
    vectors, ids = _matrix(asked["vec"]), asked["cid"].to_numpy()

    def nearest(batches):
        for b in batches:
            if len(b):
                d = _distances(vectors, _matrix(b["vec"]), "l2")
                d[ids[:, None] == b["cid"].to_numpy()[None, :]] = np.inf
                best = np.argsort(d, axis=1, kind="stable")[:, :k]
                row = np.repeat(np.arange(len(ids)), best.shape[1])
                out = pd.DataFrame({"row": row, "dist": d[row, best.ravel()], "cid": b["cid"].to_numpy()[best.ravel()], "cell": b["cell"].to_numpy()[best.ravel()]})
                yield out[np.isfinite(out["dist"])]

    exact = placed.mapInPandas(nearest, f"row long, dist double, cid {cid}, cell int")
    by = Window.partitionBy("row").orderBy(F.round("dist", TIE_DECIMALS), "cid")
    found = exact.withColumn("n", F.row_number().over(by)).where(F.col("n") <= k).select("row", "cell").toPandas()  # k rows per calibration row
    place = np.argsort(_ranked(asked["vec"], centers), axis=1)  # of each cell, how many are nearer
    ranks = np.sort(place[found["row"].to_numpy(dtype=np.int64), found["cell"].to_numpy(dtype=np.int64)])
    return int(ranks[max(0, int(np.ceil(target * len(ranks))) - 1)]) + 1 if len(ranks) else 1


def search(index: Index | None, queries: DataFrame, k: int, exclude_self: bool = True) -> DataFrame:
    """k rows per query (qid, vec): qid, rank, cid, dist; exact distances, some true neighbours may be missing.

    ``exclude_self`` skips the row whose id is the query's.  A query without vector has no row, and none has an empty index.
    """
    types = dict(queries.dtypes)["qid"]
    queries = queries.select("qid", F.col("vec").cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    if index is None:
        return queries.sparkSession.createDataFrame([], f"qid {types}, rank int, cid long, dist double")
    centers, first, blocks, n = index.centers, index.first, index.blocks, index.n_probes

    def send(batches):
        for b in batches:
            if len(b):
                cells = _ranked(b["vec"], centers)[:, :n]
                times = blocks[cells].ravel()
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                row = np.repeat(np.repeat(np.arange(len(b)), cells.shape[1]), times)
                yield b.iloc[row][["qid", "vec"]].assign(block=(np.repeat(first[cells].ravel(), times) + step).astype("int32"))

    sent = queries.mapInPandas(send, f"qid {types}, vec array<double>, block int")
    near = _searched(sent, index.placed, k, "l2", exclude_self, index.block_rows, (types, dict(index.placed.dtypes)["cid"]))
    by_rank = Window.partitionBy("qid").orderBy(F.round("dist", TIE_DECIMALS), "cid")
    return near.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k).select("qid", "rank", "cid", "dist")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n_exact (neighbours of the exact search), n_found (of them also found), recall."""
    hit = exact.select("qid", "cid").join(found.select("qid", "cid", F.lit(1).alias("hit")), ["qid", "cid"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found")).withColumn("recall", F.try_divide("n_found", "n_exact"))
