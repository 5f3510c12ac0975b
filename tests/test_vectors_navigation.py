"""k nearest neighbours against brute force; path search against a DFS model."""

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import navigate as N
from quarry.operators import vectors as V


def test_knn_matches_brute_force(spark):
    rnd = np.random.default_rng(5)
    X = rnd.normal(size=(120, 8))
    rows = [(i, [float(v) for v in X[i]]) for i in range(len(X))]
    df = spark.createDataFrame(rows, "qid long, vec array<double>")
    got = V.knn(df, df.withColumnRenamed("qid", "cid"), k=3, block_rows=25)  # 5 x 5 blocks
    res = {}
    for r in got.collect():
        res.setdefault(r["qid"], []).append((r["rank"], r["cid"]))
    for i in range(len(X)):
        d = ((X - X[i]) ** 2).sum(1)
        d[i] = np.inf
        expect = [int(j) for j in np.lexsort((np.arange(len(X)), np.round(d, 9)))[:3]]
        assert [c for _, c in sorted(res[i])] == expect


def test_knn_with_string_ids_clusters_and_ties(spark):
    """Clustered rows far from the origin, exact copies, few pivots, blocks smaller than a cell."""
    rnd = np.random.default_rng(9)
    X = np.concatenate([1e4 * c + rnd.normal(size=(60, 4)) for c in rnd.normal(size=(5, 4))] + [np.ones((12, 4))])
    ids = [f"row-{k:03d}" for k in rnd.permutation(len(X))]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in zip(ids, X)] + [("none", None)], "qid string, vec array<double>")
    got = {}
    for r in V.knn(df, df.withColumnRenamed("qid", "cid"), k=4, block_rows=16, n_pivots=7).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["cid"]))
    assert set(got) == set(ids)
    for i, x in zip(ids, X):
        d = np.round(((X - x) ** 2).sum(1), 9)
        want = sorted((dd, j) for dd, j in zip(d, ids) if j != i)[:4]
        assert [c for _, c in sorted(got[i])] == [j for _, j in want]


def test_knn_small_corpus_and_best_distance(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "qid long, vec array<double>")
    hits = V.knn(df, df.withColumnRenamed("qid", "cid"), k=3)
    assert hits.count() == 2  # k is cut to n - 1 by leave-one-out
    single = spark.createDataFrame([(1, [0.0, 1.0])], "qid long, vec array<double>")
    h1 = V.knn(single, single.withColumnRenamed("qid", "cid"), k=3)
    b = V.best_distance(single, h1).first()
    assert math.isinf(b["best_distance"])


def test_cosine_and_hash_embed(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], []), (None, [1.0])],
                               "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]
    t = spark.createDataFrame([("the cat the", ), ("",)], "text string")
    vecs = [r["vec"] for r in V.with_hash_embedding(t, "text").collect()]
    assert len(vecs[0]) == V.DIM and abs(sum(x * x for x in vecs[0]) - 1.0) < 1e-12
    assert sum(vecs[1]) == 0.0


def dfs_paths(edges, s, t, cutoff=3):
    adj = {}
    for a, b in edges:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    out = []

    def go(path):
        if len(path) - 1 > cutoff:
            return
        if path[-1] == t and len(path) > 1:
            out.append(tuple(path))
            return
        for n in sorted(adj.get(path[-1], ())):
            if n not in path:
                go(path + [n])
    go([s])
    return out


def test_paths_match_dfs(spark):
    rnd = random.Random(11)
    nodes = list("abcdef")
    pairs = sorted({tuple(sorted(rnd.sample(nodes, 2))) for _ in range(9)})
    edges = spark.createDataFrame([(a, b, f"{a}.k = {b}.k", rnd.randint(1, 9), 0, True) for a, b in pairs],
                                  "source string, target string, condition string, freq long, weight long, is_main boolean")
    edges = edges.withColumn("weight", F.col("freq"))
    got = {}
    for r in N.paths(edges).collect():
        got.setdefault((r["src"], r["dst"]), set()).add(tuple(r["path"]))
    for s, t in itertools.permutations(nodes, 2):
        assert got.get((s, t), set()) == set(dfs_paths(pairs, s, t)), (s, t)


def _brute(X, asked, k):
    out = {}
    for i in asked:
        d = np.round(((X - X[i]) ** 2).sum(1), 9)
        out[i] = [int(j) for j in np.lexsort((np.arange(len(X)), d)) if j != i][:k]
    return out


def test_approximate_search_reaches_its_recall(spark):
    from quarry.operators import ann
    rnd = np.random.default_rng(2)
    X = np.concatenate([c + 0.4 * rnd.normal(size=(150, 16)) for c in rnd.normal(size=(20, 16))])
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "qid long, vec array<double>")
    index = ann.build_index(df.withColumnRenamed("qid", "cid"), 5)
    assert len(index.centers) == 54 and index.n_probes < 54
    asked = df.where("qid % 50 = 0")
    found = ann.search(index, asked, 5)
    want = _brute(X, range(0, len(X), 50), 5)
    exact = spark.createDataFrame([(q, c) for q, cs in want.items() for c in cs], "qid long, cid long")
    r = ann.recall(found, exact).first()
    assert r.n_exact == 300 and r.recall >= 0.9
    for row in found.where("rank = 1").collect():  # distances are exact
        assert abs(row.dist - ((X[row.qid] - X[row.cid]) ** 2).sum()) < 1e-9


def test_approximate_search_with_a_hot_cell_and_odd_rows(spark):
    from quarry.operators import ann
    rnd = np.random.default_rng(3)
    X = np.concatenate([np.ones((120, 3)), rnd.normal(size=(80, 3)) * 9])
    rows = [(f"r{i:03d}", [float(v) for v in x]) for i, x in enumerate(X)] + [("none", None)]
    df = spark.createDataFrame(rows, "qid string, vec array<double>")
    index = ann.build_index(df.withColumnRenamed("qid", "cid"), 3, n_cells=6, target=1.0, block_rows=16)
    assert index.blocks.max() >= 8  # the cell of the copies is dealt out
    got = {}
    for r in ann.search(index, df, 3).collect():
        got.setdefault(int(r.qid[1:]), []).append((r["rank"], int(r.cid[1:])))
    want = _brute(X, range(len(X)), 3)
    assert sum(c in want[q] for q, cs in got.items() for _, c in cs) >= 0.97 * 600
    assert {q: [c for _, c in sorted(got[q])] for q in range(120)} == {q: want[q] for q in range(120)}
    assert ann.build_index(df.where("vec IS NULL").withColumnRenamed("qid", "cid"), 3) is None
    assert ann.search(None, df, 3).count() == 0


def _edges(spark, pairs):
    return spark.createDataFrame([(min(a, b), max(a, b), f"{a}={b}", 1 + k % 7, 1 + k % 7, True) for k, (a, b) in enumerate(pairs)],
                                 "source string, target string, condition string, freq long, weight long, is_main boolean")


def test_paths_between_equal_the_asked_part_of_all_paths(spark):
    rnd = random.Random(8)
    nodes = [f"n{k}" for k in range(14)]
    edges = _edges(spark, {tuple(sorted(rnd.sample(nodes, 2))) for _ in range(30)})
    asked = spark.createDataFrame([tuple(rnd.choice(nodes) for _ in range(2)) for _ in range(40)] + [("n1", "lost"), (None, "n2"), ("n1", "n1")], "src string, dst string")
    cols = ["src", "dst", "path_key", "hops", "wsum", F.round("hist_score", 9).alias("score")]
    for hops in (1, 2, 3):
        want = N.paths(edges, hops).join(asked.distinct(), ["src", "dst"], "left_semi").select(*cols).collect()
        got = N.paths_between(edges, asked, hops).select(*cols).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_paths_through_a_hub_of_ten_thousand(spark):
    """All paths of the star are 10^8; the asked ones are a few rows."""
    star = [("hub", f"leaf{k:05d}") for k in range(10_000)]
    edges = _edges(spark, star + [("leaf00001", "leaf00002"), ("leaf00003", "far")])
    asked = spark.createDataFrame([("leaf00001", "leaf00002"), ("hub", "leaf00009"), ("leaf00004", "far"), ("hub", "far"), ("leaf00005", "leaf00006")], "src string, dst string")
    got = {(r.src, r.dst, r.path_key) for r in N.paths_between(edges, asked).collect()}
    assert got == {("leaf00001", "leaf00002", "leaf00001>leaf00002"), ("leaf00001", "leaf00002", "leaf00001>hub>leaf00002"), ("hub", "leaf00009", "hub>leaf00009"),
                   ("leaf00004", "far", "leaf00004>hub>leaf00003>far"), ("hub", "far", "hub>leaf00003>far"), ("leaf00005", "leaf00006", "leaf00005>hub>leaf00006")}


def test_path_similarity_equals_cosine_of_embeddings(spark):
    df = spark.createDataFrame([("list the order items of a user", ["order_items", "user", "a"]), ("", ["x"]), ("b", ["c"])], "q string, path array<string>")
    df = V.with_hash_embedding(df, "q", "qv").withColumn("text", F.array_join("path", " "))
    df = V.with_hash_embedding(df, "text", "pv")
    for r in df.select(N.path_similarity(F.col("qv"), F.col("path")).alias("a"), V.cosine(F.col("qv"), F.col("pv")).alias("b")).collect():
        assert (r.a is None and r.b is None) or abs(r.a - r.b) < 1e-12


def test_greedy_searches_each_pair_once_and_finished_questions_leave(spark):
    edges = _edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("x", "y")])
    valid = spark.createDataFrame([(q, k, t) for q, ts in {1: "af", 2: "afd", 3: "xy", 4: "ay", 5: "b", 6: "dae"}.items() for k, t in enumerate(ts)], "qid long, table_pos int, table string")
    q = V.with_hash_embedding(spark.createDataFrame([(k, "a b c d e f") for k in range(1, 7)], "qid long, question string"), "question", "vec")
    asked = []

    def find(pairs):
        asked.extend((r.src, r.dst) for r in pairs.collect())
        return N.paths_between(edges, pairs)

    got = {}
    for r in N.greedy_connect(q, valid, find).collect():
        got.setdefault(r.qid, {})[r["round"]] = (r.path_key, r.fallback)
    whole = {}
    for r in N.greedy_connect(q, valid, N.paths(edges), 5).collect():
        whole.setdefault(r.qid, {})[r["round"]] = (r.path_key, r.fallback)
    assert got == whole and len(asked) == len(set(asked))
    assert got[1] == {1: (None, ["f"])} and got[3] == {1: ("x>y", None)} and got[4] == {1: (None, ["y"])} and 5 not in got
    assert got[2] == {1: ("a>b>c>d", None), 2: ("c>d>e>f", None)}  # more of the question in the longer path


def test_knn_holds_no_whole_block_product_and_sends_bounded_frames():
    """A block's distances are worked out for some queries at a time, and a batch of queries is never copied to all its blocks at once."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from quarry.operators import vectors as V
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(3000, 8))
    rows = pd.DataFrame({"qid": np.arange(3000), "vec": list(vec)})
    tracemalloc.start()
    got = V._block_search(2, "l2", True)(rows, rows.rename(columns={"qid": "cid"}))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6  # one 3000 x 3000 matrix is 72 MB
    d = ((vec[:50, None] - vec[None]) ** 2).sum(axis=2)
    d[np.arange(50), np.arange(50)] = np.inf
    assert got[got.qid < 50].groupby("qid").cid.apply(list).tolist() == [list(np.argsort(x)[:2]) for x in d]
    blocks = np.array([1, 3, 400, 0])
    chosen = rng.random((3000, 4)) < 0.7
    chosen[:, 3] = False
    parts = list(V._spread(rows, chosen, blocks, np.cumsum(blocks) - blocks))
    assert max(map(len, parts)) <= V.SENT_ROWS
    want = [(q, b) for q in range(3000) for c in range(4) if chosen[q, c] for b in range(blocks[:c].sum(), blocks[:c + 1].sum())]
    assert [x for p in parts for x in zip(p.qid, p.block)] == want


def test_sparse_vectors_score_as_dense_ones(spark):
    """The same weights without the zeros, and the same similarity; a text without words has no similarity, a missing vector has 0."""
    df = spark.createDataFrame([("a b b c a1 order 77 orders orders",), ("customer",), ("--",), ("orders customer " * 9,)], "q string")
    df = V.with_sparse_embedding(V.with_hash_embedding(df, "q", "dense"), "q", "vec").withColumn("path", F.array(F.lit("orders"), F.lit("customer"), F.lit("b")))
    rows = df.select("dense", "vec", N.path_similarity(F.col("dense"), F.col("path")).alias("a"), N.path_similarity(F.col("vec"), F.col("path"), is_sparse=True).alias("b"),
                     V.sparse(F.col("dense")).alias("of_dense"), N.path_similarity(F.lit(None).cast("array<double>"), F.col("path")).alias("none")).collect()
    for r in rows:
        assert [tuple(p) for p in r["vec"]] == [tuple(p) for p in r["of_dense"]] == [(i, x) for i, x in enumerate(r["dense"]) if x]
        assert r["a"] == r["b"] and r["none"] == 0.0
    assert [r["a"] is None for r in rows] == [False, False, True, False]


def test_table_pairs_of_repeated_rows(spark):
    valid = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("q", 2, "b"), ("r", 1, "a"), (None, 1, "a"), (None, 2, "b")], "qid string, table_pos int, table string")
    assert sorted(map(tuple, N.table_pairs(valid).collect())) == [("q", 1, 2, "a", "b")] * 2


def shuffle_files(spark):
    """Size of every shuffle file, by the number of its shuffle."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    named = [(files.apply(i).getName(), files.apply(i).length()) for i in range(files.size())]
    return [(int(n.split("_")[1]), size) for n, size in named if n.startswith("shuffle_")]


def test_knn_writes_in_proportion_to_its_rows(spark):
    """Vectors without clusters: nothing is ruled out, so every block of queries meets every block of the corpus."""
    X = np.random.default_rng(8).normal(size=(2000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "qid long, vec array<double>")
    before = max([n for n, _ in shuffle_files(spark)], default=-1)
    got = V.knn(df, df.withColumnRenamed("qid", "cid"), k=2, block_rows=50).collect()
    assert sum(size for n, size in shuffle_files(spark) if n > before) < 12 * X.nbytes  # 40 blocks, each sent to all
    d = ((X[:, None] - X[None]) ** 2).sum(axis=2) + np.diag([np.inf] * len(X))
    assert {(r.qid, r["rank"], r.cid) for r in got} == {(i, n + 1, int(j)) for i in range(len(X)) for n, j in enumerate(np.argsort(d[i])[:2])}


def test_knn_in_tiles_with_repeated_rows_null_ids_and_unusable_vectors(spark):
    """Every row counts, as in SQL: a repeated corpus row is two neighbours, one without id is first among equals."""
    rng = np.random.default_rng(4)
    X = rng.integers(0, 3, size=(150, 2)).astype(float)  # many exact ties
    rows = [(i, x.tolist()) for i, x in enumerate(X)] + [(5, X[5].tolist()), (7, [9.0, 9.0]), (None, [1.0, 1.0]), (200, [float("nan"), 1.0]), (201, None)]
    df = spark.createDataFrame(rows, "qid long, vec array<double>")
    got = {}
    for r in V.knn(df, df.withColumnRenamed("qid", "cid"), k=4, block_rows=12, n_pivots=5).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.dist, r.cid))
    usable = [(i, np.array(x)) for i, x in rows if x and x[0] == x[0]]
    want = {}
    for i, x in usable:
        if i is not None:
            want.setdefault(i, []).extend((round(float(((x - y) ** 2).sum()), 9), j is not None, j or 0, j) for j, y in usable if j != i)
    assert {i: [(d, c) for _, d, c in sorted(g)] for i, g in got.items()} == {i: [(d, j) for d, _, _, j in sorted(w)[:4]] for i, w in want.items()}


def test_best_distance_writes_in_proportion_to_its_rows(spark):
    """The nearest of each row over many blocks, and infinity where a row has no vector."""
    X = np.random.default_rng(18).normal(size=(1500, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)] + [(9999, None)], "qid long, vec array<double>")
    before = max([n for n, _ in shuffle_files(spark)], default=-1)
    got = {r.qid: r.best_distance for r in V.best_distance(df, V.knn(df, df.withColumnRenamed("qid", "cid"), k=3, block_rows=40)).collect()}
    assert sum(size for n, size in shuffle_files(spark) if n > before) < 12 * X.nbytes  # 38 blocks, each sent to all
    d = ((X[:, None] - X[None]) ** 2).sum(axis=2) + np.diag([np.inf] * len(X))
    assert math.isinf(got.pop(9999)) and np.allclose([got[i] for i in range(len(X))], d.min(axis=1), atol=1e-12)
