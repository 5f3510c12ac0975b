"""Graph navigation (N1-N17) over the workload graph, as DataFrames.

The graph has a node per name that the log uses as a table; its edge list is joined without hints, so Spark
broadcasts it only where it is small.  Paths are searched between the pairs that somebody asked for
(``paths_between``), from both ends, and never over the whole graph; ``paths`` lists them all for graphs of a
catalog's size.  The greedy connection of hybrid navigation is a delta iteration over all questions at once:
a round looks only at what the last one connected, and finished questions leave.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts as TX
from ..session import stored
from . import vectors as V

# Fixed values of the navigation rules.
JOIN_ALTERNATIVE_THRESHOLD = 0.3
ALPHA = 0.4
LENGTH_DECAY = 0.95
MAX_HOPS = 3
TOP_K_METADATA = 3


def undirected(edges: DataFrame) -> DataFrame:
    """S9 (v2, D4): main edges in both orientations: (src, dst, weight)."""
    m = edges.where("is_main").select("source", "target", "weight")
    return (m.select(F.col("source").alias("src"), F.col("target").alias("dst"), "weight")
            .unionByName(m.select(F.col("target").alias("src"), F.col("source").alias("dst"), "weight")))


def weight_norm(edges: DataFrame) -> DataFrame:
    """log1p(w) / log1p(max w) per undirected edge; max from a one-row aggregate."""
    u = undirected(edges)
    max_w = u.agg(F.max("weight")).first()[0] or 1  # one scalar of a catalog-bounded graph
    return u.withColumn("norm", F.log1p(F.col("weight")) / F.log1p(F.lit(max_w)))


def paths(edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Simple paths of 1..max_hops edges: src, dst, path (array), hops, wsum, nsum."""
    e = weight_norm(edges).select("src", "dst", "weight", "norm")
    cur = e.select("src", "dst", F.array("src", "dst").alias("path"), F.lit(1).alias("hops"),
                   F.col("weight").cast("long").alias("wsum"), F.col("norm").alias("nsum"))
    out = cur
    for _ in range(max_hops - 1):
        nxt = e.select(F.col("src").alias("_a"), F.col("dst").alias("_b"), F.col("weight").alias("_w"),
                       F.col("norm").alias("_n"))
        cur = (cur.join(nxt, (F.col("dst") == F.col("_a")) & ~F.array_contains(F.col("path"), F.col("_b")))
               .select("src", F.col("_b").alias("dst"), F.concat("path", F.array("_b")).alias("path"),
                       (F.col("hops") + 1).alias("hops"), (F.col("wsum") + F.col("_w")).alias("wsum"),
                       (F.col("nsum") + F.col("_n")).alias("nsum")))
        out = out.unionByName(cur)
    return out.withColumns({"path_key": F.array_join("path", ">"),
                            "hist_score": F.col("nsum") / F.col("hops")})


def paths_between(edges: DataFrame, pairs: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """N3 for asked pairs (src, dst) only: the rows of ``paths`` between them, each pair once; at most three edges.

    One edge: a look-up.  Two: the neighbours of the end with fewer of them, looked up at the other.  Three: the neighbours of
    both ends, met in the middle.  Every edge of the graph is followed only from its end of lower degree, so a
    hub in the middle is reached, but never expanded.  Pairs of a node with itself, or with nulls, have no path.
    """
    if max_hops > 3:
        raise ValueError("paths_between searches paths of at most three edges")
    e = weight_norm(edges).select("src", "dst", F.col("weight").cast("long").alias("w"), F.col("norm").alias("n"))
    e = stored(e, "edges")
    degree = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    named = lambda df, *to: df.toDF(*to)
    asked = pairs.select("src", "dst").where("src <> dst").distinct()
    asked = asked.join(named(degree, "src", "ds"), "src").join(named(degree, "dst", "dd"), "dst").select("src", "dst", "ds", "dd")
    asked = stored(asked, "asked")
    row = lambda path, hops, w, n: ["src", "dst", path.alias("path"), F.lit(hops).alias("hops"), w.alias("wsum"), n.alias("nsum")]
    out = asked.join(e, ["src", "dst"]).select(*row(F.array("src", "dst"), 1, F.col("w"), F.col("n")))
    if max_hops > 1:
        from_src = asked.where("ds <= dd").join(named(e, "src", "a", "w1", "n1"), "src").where("a <> dst").join(named(e, "a", "dst", "w2", "n2"), ["a", "dst"])
        from_dst = asked.where("ds > dd").join(named(e, "dst", "a", "w2", "n2"), "dst").where("a <> src").join(named(e, "a", "src", "w1", "n1"), ["a", "src"])
        two = lambda df: df.select(*row(F.array("src", "a", "dst"), 2, F.col("w1") + F.col("w2"), F.col("n1") + F.col("n2")))
        out = out.unionByName(two(from_src)).unionByName(two(from_dst))
    if max_hops > 2:
        ranked = e.join(named(degree, "src", "d1"), "src").join(named(degree, "dst", "d2"), "dst")
        up = ranked.where("d1 < d2 OR (d1 = d2 AND src < dst)").select("src", "dst", "w", "n")
        left = asked.select("src", "dst").join(named(e, "src", "a", "w1", "n1"), "src").where("a <> dst")
        right = asked.select("src", "dst").join(named(e, "dst", "b", "w3", "n3"), "dst").where("b <> src")
        left_up = left.join(named(up, "a", "b", "w2", "n2"), "a").join(right, ["src", "dst", "b"])
        right_up = right.join(named(up, "b", "a", "w2", "n2"), "b").join(left, ["src", "dst", "a"])
        three = lambda df: df.select(*row(F.array("src", "a", "b", "dst"), 3, F.col("w1") + F.col("w2") + F.col("w3"), F.col("n1") + F.col("n2") + F.col("n3")))
        out = out.unionByName(three(left_up)).unionByName(three(right_up))
    return out.withColumns({"path_key": F.array_join("path", ">"), "hist_score": F.col("nsum") / F.col("hops")})


def best_paths(p: DataFrame) -> DataFrame:
    """N4 (v1): per (src, dst) the path with the largest weight sum; then fewer hops, path."""
    w = Window.partitionBy("src", "dst").orderBy(F.desc("wsum"), "hops", "path_key")
    return p.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def join_alternatives(edges: DataFrame, threshold: float = JOIN_ALTERNATIVE_THRESHOLD) -> DataFrame:
    """The most frequent condition plus each with freq / top >= threshold (rank order)."""
    w = Window.partitionBy("source", "target").orderBy(F.desc("freq"), "condition")
    top = Window.partitionBy("source", "target")
    return (edges.withColumns({"alt_rank": F.row_number().over(w), "top_freq": F.max("freq").over(top)})
            .where(F.col("freq") / F.col("top_freq") >= threshold)
            .select("source", "target", "alt_rank", "condition", "freq"))


def edge_rules(edges: DataFrame) -> DataFrame:
    """N12 text per edge: one condition, or the alternatives joined by OR."""
    a = join_alternatives(edges)
    per = a.groupBy("source", "target").agg(
        F.count(F.lit(1)).alias("n_alt"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("alt_rank", "condition"))),
                                 lambda x: x["condition"]), " OR ").alias("conds"))
    text = F.when(F.col("n_alt") == 1, F.format_string(TX.JOIN_RULE_ONE, "source", "target", "conds")
                  ).otherwise(F.format_string(TX.JOIN_RULE_MANY, "source", "target", "conds"))
    return per.select("source", "target", text.alias("rule"))


def valid_tables(requested: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requested (qid, table_pos, table) kept when the table is a graph node."""
    return requested.join(nodes.select(F.col("id").alias("table")), "table", "left_semi")


def table_pairs(valid: DataFrame) -> DataFrame:
    """Unordered pairs of a question's tables, in request order (a before b)."""
    per = valid.where("qid IS NOT NULL").groupBy("qid").agg(F.collect_list(F.struct("table_pos", "table")).alias("t")).where(F.size("t") > 1)
    first = per.select("qid", "t", F.explode("t").alias("a"))
    both = first.select("qid", "a", F.explode(F.filter("t", lambda b: F.col("a")["table_pos"] < b["table_pos"])).alias("b"))
    return both.select("qid", F.col("a.table_pos").alias("pa"), F.col("b.table_pos").alias("pb"), F.col("a.table").alias("ta"), F.col("b.table").alias("tb"))


def v1_paths(valid: DataFrame, best: DataFrame) -> DataFrame:
    """N4 per question: the best path of every pair (pairs without a path drop out)."""
    b = best.select(F.col("src").alias("ta"), F.col("dst").alias("tb"), "path", "path_key", "hops", "wsum")
    return table_pairs(valid).join(b, ["ta", "tb"])


def path_edges(chosen: DataFrame) -> DataFrame:
    """Edges along chosen paths, as sorted table pairs: (qid, source, target)."""
    e = chosen.select("qid", F.inline(F.transform(
        F.sequence(F.lit(1), F.size("path") - 1),
        lambda i: F.struct(F.element_at("path", i).alias("x"), F.element_at("path", i + 1).alias("y")))))
    return e.select("qid", F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target")).distinct()


def join_rules(chosen: DataFrame, rules: DataFrame) -> DataFrame:
    """Per question the distinct rules along its chosen paths, sorted, one per line."""
    r = path_edges(chosen).join(rules, ["source", "target"])
    return r.groupBy("qid").agg(F.array_join(F.array_sort(F.collect_set("rule")), "\n").alias("rules"))


def top_columns(columns: DataFrame, k: int = TOP_K_METADATA) -> DataFrame:
    """Top-k columns per table by frequency (then name)."""
    w = Window.partitionBy("id").orderBy(F.desc("freq"), "column")
    return columns.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def active(freqs: DataFrame, domain: list[str], key: str = "key") -> DataFrame:
    """Keys with freq > 0 per table, ordered by freq desc then domain order."""
    order = F.array_position(F.array(*[F.lit(d) for d in domain]), F.col(key))
    return (freqs.where(F.col("freq") > 0)
            .groupBy("id").agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("f"), order.alias("o"),
                                                     F.col(key).alias("k")))),
                lambda x: x["k"]), ", ").alias("active")))


def active_predicates(preds: DataFrame, k: int = TOP_K_METADATA) -> DataFrame:
    """The k most frequent predicate columns per table (then name)."""
    t = top_columns(preds, k)
    return t.groupBy("id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "column"))), lambda x: x["column"]), ", ").alias("active"))


def sample_lines(samples: DataFrame) -> DataFrame:
    """One line per column with its sample values, per table."""
    per_col = samples.groupBy("id", "column").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda x: F.concat(F.lit("'"), x["value"], F.lit("'"))),
        ", ").alias("vals"))
    line = F.format_string(TX.V2_SAMPLE_LINE, "column", "vals")
    return per_col.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list(
        F.struct("column", line.alias("l")))).getField("l"), "").alias("samples"))


def hybrid_score(hist: Column, sem: Column, hops: Column) -> Column:
    """(alpha hist + (1 - alpha) sem) x decay^(edges - 1)."""
    return (F.lit(ALPHA) * hist + F.lit(1 - ALPHA) * sem) * F.pow(F.lit(LENGTH_DECAY), hops - 1)


def path_similarity(vec: Column, path: Column, is_sparse: bool = False) -> Column:
    """Cosine of a question's vector and the hashed token counts of a path's node names, from the few buckets that the path has.

    The path's squared norm is the sum, over its tokens, of how many of them fall in the same bucket.  ``is_sparse``: the
    vector is (bucket, weight) pairs, null if missing.
    """
    pairs = vec if is_sparse else V.sparse(vec)
    buckets = V.token_buckets(F.array_join(path, " "))
    number = F.lit(0.0)
    weight = lambda b: F.coalesce(F.get(F.filter(pairs, lambda p: p["bucket"] == b), F.lit(0))["weight"], number)
    dot = F.aggregate(buckets, number, lambda s, b: s + weight(b))
    q2 = F.aggregate(pairs, number, lambda s, p: s + p["weight"] * p["weight"])
    p2 = F.aggregate(buckets, number, lambda s, b: s + F.size(F.filter(buckets, lambda o: o == b)))
    return F.when(pairs.isNull(), F.lit(0.0)).otherwise(F.try_divide(dot, F.sqrt(q2) * F.sqrt(p2)))


def _sparse_questions(questions: DataFrame) -> DataFrame:
    """qid, vec as (bucket, weight) pairs: a question has few words, and no join carries the zeros."""
    dense = dict(questions.dtypes)["vec"] in ("array<double>", "array<float>")
    return questions.select("qid", (V.sparse(F.col("vec")) if dense else F.col("vec")).alias("vec"))


def scored_paths(questions: DataFrame, p: DataFrame, pairs: DataFrame) -> DataFrame:
    """N7-N9 for the candidate (question, path) rows of ``pairs`` (qid, src, dst)."""
    q = _sparse_questions(questions).withColumnRenamed("vec", "qvec")
    return (pairs.join(p, ["src", "dst"]).join(q, "qid")
            .withColumn("sem_score", path_similarity(F.col("qvec"), F.col("path"), is_sparse=True))
            .withColumn("total", hybrid_score(F.col("hist_score"), F.col("sem_score"), F.col("hops")))
            .drop("qvec"))


def greedy_connect(questions: DataFrame, valid: DataFrame, p: DataFrame | Callable[[DataFrame], DataFrame], max_rounds: int | None = None) -> DataFrame:
    """Grow a connected set from the first table by the best-scored path per round.

    ``p``: paths, or a function that finds them for pairs (src, dst), as ``paths_between`` does.
    A delta iteration: a round takes the nodes that the last one connected (the frontier), finds the
    paths from them to pending tables that were not searched before, and scores each (question, path) once; scored candidates
    stay until their table is connected.  The best per question (total desc, hops, path) is absorbed.  A question without
    candidate stops and adds its pending tables (v2); finished questions leave the state.  Every round's tables are
    written to the shared folder.  ``max_rounds`` None: until no question is left.
    Returns (qid, round, path_key, path, total) rows for the chosen paths and
    (qid, round, fallback) rows for pending tables added without a path.
    """
    spark = questions.sparkSession
    tables = valid.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("table_pos", "table"))).alias("t"))
    names = F.transform("t", lambda x: x["table"])
    state = tables.select("qid", F.slice(names, 1, 1).alias("connected"), F.slice(names, F.lit(2), F.size("t")).alias("pending"))
    state = stored(state.withColumn("frontier", F.col("connected")).where(F.size("pending") > 0), "state")
    questions = _sparse_questions(questions)  # only those that have a table to connect are kept
    questions = stored(questions.join(state.select("qid"), "qid", "left_semi"), "questions")
    kind = dict(questions.dtypes)["qid"]
    picks = spark.createDataFrame([], f"qid {kind}, round int, path_key string, path array<string>, total double, fallback array<string>")
    searched = found = cands = None
    rnd = 0
    while (max_rounds is None or rnd < max_rounds) and not state.isEmpty():
        rnd += 1
        new = state.select("qid", F.explode("frontier").alias("src"), "pending").select("qid", "src", F.explode("pending").alias("dst"))
        ask = new.select("src", "dst").distinct()
        if callable(p):
            ask = stored(ask if searched is None else ask.join(searched, ["src", "dst"], "left_anti"), "ask")
            more = stored(p(ask), "found")
            found = more if found is None else found.unionByName(more)
            searched = ask if searched is None else searched.unionByName(ask)
        scored = scored_paths(questions, found if callable(p) else p, new).select("qid", "dst", "path", "path_key", "hops", "total")
        if cands is not None:
            left = cands.join(state.select("qid", "pending"), "qid").where(F.array_contains("pending", F.col("dst"))).drop("pending")
            scored = left.unionByName(scored)
        cands = stored(scored, "candidates")
        rank = F.coalesce(-F.round("total", 9), F.lit(float("inf")))
        best = cands.groupBy("qid").agg(F.min(F.struct(rank.alias("rank"), "hops", "path_key", "path", "total")).alias("best"))
        step = state.join(best, "qid", "left").select("qid", "connected", "pending", "best.path", "best.path_key", "best.total")
        step = stored(step, "step")
        got = F.col("path").isNotNull()
        picks = picks.unionByName(step.select(
            "qid", F.lit(rnd).alias("round"), "path_key", "path", "total",
            F.when(~got, F.col("pending")).otherwise(F.lit(None).cast("array<string>")).alias("fallback")))
        state = step.where(got).select("qid", F.array_union("connected", "path").alias("connected"), F.array_except("pending", "path").alias("pending"),
                                       F.array_except("path", "connected").alias("frontier"))
        state = stored(state.where(F.size("pending") > 0), "state")
    return picks
