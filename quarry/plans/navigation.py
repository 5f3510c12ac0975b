"""Named queries for graph navigation (N) over the mined workload graph.

Questions are the parsed query-log entries; the tables a question asks for
are the tables of its own SQL (a perfect router), in first-seen order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts as TX
from ..operators import mining as W
from ..operators import navigate as N
from ..operators import vectors as V
from ..session import shared_path
from ..sources import adapters as A
from ..sources import artefacts as S
from . import workload


def _graph(spark, sf_dir):
    return workload.graph(spark, sf_dir)


def _paths(spark, sf_dir):
    return N.paths(_graph(spark, sf_dir).edges)


def finder(spark, sf_dir):
    """Paths of the workload graph between asked pairs."""
    edges = _graph(spark, sf_dir).edges
    return lambda pairs: N.paths_between(edges, pairs)


def best_asked(spark, sf_dir, valid):
    """The best path of every pair of tables that some question asks for."""
    pairs = N.table_pairs(valid).select(F.col("ta").alias("src"), F.col("tb").alias("dst"))
    return N.best_paths(finder(spark, sf_dir)(pairs))


def _valid(spark, sf_dir, ids=None):
    """Valid tables of every question, or of those of ``ids`` (query_id)."""
    m = workload.mined(spark, sf_dir)
    m = m if ids is None else m.of(ids)
    req = W.query_tables(m).select(F.col("query_id").alias("qid"), "table_pos", "table")
    return N.valid_tables(req, _graph(spark, sf_dir).nodes)


def _questions(spark, sf_dir, ids=None):
    q = A.qlog(spark, sf_dir, ids).select(F.col("query_id").alias("qid"), "question")
    return V.with_sparse_embedding(q, "question", "vec")


def q_graph_undirected(spark, sf_dir):
    """The stored graph, read back, in both orientations."""
    path = shared_path(spark, "graph")
    empty = spark.createDataFrame([], "id string, column string, key string, freq long, value string, rn int")
    S.write_node_link(*S.graph_node_link(empty.select("id"), empty, empty, empty, empty, empty, _graph(spark, sf_dir).edges), path)
    _, links = S.read_node_link(spark, path)
    return N.undirected(links.withColumn("is_main", F.lit(True)))


def q_graph_weight_norm(spark, sf_dir):
    w = N.weight_norm(_graph(spark, sf_dir).edges)
    return w.select("src", "dst", "weight", F.round("norm", 6).alias("norm"))


def q_graph_paths_3hop(spark, sf_dir):
    p = _paths(spark, sf_dir)
    return p.select("src", "dst", "path_key", "hops", "wsum", F.round("hist_score", 6).alias("hist_score"))


def q_graph_best_path(spark, sf_dir):
    return best_asked(spark, sf_dir, _valid(spark, sf_dir)).select("src", "dst", "path_key", "hops", "wsum")


def q_graph_join_alternatives(spark, sf_dir):
    return N.join_alternatives(_graph(spark, sf_dir).edges)


def q_nav_valid_tables(spark, sf_dir):
    return _valid(spark, sf_dir)


def q_nav_pairs(spark, sf_dir):
    return N.table_pairs(_valid(spark, sf_dir)).select("qid", "ta", "tb")


def nav_join_text(spark, sf_dir):
    """The v1 join section per question and its relevant tables."""
    valid = _valid(spark, sf_dir)
    chosen = N.v1_paths(valid, best_asked(spark, sf_dir, valid))
    rules = N.join_rules(chosen, N.edge_rules(_graph(spark, sf_dir).edges))
    n = valid.groupBy("qid").agg(F.count(F.lit(1)).alias("n_valid"))
    text = (F.when(F.col("n_valid") == 1, F.lit(TX.SINGLE_TABLE))
            .otherwise(F.concat(F.lit(TX.JOIN_HEADER),
                                F.coalesce(F.concat("rules", F.lit("\n")), F.lit(TX.NO_PATHS)))))
    return n.join(rules, "qid", "left").select("qid", "n_valid", text.alias("join_text"))


def q_nav_join_rules(spark, sf_dir):
    return nav_join_text(spark, sf_dir).select("qid", "join_text")


def q_nav_top_columns(spark, sf_dir):
    return N.top_columns(_graph(spark, sf_dir).columns).select("id", "rank", "column", "freq")


def q_nav_active_patterns(spark, sf_dir):
    g = _graph(spark, sf_dir)
    ops = N.active(g.operations, W.OPERATIONS).withColumnRenamed("active", "operations")
    aggs = N.active(g.aggregations, W.AGGREGATIONS).withColumnRenamed("active", "aggregations")
    preds = N.active_predicates(g.predicates).withColumnRenamed("active", "predicates")
    return (g.nodes.join(ops, "id", "left").join(aggs, "id", "left").join(preds, "id", "left"))


def metadata_blocks(spark, sf_dir):
    """The v2 metadata block of every table."""
    g = _graph(spark, sf_dir)
    pats = q_nav_active_patterns(spark, sf_dir)
    top = N.top_columns(g.columns).groupBy("id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "column"))), lambda x: x["column"]), ", ").alias("top"))
    samples = N.sample_lines(workload.q_entity_samples(spark, sf_dir))
    b = pats.join(top, "id", "left").join(samples, "id", "left")
    pattern_lines = F.concat(
        F.when(F.col("predicates").isNotNull(),
               F.format_string(TX.V2_PREDICATES, "predicates")).otherwise(F.lit("")),
        F.when(F.col("operations").isNotNull(),
               F.format_string(TX.V2_OPERATIONS, "operations")).otherwise(F.lit("")),
        F.when(F.col("aggregations").isNotNull(),
               F.format_string(TX.V2_AGGREGATIONS, "aggregations")).otherwise(F.lit("")))
    none = (F.col("predicates").isNull() & F.col("operations").isNull() & F.col("aggregations").isNull())
    text = F.concat(
        F.format_string(TX.TABLE_LINE, "id"),
        F.when(F.col("top").isNotNull(), F.format_string(TX.V2_TOP_COLUMNS, "top"))
        .otherwise(F.lit("")),
        F.when(F.col("samples").isNotNull(), F.concat(F.lit(TX.V2_SAMPLES_HEADER), F.col("samples")))
        .otherwise(F.lit("")),
        F.lit(TX.V2_PATTERNS_HEADER),
        F.when(none, F.lit(TX.V2_NO_PATTERNS)).otherwise(pattern_lines))
    return b.select("id", text.alias("block"))


def q_nav_metadata_text(spark, sf_dir):
    return metadata_blocks(spark, sf_dir)


def _two_table_candidates(spark, sf_dir):
    valid = _valid(spark, sf_dir)
    n = valid.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    two = valid.join(n.where("n = 2"), "qid", "left_semi")
    pairs = N.table_pairs(two).select("qid", F.col("ta").alias("src"), F.col("tb").alias("dst"))
    return N.scored_paths(_questions(spark, sf_dir), finder(spark, sf_dir)(pairs), pairs)


def q_path_hybrid_score(spark, sf_dir):
    s = _two_table_candidates(spark, sf_dir)
    return s.select("qid", "path_key", "hops", F.round("hist_score", 6).alias("hist_score"),
                    F.round("sem_score", 6).alias("sem_score"), F.round("total", 6).alias("total"))


def q_nav_two_tables(spark, sf_dir):
    from pyspark.sql import Window
    s = _two_table_candidates(spark, sf_dir)
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("total", 9)), "hops", "path_key")
    return (s.withColumn("r", F.row_number().over(w)).where("r = 1")
            .select("qid", "path_key", F.round("total", 6).alias("total")))


def _greedy(spark, sf_dir, valid):
    picks = N.greedy_connect(_questions(spark, sf_dir), valid, finder(spark, sf_dir))
    return picks.select("qid", "round", "path_key", F.round("total", 6).alias("total"),
                        F.array_join("fallback", ",").alias("fallback"))


def q_nav_greedy_connect(spark, sf_dir):
    return _greedy(spark, sf_dir, _valid(spark, sf_dir))


def q_nav_fallback(spark, sf_dir):
    """Questions for two tables also ask for one that no edge reaches, which is added without a path."""
    valid = _valid(spark, sf_dir)
    two = valid.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), (F.max("table_pos") + 1).alias("table_pos")).where("n = 2")
    return _greedy(spark, sf_dir, valid.unionByName(two.select("qid", "table_pos", F.lit("ghost").alias("table"))))


QUERIES = {
    "graph_undirected": q_graph_undirected,
    "graph_weight_norm": q_graph_weight_norm,
    "graph_paths_3hop": q_graph_paths_3hop,
    "graph_best_path": q_graph_best_path,
    "graph_join_alternatives": q_graph_join_alternatives,
    "nav_valid_tables": q_nav_valid_tables,
    "nav_pairs": q_nav_pairs,
    "nav_join_rules": q_nav_join_rules,
    "nav_top_columns": q_nav_top_columns,
    "nav_active_patterns": q_nav_active_patterns,
    "nav_metadata_text": q_nav_metadata_text,
    "path_hybrid_score": q_path_hybrid_score,
    "nav_two_tables": q_nav_two_tables,
    "nav_greedy_connect": q_nav_greedy_connect,
    "nav_fallback": q_nav_fallback,
}
