"""Named queries for schema linking (L) and context assembly (K).

Linking runs over every query-log question.  Contexts are built for the
benchmark items: item i's question text is ``benchmark.text`` (vector part)
and its tables are those of query-log entry i (graph part).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts as TX
from ..operators import linking as L
from ..operators import mining as W
from ..operators import navigate as N
from ..session import stored
from ..sources import adapters as A
from ..sources.tables import STAR_TABLES, table
from . import navigation as NV
from . import vectors as VQ
from . import workload

GHOST_TABLE = "ghost"
BAD_RESPONSE = "not json"
DEFAULT_INSTRUCTIONS = "--- INSTRUCTIONS ---\nAnswer with one SparkSQL query.\n"


def _samples(spark, sf_dir):
    return workload.q_entity_samples(spark, sf_dir)


def _available(spark):
    return spark.createDataFrame([(t,) for t in STAR_TABLES], "table string")


def q_schema_metadata(spark, sf_dir):
    m = L.schema_metadata(workload.graph(spark, sf_dir).columns, _samples(spark, sf_dir))
    values = F.transform(F.array_sort(F.map_entries("samples")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|")))
    return m.withColumn("samples", F.array_join(values, ";"))


def q_router_context(spark, sf_dir):
    return L.router_context(workload.graph(spark, sf_dir).columns, _samples(spark, sf_dir), _available(spark))


def q_router_schema(spark, sf_dir):
    """L2: the router's schema text for the tables of the catalog, and for two that the graph does not have."""
    args = workload.graph(spark, sf_dir).columns, _samples(spark, sf_dir)
    lost = spark.createDataFrame([(GHOST_TABLE,), ("phantom",)], "table string")
    return L.router_schema(*args, _available(spark)).select(F.lit("graph").alias("kind"), "schema_context").unionByName(
        L.router_schema(*args, lost).select(F.lit("list").alias("kind"), "schema_context"))


def router_responses(spark, sf_dir, ids=None):
    """Model answers for the router: the query's own tables plus one unknown table,
    fenced as JSON; a rejected statement gets an unparsable answer.  ``ids`` (query_id): only for these."""
    m = workload.mined(spark, sf_dir)
    m = m if ids is None else m.of(ids)
    t = W.query_tables(m).groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("table_pos", "table"))), lambda x: x["table"]).alias("tables"))
    log = A.qlog(spark, sf_dir, ids).select("query_id")
    resp = F.when(F.col("tables").isNotNull(), F.concat(
        F.lit("```json\n"), F.to_json(F.concat("tables", F.array(F.lit(GHOST_TABLE)))), F.lit("\n```"))
    ).otherwise(F.lit(BAD_RESPONSE))
    return log.join(t, "query_id", "left").select(F.col("query_id").alias("qid"), resp.alias("response"))


def _linked(spark, sf_dir, ids=None):
    r = router_responses(spark, sf_dir, ids)
    return r.select("qid", L.parse_table_list(F.col("response"), STAR_TABLES).alias("tables"))


def q_linked_tables_parse(spark, sf_dir):
    return _linked(spark, sf_dir).select("qid", F.array_join("tables", ",").alias("tables"))


def q_linked_samples(spark, sf_dir):
    linked = _linked(spark, sf_dir).select("qid", F.explode("tables").alias("table"))
    return L.linked_samples(linked, _samples(spark, sf_dir)).select("qid", "id", "column", "value", "rn")


def q_lexical_link(spark, sf_dir):
    g = workload.graph(spark, sf_dir)
    toks = L.metadata_tokens(g.columns, _samples(spark, sf_dir))
    q = A.qlog(spark, sf_dir).select(F.col("query_id").alias("qid"), "question")
    return L.lexical_link(q, toks)


def _items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _item_ids(spark, sf_dir):
    return _items(spark, sf_dir).select(F.col("qid").alias("query_id"))


_VALID: dict = {}


def _item_valid(spark, sf_dir):
    """Valid tables of the items, found once per session and state of the tables: the log is read for them once."""
    key = workload.version(spark, sf_dir, ["orders", "benchmark"])
    if key not in _VALID:
        _VALID[key] = stored(NV._valid(spark, sf_dir, _item_ids(spark, sf_dir)), "valid")
    return _VALID[key]


def graph_context_v1(spark, sf_dir):
    g = workload.graph(spark, sf_dir)
    valid = _item_valid(spark, sf_dir)
    best = NV.best_asked(spark, sf_dir, valid)
    return L.v1_graph_context(valid, best, N.edge_rules(g.edges),
                              L.v1_node_blocks(g.columns), _items(spark, sf_dir))


def q_ctx_graph(spark, sf_dir):
    items = _items(spark, sf_dir)
    g = graph_context_v1(spark, sf_dir)
    return items.join(g, "qid").select(F.col("qid").alias("question_id"), F.concat(
        F.lit(TX.GRAPH_CTX_HEAD), "graph_ctx", F.lit(TX.QUESTION_TAIL), "question").alias("context"))


def q_ctx_hybrid1(spark, sf_dir):
    items = _items(spark, sf_dir)
    v = VQ.vector_context(spark, sf_dir).select("qid", "rag_context")
    g = graph_context_v1(spark, sf_dir)
    return (items.join(v, "qid", "left").join(g, "qid", "left")
            .select(F.col("qid").alias("question_id"),
                    L.hybrid1_text(F.coalesce("rag_context", F.lit("")), F.col("graph_ctx"), F.col("question"))
                    .alias("context")))


def graph_context_v2(spark, sf_dir):
    """Hybrid navigation text: rules of the greedily chosen paths + v2 metadata blocks."""
    items = _items(spark, sf_dir)
    valid = _item_valid(spark, sf_dir)
    qv = NV._questions(spark, sf_dir, _item_ids(spark, sf_dir))
    picks = N.greedy_connect(qv, valid, NV.finder(spark, sf_dir))
    chosen = picks.where(F.col("path").isNotNull()).select("qid", "path")
    rules = N.join_rules(chosen, N.edge_rules(workload.graph(spark, sf_dir).edges))
    first = valid.join(valid.groupBy("qid").agg(F.min("table_pos").alias("table_pos")), ["qid", "table_pos"])
    relevant = (chosen.select("qid", F.explode("path").alias("table"))
                .unionByName(picks.where(F.col("fallback").isNotNull()).select("qid", F.explode("fallback").alias("table")))
                .unionByName(first.select("qid", "table")).distinct())
    blocks = NV.metadata_blocks(spark, sf_dir).withColumnRenamed("id", "table")
    meta = (relevant.join(blocks, "table").groupBy("qid").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("table", "block"))), lambda x: x["block"]), "").alias("meta")))
    n = valid.groupBy("qid").agg(F.count(F.lit(1)).alias("n_valid"))
    join_text = (F.when(F.col("n_valid") == 1, F.lit(TX.SINGLE_TABLE))
                 .otherwise(F.concat(F.lit(TX.JOIN_HEADER),
                                     F.coalesce(F.concat("rules", F.lit("\n")), F.lit(TX.NO_PATHS)))))
    body = F.concat(join_text, F.lit(TX.METADATA_HEADER), F.coalesce("meta", F.lit("")))
    return (items.select("qid").join(n, "qid", "left").join(rules, "qid", "left").join(meta, "qid", "left")
            .select("qid", F.when(F.col("n_valid").isNull(), F.lit(TX.NO_VALID_TABLES)).otherwise(body)
                    .alias("graph_ctx")))


def q_ctx_hybrid2(spark, sf_dir, instructions: str = DEFAULT_INSTRUCTIONS):
    items = _items(spark, sf_dir)
    v = VQ.vector_context(spark, sf_dir).select("qid", "rag_context")
    g = graph_context_v2(spark, sf_dir)
    linked = stored(_linked(spark, sf_dir, _item_ids(spark, sf_dir)), "linked")
    ent = L.entity_section(L.linked_samples(linked.select("qid", F.explode("tables").alias("table")),
                                            _samples(spark, sf_dir)))
    return (items.join(v, "qid", "left").join(g, "qid", "left").join(ent, "qid", "left")
            .select(F.col("qid").alias("question_id"),
                    L.hybrid2_text(instructions, F.coalesce("rag_context", F.lit("")), F.col("entities"),
                                   F.col("graph_ctx"), F.col("question")).alias("context")))


def q_ctx_all(spark, sf_dir):
    parts = [("baseline", VQ.q_ctx_baseline), ("vector", VQ.q_ctx_vector), ("graph", q_ctx_graph),
             ("hybrid_v1", q_ctx_hybrid1), ("hybrid_v2", q_ctx_hybrid2)]
    out = None
    for name, fn in parts:
        d = fn(spark, sf_dir).withColumn("strategy", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out.select("strategy", "question_id", "context")


QUERIES = {
    "schema_metadata": q_schema_metadata,
    "router_context": q_router_context,
    "router_schema": q_router_schema,
    "linked_tables_parse": q_linked_tables_parse,
    "linked_samples": q_linked_samples,
    "lexical_link": q_lexical_link,
    "ctx_graph": q_ctx_graph,
    "ctx_hybrid1": q_ctx_hybrid1,
    "ctx_hybrid2": q_ctx_hybrid2,
    "ctx_all": q_ctx_all,
}
