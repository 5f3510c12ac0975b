"""Named queries for the catalog (C), SQL pass-through (X) and artefact sources (S)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..operators import catalog as C
from ..operators import mining as W
from ..operators import records as RR
from ..operators import reports as R
from ..operators import telemetry as T
from ..session import shared_path, stored
from ..sources import adapters as A
from ..sources import artefacts as S
from ..sources import collections as VC
from ..sources.tables import ALL_TABLES, register_tables, table
from . import vectors as VQ
from . import workload

IGNORED = ["labels", "pages"]
GHOST_TABLE = "ghost"

# Fixed SQL over the star schema, valid in Spark and DuckDB alike.
SQL = {
    "sql_join_on": "SELECT n.n_name, count(*) AS n_customers FROM customer c JOIN nation n "
                   "ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name",
    "sql_join_implicit": "SELECT s.s_name, n.n_name FROM supplier s, nation n WHERE s.s_nationkey = n.n_nationkey",
    "sql_filter": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000",
    "sql_group_count": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "sql_count_distinct": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers FROM orders "
                          "GROUP BY o_orderpriority",
    "sql_min_max_avg": "SELECT c_mktsegment, min(c_acctbal) AS min_bal, max(c_acctbal) AS max_bal, "
                       "round(avg(c_acctbal), 6) AS avg_bal FROM customer GROUP BY c_mktsegment",
    "sql_order_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "sql_most_common": "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment "
                       "ORDER BY n DESC, c_mktsegment LIMIT 1",
    "sql_subquery": "SELECT c_name FROM customer WHERE c_custkey IN "
                    "(SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "sql_run_all": "SELECT r.r_name, count(*) AS n_nations FROM region r JOIN nation n "
                   "ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name",
}
SQL_SAME_NAMES = "SELECT o_orderkey AS k, o_custkey AS k FROM orders"
SQL_UNKNOWN = "SELECT no_such_column FROM no_such_table"
SQL_ONE = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"


def _sql_query(text):
    def run(spark, sf_dir):
        register_tables(spark, sf_dir)
        return C.run_sql(spark, text)
    return run


def q_sql_run_one(spark, sf_dir):
    register_tables(spark, sf_dir)
    return C.run_sql(spark, SQL_ONE, fetch="one")


def q_rows_as_strings(spark, sf_dir):
    register_tables(spark, sf_dir)
    return C.rows_as_strings(C.run_sql(spark, SQL["sql_join_on"]))


def q_rows_same_names(spark, sf_dir):
    """A result with two columns of one name keeps both, by position."""
    register_tables(spark, sf_dir)
    return C.rows_as_strings(C.run_sql(spark, SQL_SAME_NAMES))


def q_sql_timed(spark, sf_dir):
    register_tables(spark, sf_dir)
    return C.timed(spark, SQL["sql_group_count"]).select("query", "ran", "error", "rows", "bytes", (F.col("seconds") > 0).alias("took_time"))


def q_sql_status(spark, sf_dir):
    """Statements that run and one that fails, with the status that their error text gives."""
    register_tables(spark, sf_dir)
    out = [C.timed(spark, text).select(F.lit(name).alias("name"), "ran", F.when(F.col("error").isNull(), "VALID").otherwise("ERROR").alias("status"),
                                       F.coalesce(F.col("error").startswith("Error:"), F.lit(False)).alias("told"))
           for name, text in (("group", SQL["sql_group_count"]), ("most", SQL["sql_most_common"]), ("unknown", SQL_UNKNOWN))]
    return out[0].unionByName(out[1]).unionByName(out[2])


def q_parse_result_text(spark, sf_dir):
    """Results given as text: every nation as a JSON array of rows, every region as bare text."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.to_json(F.array(
        F.array(F.col("n_nationkey").cast("string"), "n_name"))).alias("text"))
    r = table(spark, sf_dir, "region").select((1000 + F.col("r_regionkey")).cast("long").alias("key"), F.col("r_name").alias("text"))
    rows = n.unionByName(r).select("key", C.parse_result_text(F.col("text")).alias("rows"))
    return rows.select("key", F.size("rows").cast("long").alias("n_rows"), F.array_join(F.get("rows", F.lit(0)), "|").alias("first_row"))


def q_run_log_source(spark, sf_dir):
    """Run records written as logs of both shapes and read back."""
    path, runs = shared_path(spark, "logs"), A.runs(spark, sf_dir)
    rec = T.run_record(runs).join(runs.select("query_id", "accuracy"), "query_id").select(*[f.name for f in S.RUN_SCHEMA.fields])
    rec.where("query_id % 2 = 0").write.json(path + "/bare")
    rec.where("query_id % 2 = 1").select(F.array(F.struct(*rec.columns)).alias("detailed_queries")).write.json(path + "/wrapped")
    return S.read_run_logs(spark, [path + "/bare", path + "/wrapped"], multi_line=False).drop("record")


def q_catalog_tables(spark, sf_dir):
    register_tables(spark, sf_dir)
    return C.catalog_tables(spark).join(
        spark.createDataFrame([(t,) for t in ALL_TABLES], "table_name string"), "table_name", "left_semi")


def q_catalog_usable(spark, sf_dir):
    return C.usable_tables(q_catalog_tables(spark, sf_dir), ignore=IGNORED)


def _all(spark, sf_dir):
    return {t: table(spark, sf_dir, t) for t in ALL_TABLES}


def q_schema_ddl(spark, sf_dir):
    return C.schema_ddl(spark, _all(spark, sf_dir))


def q_sample_rows(spark, sf_dir):
    return C.sample_rows(_all(spark, sf_dir))


def q_table_profile(spark, sf_dir):
    return C.table_profile(spark, _all(spark, sf_dir))


def table_requests(spark, sf_dir):
    """Comma lists of tables asked for per query: the query's tables, plus an unknown
    one for three-table queries."""
    t = W.query_tables(workload.mined(spark, sf_dir)).groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("table_pos", "table"))), lambda x: x["table"]).alias("tables"))
    names = F.when(F.size("tables") >= 3, F.concat("tables", F.array(F.lit(GHOST_TABLE)))).otherwise(F.col("tables"))
    return t.select(F.col("query_id").alias("qid"), F.array_join(names, ", ").alias("names"))


def q_table_info_lookup(spark, sf_dir):
    info = C.table_profile(spark, _all(spark, sf_dir))
    return C.table_info_lookup(table_requests(spark, sf_dir), info)


def q_date_as_string(spark, sf_dir):
    return S.dates_as_string(table(spark, sf_dir, "orders"))


def _spec(spark, sf_dir):
    log = A.qlog(spark, sf_dir).select(
        F.col("query_id").alias("question_id"), "db_id", "question", F.lit(None).cast("string").alias("evidence"),
        F.col("sql").alias("SQL"), "difficulty")
    path = shared_path(spark, "spec")
    S.write_spec(log, path)
    return S.read_spec(spark, path, A.QLOG_DB_ID)


def q_spec_scan(spark, sf_dir):
    return _spec(spark, sf_dir)


def q_spec_lookup(spark, sf_dir):
    keys = A.runs(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.lit(A.QLOG_DB_ID).alias("db_id"))
    return S.lookup(_spec(spark, sf_dir), keys, with_db=True)


def q_vector_corpus(spark, sf_dir):
    docs = VQ.benchmark_docs(spark, sf_dir)
    back = stored(docs, "vectors")
    return back.select("cid", "text", "sql", F.size("vec").alias("dims"))


def q_results_sink(spark, sf_dir):
    rec = T.run_record(A.runs(spark, sf_dir)).join(
        A.runs(spark, sf_dir).select("query_id", "accuracy"), "query_id")
    path = shared_path(spark, "runs")
    S.write_runs(rec.select(*[f.name for f in S.RUN_SCHEMA.fields]), path)
    return S.read_runs(spark, path).drop("record", "write")


def q_results_extra(spark, sf_dir):
    """Full run records with fields of no schema, written twice under one name; known, nested and unknown fields of what is read back."""
    rec = RR.run_records(A.agent_events(spark, sf_dir))
    known = ["query_id", "llm", "execution_status", "total_time", "total_times_per_tool", "llm_requests", "input_token_details", "agent_thoughts"]
    extra = F.map_from_arrays(F.array(F.lit("note"), F.lit("seed"), F.lit("llm")),
                              F.array(F.concat(F.lit("run "), F.col("run_id")).cast("variant"), (F.col("query_id") * 3).cast("variant"), F.lit("replaced").cast("variant")))
    rows = rec.select("run_id", F.concat(F.lit("e"), F.col("query_id") % 3).alias("experiment"), *known, F.when(F.col("query_id") % 2 == 0, extra).alias("more"))
    path = shared_path(spark, "results")
    for _ in range(2):
        S.write_runs(rows, path, "benchmark-1", extra="more")
    of = lambda at, kind: F.try_variant_get("record", f"$.{at}", kind)
    back = S.read_runs(spark, path)
    return back.select("query_id", "experiment", "llm", "execution_status", F.round("total_time", 6).alias("total_time"), of("run_id", "string").alias("run_id"),
                       of("llm_requests", "bigint").alias("llm_requests"), F.round(of("total_times_per_tool.query_sql_db", "double"), 6).alias("time_query_sql_db"),
                       of("agent_thoughts[0]", "string").alias("first_thought"), of("note", "string").alias("note"), of("seed", "bigint").alias("seed"), "write")


def q_log_summary_file(spark, sf_dir):
    """The log summary written as JSON and read back."""
    path = shared_path(spark, "summary")
    S.write_runs(R.log_summary(A.runs(spark, sf_dir), A.qlog(spark, sf_dir)), path, "summary")
    names = ["nl_query", "golden_query", "generated_query", "execution_status", "spark_error", "query_result", "accuracy"]
    schema = TY.StructType([TY.StructField("query_id", TY.LongType()), *[TY.StructField(n, TY.StringType()) for n in names]])
    return S.read_runs(spark, path, schema).drop("record", "write")


def q_vector_collection(spark, sf_dir):
    """The collection opened, filled, filled again with the same ids and other texts, and with a few new ids; every row once."""
    docs = VQ.benchmark_docs(spark, sf_dir).select("cid", "text", "sql", "vec")
    path = shared_path(spark, "collection")
    VC.get_or_create(spark, path, "cid long, text string, sql string, vec array<double>")
    VC.insert(spark, path, docs, "cid")
    VC.insert(spark, path, docs.withColumn("text", F.upper("text")), "cid")
    last = VC.insert(spark, path, docs.unionByName(docs.withColumn("cid", F.col("cid") + 1_000_000).where("cid % 2 = 0")), "cid")
    return VC.get_or_create(spark, path, "").select("cid", "text", "sql", F.size("vec").alias("dims"), F.lit(last).cast("long").alias("version"))


def q_graph_node_link(spark, sf_dir):
    g = workload.graph(spark, sf_dir)
    path = shared_path(spark, "graph")
    S.write_node_link(*S.graph_node_link(g.nodes, g.columns, g.operations, g.aggregations, g.predicates,
                                         workload.q_entity_samples(spark, sf_dir), g.edges), path)
    nodes, edges = S.read_node_link(spark, path)
    text = lambda m: F.coalesce(F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string")))), ","), F.lit(""))
    samples = F.coalesce(F.array_join(F.array_sort(F.transform(F.map_entries("sample_values"), lambda e: F.concat(
        e["key"], F.lit("="), F.array_join(e["value"], "|")))), ","), F.lit(""))
    nodes = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("key"), text("columns_freq").alias("entries"), text("operations_freq").alias("operations"),
                         text("aggregations_freq").alias("aggregations"), text("predicates_freq").alias("predicates"), samples.alias("samples"),
                         F.lit(None).cast("long").alias("weight"))
    none = F.lit("")
    return nodes.unionByName(edges.select(
        F.lit("edge").alias("kind"), F.concat_ws("->", "source", "target").alias("key"), text("conditions").alias("entries"), none.alias("operations"),
        none.alias("aggregations"), none.alias("predicates"), F.col("condition").alias("samples"), "weight"))


QUERIES = {**{k: _sql_query(v) for k, v in SQL.items()},
           "sql_run_one": q_sql_run_one,
           "rows_as_strings": q_rows_as_strings,
           "rows_same_names": q_rows_same_names,
           "sql_timed": q_sql_timed,
           "sql_status": q_sql_status,
           "parse_result_text": q_parse_result_text,
           "run_log_source": q_run_log_source,
           "catalog_tables": q_catalog_tables,
           "catalog_usable": q_catalog_usable,
           "schema_ddl": q_schema_ddl,
           "sample_rows": q_sample_rows,
           "table_profile": q_table_profile,
           "table_info_lookup": q_table_info_lookup,
           "date_as_string": q_date_as_string,
           "spec_scan": q_spec_scan,
           "spec_lookup": q_spec_lookup,
           "vector_corpus": q_vector_corpus,
           "results_sink": q_results_sink,
           "results_extra": q_results_extra,
           "log_summary_file": q_log_summary_file,
           "vector_collection": q_vector_collection,
           "graph_node_link": q_graph_node_link}
