"""Adapters from the parquet test tables to the artefacts the operators expect.

Every adapter is a DataFrame derived from the given tables, so its size grows
with the scale factor.  The same derivations are written in DuckDB SQL in
``quarry.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as I
from ..session import stored
from .tables import table

# ---------------------------------------------------------------------------
# The query-log templates.  ``{k}`` is replaced by the order key,
# ``{cond}`` by one of three join conditions in a 10 : 3 : 2 ratio.
# (tpl_id, difficulty, question, sql)
# ---------------------------------------------------------------------------
QLOG_TEMPLATES = [
    (0, "simple", "What is the status and total price of order {k}?",
     "SELECT o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = {k}"),
    (1, "moderate", "How many distinct parts are in order {k}?",
     "SELECT COUNT(DISTINCT T2.l_partkey) FROM orders AS T1 INNER JOIN lineitem AS T2 "
     "ON T1.o_orderkey = T2.l_orderkey WHERE T1.o_orderkey = {k}"),
    (2, "simple", "Which customer placed order {k}?",
     "SELECT c.c_name FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey "
     "WHERE o.o_orderkey = {k}"),
    (3, "moderate", "Which nation is the customer of order {k} from?",
     "SELECT n.n_name FROM nation AS n JOIN customer AS c ON n.n_nationkey = c.c_nationkey "
     "JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey = {k}"),
    (4, "simple", "Which nation is supplier {k} located in?",
     "SELECT s.s_name, n.n_name FROM supplier s, nation n "
     "WHERE s.s_nationkey = n.n_nationkey AND s.s_suppkey = {k}"),
    (5, "challenging", "Which parts match the lines of order {k}?",
     "SELECT p.p_name FROM part AS p JOIN lineitem AS l ON {cond} WHERE l.l_orderkey = {k}"),
    (6, "challenging", "Which line numbers of order {k} come from a supplier equal to its customer?",
     "SELECT l.l_linenumber FROM lineitem l JOIN orders o "
     "ON l.l_orderkey = o.o_orderkey AND l.l_suppkey = o.o_custkey WHERE o.o_orderkey = {k}"),
    (7, "moderate", "What is the most common return flag in order {k}?",
     "SELECT l_returnflag FROM lineitem WHERE l_orderkey = {k} GROUP BY l_returnflag "
     "ORDER BY COUNT(l_returnflag) DESC LIMIT 1"),
    (8, "simple", "How many lines and what revenue does order {k} have?",
     "SELECT COUNT(*), SUM(l.l_extendedprice) FROM lineitem AS l JOIN supplier AS s "
     "ON l.l_suppkey = s.s_suppkey WHERE l.l_orderkey = {k}"),
    (9, "moderate", "What are the balance range and average price for order {k}?",
     "SELECT MIN(c.c_acctbal), MAX(c.c_acctbal), AVG(o.o_totalprice) FROM customer AS c "
     "INNER JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey = {k}"),
    (10, "moderate", "What is the name of the customer with order {k}?",
     "SELECT c_name FROM customer WHERE c_custkey IN "
     "(SELECT o_custkey FROM orders WHERE o_orderkey = {k})"),
    (11, "challenging", "How many lines does order {k} have, by order?",
     "SELECT t.cnt FROM (SELECT l_orderkey, COUNT(l_linenumber) AS cnt FROM lineitem "
     "WHERE l_orderkey = {k} GROUP BY l_orderkey) AS t ORDER BY t.cnt"),
    (12, "simple", "Is order {k} urgent?",
     "SELECT o.o_orderkey FROM orders AS o -- don't read FROM part JOIN x\n"
     "WHERE o.o_orderpriority = '1-URGENT FROM lineitem JOIN region' AND o.o_orderkey = {k}"),
    (13, "challenging", "List the nation of key {k} together with all regions.",
     "SELECT n_name FROM nation WHERE n_nationkey = {k} UNION SELECT r_name FROM region"),
    (14, "challenging", "Which small parts are not in order {k}?",
     "SELECT p.p_name FROM part AS p WHERE p.p_partkey NOT IN "
     "(SELECT l.l_partkey FROM lineitem AS l WHERE l.l_orderkey = {k}) "
     "AND p.p_size BETWEEN 1 AND 10"),
    (15, "moderate", "How many nations below key {k} does each region have?",
     "SELECT r.r_name, COUNT(n.n_nationkey) FROM region AS r JOIN nation AS n "
     "ON r.r_regionkey = n.n_regionkey WHERE n.n_nationkey < {k} GROUP BY r.r_name "
     "ORDER BY r.r_name"),
    (16, "challenging", "Which customers placed orders with key {k}, by way of a list?",
     "WITH recent AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderkey = {k}) "
     "SELECT c.c_name FROM customer AS c JOIN recent AS r ON c.c_custkey = r.o_custkey"),
    (17, "challenging", "Which suppliers deliver the lines of order {k}?",
     "SELECT s.s_name FROM supplier AS s WHERE s.s_suppkey IN (SELECT l.l_suppkey FROM lineitem AS l "
     "WHERE l.l_orderkey IN (SELECT o.o_orderkey FROM orders AS o WHERE o.o_orderkey = {k}))"),
    (18, "simple", "What is the status of order {k} in the main database?",
     'SELECT "o"."o_orderstatus" FROM main.orders AS "o" WHERE "o"."o_orderkey" = {k}'),
    (19, "moderate", "Which orders of customers below {k} are the dearest?",
     "SELECT o_orderkey FROM orders WHERE o_custkey < {k} "
     "ORDER BY CAST(o_totalprice AS REAL) DESC NULLS LAST LIMIT 5"),
    (20, "moderate", "How many lines cost less than their order?",
     "SELECT COUNT(*) FROM orders AS o JOIN lineitem AS l "
     "ON o.o_orderkey = l.l_orderkey AND l.l_extendedprice < o.o_totalprice"),
    (21, "challenging", "How do the customers other than {k} rank by balance?",
     "SELECT c.c_name who, RANK() OVER (PARTITION BY c.c_nationkey ORDER BY c.c_acctbal DESC) place "
     "FROM customer c WHERE c.c_custkey <> {k}"),
    (22, "moderate", "What different quantities does order {k} have by return flag?",
     "SELECT SUM(DISTINCT l.l_quantity), l.l_returnflag FROM lineitem l WHERE l.l_orderkey = {k} GROUP BY l.l_returnflag"),
    (23, "simple", "Copy region {k}.",
     "INSERT INTO region SELECT r_regionkey, r_name FROM region WHERE r_regionkey = {k}"),
]

# Join conditions for template 5, chosen by (key div 24) % 15: 0-9, 10-12, 13-14.
QLOG_CONDITIONS = [
    "p.p_partkey = l.l_partkey",
    "p.p_size = l.l_linenumber",
    "p.p_retailprice = l.l_extendedprice",
]
QLOG_DB_ID = "tpch"


def templates_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        QLOG_TEMPLATES, "tpl_id int, difficulty string, question_tpl string, sql_tpl string")


def _condition_for(key: Column) -> Column:
    bucket = (key.cast("long") / len(QLOG_TEMPLATES)).cast("long") % 15
    return (F.when(bucket < 10, F.lit(QLOG_CONDITIONS[0]))
            .when(bucket < 13, F.lit(QLOG_CONDITIONS[1]))
            .otherwise(F.lit(QLOG_CONDITIONS[2])))


def qlog(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Query log: one SQL statement per order, template by ``o_orderkey`` modulo their number.

    Columns: query_id, db_id, question, sql, difficulty, tpl_id.  The template
    table has 24 rows, so it is broadcast; the log is as large as ``orders``.  ``ids`` (query_id): only the
    statements of these, found before any text is made.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    if ids is not None:
        orders = orders.join(ids.select(F.col("query_id").alias("o_orderkey")), "o_orderkey", "left_semi")
    tpl = F.broadcast(templates_df(spark))
    k = F.col("o_orderkey").cast("string")
    return (
        orders.join(tpl, (F.col("o_orderkey") % len(QLOG_TEMPLATES)) == F.col("tpl_id"))
        .select(
            F.col("o_orderkey").alias("query_id"),
            F.lit(QLOG_DB_ID).alias("db_id"),
            F.replace(F.col("question_tpl"), F.lit("{k}"), k).alias("question"),
            F.replace(F.replace(F.col("sql_tpl"), F.lit("{k}"), k),
                      F.lit("{cond}"), _condition_for(F.col("o_orderkey"))).alias("sql"),
            F.col("difficulty"),
            F.col("tpl_id"),
        )
    )


# ---------------------------------------------------------------------------
# Telemetry adapters from ``events``.
# Span type per event type, the reference's tool names, the
# architectures, difficulty labels and provider labels.
# ---------------------------------------------------------------------------
SPAN_TYPE = {"click": "llm", "view": "tool", "purchase": "spark", "error": "tool", "signup": "tool"}
TOOL_NAMES = ["list_tables_sql_db", "schema_sql_db", "query_sql_db", "query_checker_sql_db"]
ARCHITECTURES = ["baseline", "vector", "graph", "hybrid_v1", "hybrid_v2"]
DIFFICULTIES = ["simple", "moderate", "challenging"]
PROVIDERS = ["google", "cloudflare", "claude", "openai", "other"]
SPAN_SECONDS_PER_VALUE = 10  # a span lasts value x 10 seconds


def _pick(values: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def _tokens_k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("long")


def spans(spark: SparkSession, sf_dir: str, own_columns: list[str] = ()) -> DataFrame:
    """One span per event; run = day.

    Columns: run_id, span_id, type, name, start, end (microseconds; ``end`` is null
    for error events: a tool span that never ended), input_tokens, output_tokens; parent_id: one of
    the three events before (it may be of another day), prompt, cache_read and reasoning of model calls;
    ``own_columns`` of the events as they are.
    """
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    dur = F.round(F.col("value") * F.lit(SPAN_SECONDS_PER_VALUE * 1_000_000)).cast("long")
    stype = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in SPAN_TYPE.items()], F.lit("tool"))
    k = _tokens_k(F.col("props"))
    parent = F.col("event_id") - 1 - F.col("event_id") % 3
    return e.select(
        F.concat(F.lit("run-"), F.to_date(F.col("ts").cast("timestamp")).cast("string")).alias("run_id"),
        F.col("event_id").alias("span_id"),
        stype.alias("type"),
        F.when(stype == "llm", F.lit("llm_call")).when(stype == "spark", F.lit("spark_run"))
        .otherwise(_pick(TOOL_NAMES, F.col("user_id") % len(TOOL_NAMES))).alias("name"),
        start.alias("start"),
        F.when(F.col("event_type") != "error", start + dur).alias("end"),
        F.when(stype == "llm", k * 7).alias("input_tokens"),
        F.when(stype == "llm", k * 3).alias("output_tokens"),
        F.when(parent >= 0, parent).alias("parent_id"),
        F.when(stype == "llm", F.concat(F.lit("Prompt "), F.col("event_id"), F.lit(" of user "), F.col("user_id"))).alias("prompt"),
        F.when(stype == "llm", k).alias("cache_read"),
        F.when(stype == "llm", F.floor(k / 2)).alias("reasoning"),
        *own_columns,
    )


RUN_EVENTS = 8  # events of one agent run


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as runs of an agent, ``RUN_EVENTS`` in a row each: the mixed rows of ``records.run_records``.

    Columns: those of ``spans`` without prompt; input, output, error, tool_calls; query_id, iteration, difficulty, provider
    by the run's number.  Statements whose ``k`` ends in 3 fail.
    """
    s = spans(spark, sf_dir, own_columns=["user_id", "props"]).withColumns({"k": _tokens_k(F.col("props")), "query_id": F.floor(F.col("span_id") / RUN_EVENTS)})
    kind = lambda llm, tool, sql: F.when(F.col("type") == "llm", llm).when(F.col("type") == "tool", tool).otherwise(sql)
    failed = (F.col("type") == "spark") & (F.col("k") % 10 == 3)
    called = F.struct(_pick(TOOL_NAMES, F.col("k") % len(TOOL_NAMES)).alias("name"), F.concat(F.lit("q="), F.col("k")).alias("args"),
                      F.concat(F.lit("call-"), F.col("span_id")).alias("id"), F.lit("tool_call").alias("type"))
    return s.select(
        F.concat(F.lit("q-"), F.col("query_id")).alias("run_id"), "span_id", "type", "name", "start", "end", "parent_id",
        kind(F.col("prompt"), F.concat(F.lit("table_"), F.col("user_id") % 5), F.concat(F.lit("SELECT * FROM t WHERE id = "), F.col("span_id"))).alias("input"),
        kind(F.when(F.col("k") % 5 == 0, F.lit(" \n")).otherwise(F.concat(F.lit("Thought: value "), F.col("k"), F.lit("\n"))),
             F.when(F.col("end").isNotNull(), F.concat(F.lit("rows "), F.col("k"))), F.when(~failed, F.concat(F.lit("[["), F.col("k"), F.lit("]]")))).alias("output"),
        F.when(failed, F.lit("Error: AnalysisException")).alias("error"), "input_tokens", "output_tokens", "cache_read", "reasoning",
        F.when((F.col("type") == "llm") & (F.col("k") % 2 == 0), F.array(called)).alias("tool_calls"),
        "query_id", F.lit(1).alias("iteration"), _pick(DIFFICULTIES, F.col("query_id") % len(DIFFICULTIES)).alias("difficulty"),
        _pick(PROVIDERS, F.col("query_id") % len(PROVIDERS)).alias("provider"))


def run_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run start / end per day: first span start, last known end (or start)."""
    s = spans(spark, sf_dir)
    return s.groupBy("run_id").agg(
        F.min("start").alias("run_start"),
        F.max(F.coalesce("end", "start")).alias("run_end"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records of a benchmark, one per event.

    query_id = event_id, experiment = architecture by user_id % 5, difficulty by
    event_id % 3; error events fail, signup events never execute a query;
    accuracy is 1.0 for purchase events; tokens from ``props.k``.
    """
    e = table(spark, sf_dir, "events")
    k = _tokens_k(F.col("props"))
    status_query = F.when(F.col("event_type") != "signup",
                          F.concat(F.lit("SELECT * FROM t WHERE id = "), F.col("event_id").cast("string")))
    return e.select(
        F.col("event_id").alias("query_id"),
        _pick(ARCHITECTURES, F.col("user_id") % len(ARCHITECTURES)).alias("experiment"),
        _pick(DIFFICULTIES, F.col("event_id") % len(DIFFICULTIES)).alias("difficulty"),
        _pick(PROVIDERS, F.col("user_id") % len(PROVIDERS)).alias("provider"),
        status_query.alias("sparksql_query"),
        F.when(F.col("event_type") == "error", F.lit("Error: AnalysisException")).alias("spark_error"),
        F.when(~F.col("event_type").isin("signup", "error"), F.concat(F.lit("[["), k, F.lit("]]"))).alias("query_result"),
        F.when(F.col("event_type") == "purchase", F.lit(1.0)).otherwise(F.lit(0.0)).alias("accuracy"),
        F.when(F.col("event_type").isin("purchase", "view"), F.lit(1.0)).otherwise(F.lit(0.0))
        .alias("relaxed_accuracy"),
        (k * 7).alias("input_tokens"),
        (k * 3).alias("output_tokens"),
        F.col("value").alias("total_time"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), F.col("value") / 4).alias("spark_time"),
    )


# ---------------------------------------------------------------------------
# Result-set cases from ``lineitem``: each order is a case, its lines the gold
# rows.  The predicted result plants one difference per variant (key % 7):
# 0 same, 1 columns reordered + extra column, 2 one changed cell, 3 rows
# reversed, 4 every row twice, 5 numbers as text with ".0" and lower-case
# flags, 6 empty.  Predicted cells are text, as a model's answer would be.
# ---------------------------------------------------------------------------
N_VARIANTS = 7


def result_cases(spark: SparkSession, sf_dir: str):
    """Return (cases, gold, pred).  gold: case_id, pos, g0 long, g1 double, g2 string;
    pred: case_id, pos, p0..p3 string.  ``pos`` is the 0-based row index."""
    cases = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("status"))
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    # A case's rows are numbered by one task; a case with a third of all lines is many groups.
    li = I.numbered(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    li = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "n", (F.col("no") - 1).alias("pos"),
                   (F.col("l_orderkey") % N_VARIANTS).alias("v"))
    li = stored(li, "lines")
    gold = li.select(F.col("l_orderkey").alias("case_id"), "pos", F.col("l_partkey").alias("g0"),
                     F.col("l_quantity").alias("g1"), F.col("l_returnflag").alias("g2"))
    v = F.col("v")
    q = F.col("l_quantity")
    pred = li.where(v != 6).select(
        F.col("l_orderkey").alias("case_id"),
        F.explode(F.when(v == 3, F.array(F.col("n") - 1 - F.col("pos"))).when(v == 4, F.array(F.col("pos") * 2, F.col("pos") * 2 + 1))
                  .otherwise(F.array("pos"))).alias("pos"),
        F.when(v == 1, F.col("l_returnflag"))
        .when(v == 5, F.concat(F.col("l_partkey").cast("string"), F.lit(".0")))
        .otherwise(F.col("l_partkey").cast("string")).alias("p0"),
        F.when(v == 1, F.col("l_suppkey").cast("string"))
        .when((v == 2) & (F.col("pos") == 0), (q + 1).cast("string"))
        .otherwise(q.cast("string")).alias("p1"),
        F.when(v == 1, q.cast("string")).when(v == 5, F.lower("l_returnflag"))
        .otherwise(F.col("l_returnflag")).alias("p2"),
        F.when(v == 1, F.col("l_partkey").cast("string")).alias("p3"),
    )
    return cases, gold, pred
