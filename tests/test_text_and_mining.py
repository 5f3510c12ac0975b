"""Text helpers (FIXTURES §5) and SQL mining on literal statements."""

from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import linking as L
from quarry.operators import mining as W
from quarry.operators import navigate as N
from quarry.operators import telemetry as T
from quarry.sources.artefacts import date_like


def test_date_override_rule():
    assert [date_like(t) for t in ["DATE", "datetime", "TIMESTAMP(6)", "TEXT", None]] == [True, True, True, False, False]


def test_run_id_thought_tables_condition(spark):
    df = spark.createDataFrame([("lc_run--abc-def-0", "Thought: look first\nAction: x",
                                 '```json\n["orders","ghost"]\n```', "b.y = a.x")],
                               "m string, log string, resp string, cond string")
    r = df.select(T.parse_run_id(F.col("m")).alias("run"), T.thought_text(F.col("log")).alias("th"),
                  L.parse_table_list(F.col("resp"), ["orders"]).alias("t"),
                  L.parse_table_list(F.lit("not json"), ["orders"]).alias("bad"),
                  G.normalize_condition(F.col("cond")).alias("c")).first()
    assert r["run"] == "abc-def" and r["th"] == "look first"
    assert r["t"] == ["orders"] and r["bad"] == [] and r["c"] == "a.x = b.y"


def test_join_alternatives_threshold(spark):
    e = spark.createDataFrame([("a", "b", "c1", 10), ("a", "b", "c2", 3), ("a", "b", "c3", 2)],
                              "source string, target string, condition string, freq long")
    got = [r["condition"] for r in N.join_alternatives(e).orderBy("alt_rank").collect()]
    assert got == ["c1", "c2"]


# (statement, expected facts): tables with alias; columns; edges of ON and WHERE; predicates; operations; aggregations.
# The values follow from the rules in SURVEY section 2.
CASES = {
    "literals, comments": (
        "SELECT T1.a, COUNT(DISTINCT T2.b) FROM x AS T1 /* JOIN q */ INNER JOIN y AS T2 ON T1.id = T2.xid "
        "WHERE T1.a = 'FROM z JOIN w' -- don't JOIN v\n GROUP BY T1.a ORDER BY T1.a LIMIT 3",
        [("x", "T1"), ("y", "T2")], {"x.a", "y.b", "x.id", "y.xid"}, {"x.id = y.xid"}, {("x", "a"): 1},
        {("x", "WHERE"): 1, ("x", "GROUP BY"): 1, ("x", "ORDER BY"): 1, ("x", "LIMIT"): 1, ("y", "LIMIT"): 1}, {("y", "COUNT"): 1, ("y", "DISTINCT"): 1}),
    "comma join": ("SELECT p, q FROM x, y WHERE x.id = y.xid AND x.p > 3", [("x", None), ("y", None)], {"p", "q", "x.id", "y.xid", "x.p"},
                   {"x.id = y.xid"}, {("x", "p"): 1}, {("x", "WHERE"): 1}, {}),
    "ends in a table": ("SELECT COUNT(*) FROM orders", [("orders", None)], set(), set(), {}, {}, {}),
    "ends in a column of ON": ("SELECT 1 FROM ta AS a JOIN tb AS b ON a.x = b.y", [("ta", "a"), ("tb", "b")], {"ta.x", "tb.y"}, {"ta.x = tb.y"}, {}, {}, {}),
    "ends in a column of GROUP BY": ("SELECT x FROM t GROUP BY x", [("t", None)], {"x"}, set(), {}, {("t", "GROUP BY"): 1}, {}),
    "subqueries at the end": ("SELECT 1 FROM ta WHERE x > (SELECT avg(y) FROM tb) AND x IN (SELECT z FROM tc)", [("ta", None), ("tb", None), ("tc", None)],
                              {"x", "y", "z"}, set(), {}, {}, {}),
    "owner in a subquery": ("SELECT a.k FROM ta a WHERE a.x > (SELECT AVG(b.y) FROM tb b)", [("ta", "a"), ("tb", "b")], {"ta.k", "ta.x", "tb.y"}, set(),
                            {("ta", "x"): 1}, {("ta", "WHERE"): 1}, {("tb", "AVG"): 1}),
    "set operator": ("SELECT a FROM x UNION ALL SELECT a FROM y ORDER BY a", [("x", None), ("y", None)], {"a"}, set(), {}, {}, {}),
    "depth 2": ("SELECT a.k FROM x a WHERE a.b IN (SELECT c.b FROM y c WHERE c.c IN (SELECT d.c FROM z d WHERE d.e = 1))",
                [("x", "a"), ("y", "c"), ("z", "d")], {"x.k", "x.b", "y.b", "y.c", "z.c", "z.e"}, set(), {("x", "b"): 1, ("y", "c"): 1, ("z", "e"): 1},
                {("x", "WHERE"): 1, ("y", "WHERE"): 1, ("z", "WHERE"): 1}, {}),
    "alias of a subquery": ("SELECT t.n FROM (SELECT k, COUNT(v) AS n FROM z GROUP BY k) AS t WHERE t.n > 1", [("z", None)], {"k", "v"}, set(), {},
                            {("z", "GROUP BY"): 1}, {("z", "COUNT"): 1}),
    "quoted names": ("SELECT `T1`.`my col`, \"T1\".\"b\" FROM `tab one` AS `T1` -- comment FROM q\n WHERE `T1`.`my col` = 2", [("tab one", "T1")],
                     {"tab one.my col", "tab one.b"}, set(), {("tab one", "my col"): 1}, {("tab one", "WHERE"): 1}, {}),
    "names of several parts": ("SELECT db1.orders.k, o.j FROM db1.orders o JOIN cat.db1.lines l ON o.k = l.k", [("orders", "o"), ("lines", "l")],
                               {"orders.k", "orders.j", "lines.k"}, {"orders.k = lines.k"}, {}, {}, {}),
    "WITH": ("WITH r AS (SELECT k FROM t WHERE k > 1), s(a) AS (SELECT 1) SELECT c.n FROM c JOIN r ON c.k = r.k", [("c", None), ("r", None), ("t", None)],
             {"k", "c.n", "c.k", "r.k"}, {"c.k = r.k"}, {}, {}, {}),
    "CAST and NULLS LAST": ("SELECT CAST(a AS DOUBLE PRECISION) FROM t ORDER BY CAST(b AS REAL) DESC NULLS LAST", [("t", None)], {"a", "b"}, set(), {},
                            {("t", "ORDER BY"): 1}, {}),
    "implicit aliases, OVER": ("SELECT a x, SUM(b) total, ROW_NUMBER() OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) rn FROM t",
                               [("t", None)], {"a", "b", "c", "d"}, set(), {}, {("t", "ORDER BY"): 1}, {}),
    "DISTINCT in any call": ("SELECT SUM(DISTINCT x), MAX(y) FROM t", [("t", None)], {"x", "y"}, set(), {}, {}, {("t", "DISTINCT"): 1, ("t", "MAX"): 1}),
    "whole ON condition": ("SELECT 1 FROM a JOIN b ON a.x < b.y AND (LOWER(a.n) = 'it''s' OR b.m IN (1, 2)) LEFT JOIN c USING (k)",
                           [("a", None), ("b", None), ("c", None)], {"a.x", "b.y", "a.n", "b.m"},
                           {"a.x < b.y AND (LOWER(a.n) = 'it''s' OR b.m IN (1, 2))"}, {}, {}, {}),
    "sides that are no columns": ("SELECT 1 FROM a, b WHERE a.x + 1 = b.y AND 1 + a.z = b.w AND a.v = b.u", [("a", None), ("b", None)],
                                  {"a.x", "b.y", "a.z", "b.w", "a.v", "b.u"}, {"a.v = b.u"}, {("a", "x"): 1, ("b", "y"): 1, ("a", "z"): 1, ("b", "w"): 1},
                                  {("a", "WHERE"): 1, ("b", "WHERE"): 1}, {}),
    "FROM inside a call, typed literals": ("SELECT EXTRACT(YEAR FROM d) FROM t WHERE d > DATE '2020-01-01' AND e < INTERVAL '1' DAY", [("t", None)], {"d", "e"},
                                           set(), {("t", "d"): 1, ("t", "e"): 1}, {("t", "WHERE"): 1}, {}),
    "no table": ("SELECT 1", [], set(), set(), {}, {}, {}),
    "joins in parentheses": ("SELECT 1 FROM (a JOIN b ON a.k = b.k), c", [("a", None), ("b", None), ("c", None)], {"a.k", "b.k"}, {"a.k = b.k"}, {}, {}, {}),
    "empty": ("", None), "null": (None, None), "comment only": ("-- SELECT 1", None), "insert": ("INSERT INTO t SELECT a FROM u", None),
    "unmatched": ("SELECT f(a FROM t", None), "unmatched close": ("SELECT a) FROM t", None),
}


def test_mining_literal_statements(spark):
    names = list(CASES)
    log = spark.createDataFrame([(k, CASES[n][0]) for k, n in enumerate(names)], "query_id long, sql string")
    m = W.mine(log, checkpoint=False)
    facts = {names[r["query_id"]]: r for r in m.facts.collect()}
    assert {n for n, r in facts.items() if r["reason"]} == {n for n, c in CASES.items() if c[1] is None}
    assert facts["insert"]["reason"] == "not a query" and facts["empty"]["reason"] == "empty" == facts["null"]["reason"]
    for n, c in CASES.items():
        if c[1] is None:
            continue
        r, (_, tables, columns, edges, predicates, operations, aggregations) = facts[n], c
        assert [(t["table"], t["alias"]) for t in r["tables"]] == tables, n
        assert {x["full_col"] for x in r["columns"]} == columns, n
        assert {e["condition"] for e in r["join_edges"] + r["implicit_edges"]} == edges, n
        assert {(p["table"], p["column"]): p["n"] for p in r["predicates"]} == predicates, n
        assert {(p["table"], p["op"]): p["n"] for p in r["operations"]} == operations, n
        assert {(p["table"], p["agg"]): p["n"] for p in r["aggregations"]} == aggregations, n


def test_lint_sees_through_comments_and_literals(spark):
    rows = ["SELECT a FROM x UNION SELECT a FROM y", "SELECT 'x UNION y' -- don't UNION\nFROM t", "SELECT 1 /* it's */ UNION ALL SELECT 2",
            "SELECT a FROM t WHERE a NOT IN (SELECT b FROM u) AND c BETWEEN 1 AND 2", " drop table t"]
    log = spark.createDataFrame(list(enumerate(rows)), "query_id long, sql string")
    got = [tuple(r)[1:] for r in W.lint(log).orderBy("query_id").collect()]
    assert got == [(False, True, False, False), (False, False, False, False), (False, False, False, False), (True, False, True, False), (False, False, False, True)]


def test_parse_result_text_and_status(spark):
    from quarry.operators import catalog as C
    df = spark.createDataFrame([('[["1","a"],["2","b"]]',), ("plain text",)], "s string")
    got = [r[0] for r in df.select(C.parse_result_text(F.col("s"))).collect()]
    assert got == [[["1", "a"], ["2", "b"]], [["plain text"]]]
    bad = C.timed(spark, "SELECT no_such_column FROM no_such_table").first()
    assert bad["error"].startswith("Error:")


def test_greedy_connect_with_fallback(spark):
    from quarry.operators import vectors as V
    edges = spark.createDataFrame(
        [("a", "b", "a.k = b.k", 5, 5, True), ("b", "c", "b.k = c.k", 3, 3, True)],
        "source string, target string, condition string, freq long, weight long, is_main boolean")
    p = N.paths(edges)
    valid = spark.createDataFrame([(1, 1, "a"), (1, 2, "c"), (1, 3, "z"), (2, 1, "a"), (2, 2, "b")],
                                  "qid long, table_pos int, table string")
    q = V.with_hash_embedding(spark.createDataFrame([(1, "a c z"), (2, "a b")], "qid long, question string"),
                              "question", "vec")
    picks = {(r["qid"], r["round"]): r for r in N.greedy_connect(q, valid, p, 2).collect()}
    assert picks[(1, 1)]["path_key"] == "a>b>c"
    assert picks[(1, 2)]["fallback"] == ["z"]  # no path to z: pending tables added, stop
    assert picks[(2, 1)]["path_key"] == "a>b" and (2, 2) not in picks


def test_catalog_usable_and_info_lookup(spark):
    import pytest
    from quarry.operators import catalog as C
    cat = spark.createDataFrame([("b",), ("a",), ("c",)], "table_name string")
    assert [r[0] for r in C.usable_tables(cat, ignore=["c"]).collect()] == ["a", "b"]
    assert [r[0] for r in C.usable_tables(cat, include=["c"]).collect()] == ["c"]
    with pytest.raises(ValueError):
        C.usable_tables(cat, ignore=["zzz"])
    info = spark.createDataFrame([("a", "A-info"), ("b", "B-info")], "table_name string, info string")
    req = spark.createDataFrame([(1, "a, b"), (2, "a,ghost")], "qid long, names string")
    got = {r["qid"]: r["info"] for r in C.table_info_lookup(req, info).collect()}
    assert got[1] == "A-info\n\nB-info"
    assert got[2] == "Error: table_names {'ghost'} not found in database"


def test_lexical_link_and_hot_tokens(spark):
    cols = spark.createDataFrame([("orders", "o_orderkey", 5), ("customer", "c_name", 3), ("nation", "n_name", 1)],
                                 "id string, column string, freq long")
    samples = spark.createDataFrame([("customer", "c_name", "Customer#1", 1)], "id string, column string, value string, rn int")
    q = spark.createDataFrame([(1, "Which customer name is on orders?")], "qid long, question string")
    got = {r["table"]: r["hits"] for r in L.lexical_link(q, L.metadata_tokens(cols, samples)).collect()}
    assert got == {"customer": 2, "orders": 1, "nation": 1}  # customer: 'customer' + 'name'; nation: 'name'


def test_graph_counts_statements_per_template(spark):
    """Frequencies come from templates and their numbers of statements: no statement's facts are written out, but conditions with literals are told apart."""
    from quarry.operators import graph as G
    from quarry.operators import mining as W
    sqls = [f"SELECT a.x, COUNT(b.y) FROM a JOIN b ON a.k = b.k AND b.z = {k % 2} WHERE a.x = {k} GROUP BY a.x" for k in range(6)]
    sqls += [f"SELECT c.u FROM c, a WHERE c.k = a.k AND c.u > {k} LIMIT 3" for k in range(4)] + ["DELETE FROM a"]
    log = spark.createDataFrame([(k, s) for k, s in enumerate(sqls)] + [(None, sqls[0])], "query_id long, sql string")
    m = W.mine(log)
    plan = G.column_freq(m)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "explode" not in plan.split("Aggregate")[-1]
    assert {(r.id, r.column): r.freq for r in G.column_freq(m).collect()} == {
        ("a", "k"): 10, ("b", "k"): 6, ("a", "x"): 6, ("b", "y"): 6, ("b", "z"): 6, ("c", "u"): 4, ("c", "k"): 4}
    assert {(r.id, r.key): r.freq for r in G.operation_freq(m).where("freq > 0").collect()} == {
        ("a", "WHERE"): 6, ("a", "GROUP BY"): 6, ("c", "WHERE"): 4, ("c", "LIMIT"): 4, ("a", "LIMIT"): 4}
    edges = {(r.source, r.target, r.condition): (r.freq, r.weight, r.is_main) for r in G.edges(m).collect()}
    assert sorted(v[:2] for v in edges.values()) == [(3, 7), (4, 4), (4, 7)] and {v[2] for k, v in edges.items() if k[0] == "a" and k[1] == "c"} == {True}


def test_entity_samples_read_a_table_once(spark):
    rows = [(i, f"v{999 - i}", None) for i in range(1000)] * 2 + [(None, "", None)]
    df = spark.createDataFrame(rows, "a long, b string, c string").repartition(5)
    columns = spark.createDataFrame([("t", "A"), ("t", "a"), ("t", "b"), ("t", "c"), ("t", "z"), ("u", "a")], "id string, column string")
    found = G.entity_samples(spark, columns, {"t": df, "e": df.limit(0)})
    numbers = [("0", 1), ("1", 2), ("10", 3)]
    assert sorted(map(tuple, found.select("id", "column", "value", "rn").collect())) == sorted(
        [("t", c, v, n) for c in ("A", "a") for v, n in numbers] + [("t", "b", v, n) for v, n in (("", 1), ("v0", 2), ("v1", 3))])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
