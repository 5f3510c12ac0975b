"""DuckDB SQL of the workload queries (mining W and graph G).

Independent of the operators: no SQL text is read here.  What each template of
the query log says was read off by hand and is stated as VALUES; the facts of the
log are these, counted over the orders that pick the template.
"""

from __future__ import annotations

from ..sources import adapters as A


OPERATIONS = ["WHERE", "GROUP BY", "ORDER BY", "LIMIT"]
AGGREGATIONS = ["COUNT", "DISTINCT", "MAX", "MIN", "AVG"]
# Which templates a lint rule marks, read off their texts.
LINTED = {"not_in_subquery": [14], "union_not_all": [13], "uses_between": [14], "data_changing": [23]}


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def qlog_cte() -> str:
    rows = ",\n    ".join(
        f"({i}, {q(d)}, {q(qt)}, {q(st)})" for i, d, qt, st in A.QLOG_TEMPLATES)
    c0, c1, c2 = (q(c) for c in A.QLOG_CONDITIONS)
    return f"""
tpl(tpl_id, difficulty, question_tpl, sql_tpl) AS (VALUES
    {rows}),
qlog AS (
  SELECT o.o_orderkey AS query_id, {q(A.QLOG_DB_ID)} AS db_id,
         replace(t.question_tpl, '{{k}}', CAST(o.o_orderkey AS VARCHAR)) AS question,
         replace(replace(t.sql_tpl, '{{k}}', CAST(o.o_orderkey AS VARCHAR)), '{{cond}}',
                 CASE WHEN (o.o_orderkey // 24) % 15 < 10 THEN {c0}
                      WHEN (o.o_orderkey // 24) % 15 < 13 THEN {c1} ELSE {c2} END) AS sql,
         t.difficulty, t.tpl_id
  FROM orders o JOIN tpl t ON o.o_orderkey % 24 = t.tpl_id)"""


# What each template says, read off its text by hand: (table, alias) in the order of nesting and place; columns as written,
# table first where it is known ("" where it is not, a trailing "?" where the reference is unqualified); edges of ON and of WHERE as
# (source, target, condition); filters as table.column; (table, operation); (table, aggregate).  {cond} stands for the
# condition that the order key picks.
EXPECTED = {
    0: dict(tables="orders", columns="orders.o_orderstatus? orders.o_totalprice? orders.o_orderkey?", filters="orders.o_orderkey", ops="orders:WHERE"),
    1: dict(tables="orders=T1 lineitem=T2", columns="lineitem.l_partkey orders.o_orderkey lineitem.l_orderkey",
            on=[("lineitem", "orders", "orders.o_orderkey = lineitem.l_orderkey")], filters="orders.o_orderkey", ops="orders:WHERE",
            aggs="lineitem:COUNT lineitem:DISTINCT"),
    2: dict(tables="customer=c orders=o", columns="customer.c_name orders.o_custkey customer.c_custkey orders.o_orderkey",
            on=[("customer", "orders", "orders.o_custkey = customer.c_custkey")], filters="orders.o_orderkey", ops="orders:WHERE"),
    3: dict(tables="nation=n customer=c orders=o",
            columns="nation.n_name nation.n_nationkey customer.c_nationkey customer.c_custkey orders.o_custkey orders.o_orderkey",
            on=[("customer", "nation", "nation.n_nationkey = customer.c_nationkey"), ("customer", "orders", "customer.c_custkey = orders.o_custkey")],
            filters="orders.o_orderkey", ops="orders:WHERE"),
    4: dict(tables="supplier=s nation=n", columns="supplier.s_name nation.n_name supplier.s_nationkey nation.n_nationkey supplier.s_suppkey",
            where=[("supplier", "nation", "supplier.s_nationkey = nation.n_nationkey")], filters="supplier.s_suppkey", ops="supplier:WHERE"),
    5: dict(tables="part=p lineitem=l", columns="part.p_name {left} {right} lineitem.l_orderkey",
            on=[("lineitem", "part", "{cond}")], filters="lineitem.l_orderkey", ops="lineitem:WHERE"),
    6: dict(tables="lineitem=l orders=o", columns="lineitem.l_linenumber lineitem.l_orderkey orders.o_orderkey lineitem.l_suppkey orders.o_custkey",
            on=[("lineitem", "orders", "lineitem.l_orderkey = orders.o_orderkey AND lineitem.l_suppkey = orders.o_custkey")],
            filters="orders.o_orderkey", ops="orders:WHERE"),
    7: dict(tables="lineitem", columns="lineitem.l_returnflag? lineitem.l_orderkey?", filters="lineitem.l_orderkey",
            ops="lineitem:WHERE lineitem:GROUP_BY lineitem:ORDER_BY lineitem:LIMIT", aggs="lineitem:COUNT"),
    8: dict(tables="lineitem=l supplier=s", columns="lineitem.l_extendedprice lineitem.l_suppkey supplier.s_suppkey lineitem.l_orderkey",
            on=[("lineitem", "supplier", "lineitem.l_suppkey = supplier.s_suppkey")], filters="lineitem.l_orderkey", ops="lineitem:WHERE"),
    9: dict(tables="customer=c orders=o", columns="customer.c_acctbal orders.o_totalprice customer.c_custkey orders.o_custkey orders.o_orderkey",
            on=[("customer", "orders", "customer.c_custkey = orders.o_custkey")], filters="orders.o_orderkey", ops="orders:WHERE",
            aggs="customer:MIN customer:MAX orders:AVG"),
    10: dict(tables="customer orders", columns=".c_name? .c_custkey? .o_custkey? .o_orderkey?"),
    11: dict(tables="lineitem", columns="lineitem.l_orderkey? lineitem.l_linenumber?", filters="lineitem.l_orderkey",
             ops="lineitem:WHERE lineitem:GROUP_BY", aggs="lineitem:COUNT"),
    12: dict(tables="orders=o", columns="orders.o_orderkey orders.o_orderpriority", filters="orders.o_orderpriority orders.o_orderkey", ops="orders:WHERE"),
    13: dict(tables="nation region", columns=".n_name? .n_nationkey? .r_name?"),
    14: dict(tables="part=p lineitem=l", columns="part.p_name part.p_partkey lineitem.l_partkey lineitem.l_orderkey part.p_size",
             filters="part.p_partkey part.p_size lineitem.l_orderkey", ops="part:WHERE lineitem:WHERE"),
    15: dict(tables="region=r nation=n", columns="region.r_name nation.n_nationkey region.r_regionkey nation.n_regionkey",
             on=[("nation", "region", "region.r_regionkey = nation.n_regionkey")], filters="nation.n_nationkey",
             ops="nation:WHERE region:GROUP_BY region:ORDER_BY", aggs="nation:COUNT"),
    16: dict(tables="customer=c recent=r orders", columns=".o_custkey? .o_totalprice? .o_orderkey? customer.c_name customer.c_custkey recent.o_custkey",
             on=[("customer", "recent", "customer.c_custkey = recent.o_custkey")]),
    17: dict(tables="supplier=s lineitem=l orders=o", columns="supplier.s_name supplier.s_suppkey lineitem.l_suppkey lineitem.l_orderkey orders.o_orderkey",
             filters="supplier.s_suppkey lineitem.l_orderkey orders.o_orderkey", ops="supplier:WHERE lineitem:WHERE orders:WHERE"),
    18: dict(tables="orders=o", columns="orders.o_orderstatus orders.o_orderkey", filters="orders.o_orderkey", ops="orders:WHERE"),
    19: dict(tables="orders", columns="orders.o_orderkey? orders.o_custkey? orders.o_totalprice?", filters="orders.o_custkey",
             ops="orders:WHERE orders:ORDER_BY orders:LIMIT"),
    20: dict(tables="orders=o lineitem=l", columns="orders.o_orderkey lineitem.l_orderkey lineitem.l_extendedprice orders.o_totalprice",
             on=[("lineitem", "orders", "orders.o_orderkey = lineitem.l_orderkey AND lineitem.l_extendedprice < orders.o_totalprice")]),
    21: dict(tables="customer=c", columns="customer.c_name customer.c_nationkey customer.c_acctbal customer.c_custkey", filters="customer.c_custkey",
             ops="customer:WHERE customer:ORDER_BY"),
    22: dict(tables="lineitem=l", columns="lineitem.l_quantity lineitem.l_returnflag lineitem.l_orderkey", filters="lineitem.l_orderkey",
             ops="lineitem:WHERE lineitem:GROUP_BY", aggs="lineitem:DISTINCT"),
}
REJECTED = {23: "not a query"}
# The conditions that template 5 may have: left column, right column, condition with the tables' names.
PICKED = [("part.p_partkey", "lineitem.l_partkey"), ("part.p_size", "lineitem.l_linenumber"), ("part.p_retailprice", "lineitem.l_extendedprice")]


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else q(v)
    return f"{name}({columns}) AS (VALUES\n    " + ",\n    ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"


def facts_cte() -> str:
    """The expected facts as VALUES per template and variant of its condition (-1: any), and the frames that the queries read."""
    tables, columns, on, where, filters, ops, aggs = [], [], [], [], [], [], []
    for tpl, e in EXPECTED.items():
        for k, t in enumerate(e["tables"].split()):
            name, _, alias = t.partition("=")
            tables.append((tpl, k + 1, name, alias or None))
        for v in (range(3) if tpl == 5 else [-1]):
            left, right = PICKED[max(v, 0)]
            fill = lambda s: s.replace("{left}", left).replace("{right}", right).replace("{cond}", f"{left} = {right}")
            for k, c in enumerate(fill(e["columns"]).split()):
                table, _, col = c.rstrip("?").partition(".")
                columns.append((tpl, v, k, col if c.endswith("?") else f"{table}.{col}", table or None, col))
            on += [(tpl, v, s, t, fill(c)) for s, t, c in e.get("on", [])]
            where += [(tpl, v, s, t, c) for s, t, c in e.get("where", [])]
        filters += [(tpl, *f.split(".")) for f in e.get("filters", "").split()]
        ops += [(tpl, o.split(":")[0], o.split(":")[1].replace("_", " ")) for o in e.get("ops", "").split()]
        aggs += [(tpl, *a.split(":")) for a in e.get("aggs", "").split()]
    return f"""
{_values("f_tables", 'tpl_id, table_pos, "table", alias', tables)},
{_values("f_columns", 'tpl_id, variant, pos, full_col, "table", "column"', columns)},
{_values("f_on", "tpl_id, variant, source, target, condition", on)},
{_values("f_where", "tpl_id, variant, source, target, condition", where)},
{_values("f_filters", 'tpl_id, "table", "column"', filters)},
{_values("f_ops", 'tpl_id, "table", op', ops)},
{_values("f_aggs", 'tpl_id, "table", agg', aggs)},
{_values("f_rejected", "tpl_id, reason", list(REJECTED.items()))},
v AS (SELECT query_id, tpl_id, sql, CASE WHEN (query_id // 24) % 15 < 10 THEN 0 WHEN (query_id // 24) % 15 < 13 THEN 1 ELSE 2 END AS variant FROM qlog),
qt AS (SELECT query_id, table_pos, "table", alias FROM v JOIN f_tables USING (tpl_id)),
tables AS (SELECT * FROM qt),
status AS (SELECT query_id, reason FROM v LEFT JOIN f_rejected USING (tpl_id)),
qc AS (SELECT query_id, pos, full_col, "table", "column" FROM v JOIN f_columns f ON f.tpl_id = v.tpl_id AND f.variant IN (-1, v.variant)),
join_edges AS (SELECT query_id, source, target, condition FROM v JOIN f_on f ON f.tpl_id = v.tpl_id AND f.variant IN (-1, v.variant)),
implicit_edges AS (SELECT query_id, source, target, condition FROM v JOIN f_where f ON f.tpl_id = v.tpl_id AND f.variant IN (-1, v.variant)),
predicates AS (SELECT query_id, "table", "column", CAST(1 AS BIGINT) AS n FROM v JOIN f_filters USING (tpl_id)),
operations AS (SELECT query_id, "table", op, CAST(1 AS BIGINT) AS n FROM v JOIN f_ops USING (tpl_id)),
aggregations AS (SELECT query_id, "table", agg, CAST(1 AS BIGINT) AS n FROM v JOIN f_aggs USING (tpl_id))"""


def normalize_condition_sql(col: str) -> str:
    return ("array_to_string(list_sort(list_transform(string_split(" + col + ", ' AND '), "
            "lambda e: array_to_string(list_sort(list_transform(string_split(e, '='), lambda x: trim(x))), ' = '))), ' AND ')")


GRAPH_CTE = f"""
qnodes AS (SELECT DISTINCT query_id, "table" FROM tables WHERE "table" <> '' AND lower("table") <> 'subquery'),
node_ids AS (SELECT DISTINCT "table" AS id FROM qnodes),
g_columns AS (SELECT "table" AS id, "column", count(*) AS freq FROM qc c
              WHERE "table" IS NOT NULL
                AND EXISTS (SELECT 1 FROM qnodes n WHERE n.query_id = c.query_id AND n."table" = c."table")
              GROUP BY "table", "column"),
op_dom(key) AS (VALUES {", ".join("(" + q(o) + ")" for o in OPERATIONS)}),
agg_dom(key) AS (VALUES {", ".join("(" + q(a) + ")" for a in AGGREGATIONS)}),
op_facts AS (SELECT o."table" AS id, op AS key, sum(n) AS freq FROM operations o
             WHERE EXISTS (SELECT 1 FROM qnodes n WHERE n.query_id = o.query_id AND n."table" = o."table")
             GROUP BY o."table", op),
agg_facts AS (SELECT a."table" AS id, agg AS key, sum(n) AS freq FROM aggregations a
              WHERE EXISTS (SELECT 1 FROM qnodes n WHERE n.query_id = a.query_id AND n."table" = a."table")
              GROUP BY a."table", agg),
g_operations AS (SELECT n.id, d.key, CAST(coalesce(f.freq, 0) AS BIGINT) AS freq
                 FROM node_ids n CROSS JOIN op_dom d LEFT JOIN op_facts f ON f.id = n.id AND f.key = d.key),
g_aggregations AS (SELECT n.id, d.key, CAST(coalesce(f.freq, 0) AS BIGINT) AS freq
                   FROM node_ids n CROSS JOIN agg_dom d LEFT JOIN agg_facts f ON f.id = n.id AND f.key = d.key),
known AS (SELECT DISTINCT id, lower("column") AS "column" FROM g_columns),
g_predicates AS (SELECT p.id, p."column", p.freq FROM (
                   SELECT p."table" AS id, p."column", sum(n) AS freq FROM predicates p
                   WHERE EXISTS (SELECT 1 FROM qnodes n WHERE n.query_id = p.query_id AND n."table" = p."table")
                   GROUP BY p."table", p."column") p
                 WHERE EXISTS (SELECT 1 FROM known k WHERE k.id = p.id AND k."column" = p."column")),
all_edges AS (SELECT source, target, condition FROM join_edges
              UNION ALL SELECT source, target, condition FROM implicit_edges),
canon AS (SELECT least(source, target) AS source, greatest(source, target) AS target,
                 {normalize_condition_sql('condition')} AS condition
          FROM all_edges WHERE source IS NOT NULL AND target IS NOT NULL AND source <> '' AND target <> ''
                           AND source <> target),
edge_cond AS (SELECT source, target, condition, count(*) AS freq FROM canon GROUP BY source, target, condition),
edges AS (SELECT *, sum(freq) OVER (PARTITION BY source, target) AS weight,
                 row_number() OVER (PARTITION BY source, target ORDER BY freq DESC, condition ASC) = 1 AS is_main
          FROM edge_cond)"""

# Candidate sample columns: every column of the star tables, as text.
STAR_COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
}


def samples_cte(k: int = 3) -> str:
    parts = []
    for t, cols in STAR_COLUMNS.items():
        for c in cols:
            parts.append(f"SELECT {q(t)} AS id, {q(c)} AS \"column\", CAST({c} AS VARCHAR) AS value FROM {t}")
    vals = "\n      UNION ALL ".join(parts)
    return f"""
vals AS ({vals}),
samples AS (SELECT id, "column", value, rn FROM (
              SELECT *, row_number() OVER (PARTITION BY id, "column" ORDER BY value) AS rn
              FROM (SELECT DISTINCT v.id, v."column", v.value FROM vals v
                    WHERE v.value IS NOT NULL
                      AND EXISTS (SELECT 1 FROM g_columns g WHERE g.id = v.id AND g."column" = v."column")))
            WHERE rn <= {k})"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes)


def _base() -> str:
    return _with(qlog_cte(), facts_cte())


def _graph() -> str:
    return _with(qlog_cte(), facts_cte(), GRAPH_CTE)


def oracle() -> dict[str, str]:
    b, g = _base(), _graph()
    lint = _with(qlog_cte()) + "\nSELECT query_id, " + ", ".join(
        f"tpl_id IN ({', '.join(map(str, t))}) AS {name}" for name, t in LINTED.items()) + " FROM qlog"
    return {
        "qlog_tables": b + "\nSELECT query_id, table_pos, \"table\", alias FROM qt",
        "qlog_join_edges": b + "\nSELECT query_id, source, target, condition FROM join_edges",
        "qlog_implicit_edges": b + "\nSELECT query_id, source, target, condition FROM implicit_edges",
        "qlog_columns": b + "\nSELECT query_id, full_col, \"table\", \"column\" FROM qc",
        "qlog_predicates": b + "\nSELECT query_id, \"table\", \"column\", n FROM predicates",
        "qlog_operations": b + "\nSELECT query_id, \"table\", op, n FROM operations",
        "qlog_aggregations": b + "\nSELECT query_id, \"table\", agg, n FROM aggregations",
        "qlog_rejects": b + "\nSELECT s.query_id, s.reason, l.sql FROM status s JOIN qlog l ON l.query_id = s.query_id WHERE s.reason IS NOT NULL",
        "qlog_lint": lint,
        "pattern_records": b + """,
pat AS (SELECT query_id, "table" || '/operations/' || op || '=' || n AS t FROM operations
        UNION ALL SELECT query_id, "table" || '/aggregations/' || agg || '=' || n FROM aggregations
        UNION ALL SELECT query_id, "table" || '/predicates/' || "column" || '=' || n FROM predicates),
both_edges AS (SELECT query_id, source || '|' || target || '|' || condition AS t FROM join_edges
               UNION ALL SELECT query_id, source || '|' || target || '|' || condition FROM implicit_edges),
ne AS (SELECT query_id, string_agg(t, ';' ORDER BY t) AS edges FROM both_edges GROUP BY query_id),
np AS (SELECT query_id, string_agg(t, ';' ORDER BY t) AS patterns FROM pat GROUP BY query_id),
nodes AS (SELECT query_id, string_agg("table", ',' ORDER BY table_pos) AS nodes FROM qt GROUP BY query_id),
cols AS (SELECT query_id, string_agg(full_col, ',' ORDER BY pos) AS columns FROM qc GROUP BY query_id)
SELECT n.query_id, n.nodes, c.columns, coalesce(ne.edges, '') AS edges, coalesce(np.patterns, '') AS patterns
FROM nodes n LEFT JOIN cols c ON c.query_id = n.query_id LEFT JOIN ne ON ne.query_id = n.query_id
LEFT JOIN np ON np.query_id = n.query_id""",
        "graph_nodes": g + """
SELECT id, 'operations' AS metric, key, freq FROM g_operations
UNION ALL SELECT id, 'aggregations' AS metric, key, freq FROM g_aggregations""",
        "graph_column_freq": g + "\nSELECT id, \"column\", freq FROM g_columns",
        "graph_operations": g + "\nSELECT id, key, freq FROM g_operations",
        "graph_aggregations": g + "\nSELECT id, key, freq FROM g_aggregations",
        "graph_predicates": g + "\nSELECT id, \"column\", freq FROM g_predicates",
        "graph_edges": g + "\nSELECT source, target, condition, freq FROM edges",
        "graph_edge_weight": g + "\nSELECT source, target, weight FROM edges WHERE is_main",
        "graph_main_condition": g + "\nSELECT source, target, condition, weight FROM edges WHERE is_main",
        "entity_samples": _with(qlog_cte(), facts_cte(), GRAPH_CTE, samples_cte())
        + "\nSELECT id, \"column\", value, rn FROM samples",
        "graph_stats": g + """
SELECT (SELECT count(*) FROM node_ids) AS n_nodes,
       (SELECT string_agg(id, ', ' ORDER BY id) FROM node_ids) AS node_list,
       (SELECT count(*) FROM edges WHERE is_main) AS n_edges,
       (SELECT string_agg(source || ' -> ' || target, ', ' ORDER BY source || ' -> ' || target)
        FROM edges WHERE is_main) AS edge_list""",
        "graph_node_link": _with(qlog_cte(), facts_cte(), GRAPH_CTE, samples_cte()) + """,
cols AS (SELECT id, string_agg("column" || '=' || freq, ',' ORDER BY "column" || '=' || freq) AS t FROM g_columns GROUP BY id),
ops AS (SELECT id, string_agg(key || '=' || freq, ',' ORDER BY key || '=' || freq) AS t FROM g_operations GROUP BY id),
agg AS (SELECT id, string_agg(key || '=' || freq, ',' ORDER BY key || '=' || freq) AS t FROM g_aggregations GROUP BY id),
prd AS (SELECT id, string_agg("column" || '=' || freq, ',' ORDER BY "column" || '=' || freq) AS t FROM g_predicates GROUP BY id),
per AS (SELECT id, "column" || '=' || string_agg(value, '|' ORDER BY rn) AS t FROM samples GROUP BY id, "column"),
smp AS (SELECT id, string_agg(t, ',' ORDER BY t) AS t FROM per GROUP BY id)
SELECT 'node' AS kind, n.id AS key, coalesce(cols.t, '') AS entries, coalesce(ops.t, '') AS operations, coalesce(agg.t, '') AS aggregations,
       coalesce(prd.t, '') AS predicates, coalesce(smp.t, '') AS samples, CAST(NULL AS BIGINT) AS weight
FROM node_ids n LEFT JOIN cols ON cols.id = n.id LEFT JOIN ops ON ops.id = n.id LEFT JOIN agg ON agg.id = n.id
LEFT JOIN prd ON prd.id = n.id LEFT JOIN smp ON smp.id = n.id
UNION ALL
SELECT 'edge', source || '->' || target, string_agg(condition || '=' || freq, ',' ORDER BY condition || '=' || freq), '', '', '',
       max(condition) FILTER (is_main), CAST(max(weight) AS BIGINT) FROM edges GROUP BY source, target""",
    }
