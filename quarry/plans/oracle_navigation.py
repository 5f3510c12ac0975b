"""DuckDB SQL twins of the navigation queries."""

from __future__ import annotations

from ..functions import texts as TX
from .oracle_vectors import _norm_sql, hash_embed_sql
from .oracle_workload import AGGREGATIONS, GRAPH_CTE, OPERATIONS, _with, facts_cte, q, qlog_cte, samples_cte


def _dom_case(col: str, domain: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {q(d)} THEN {i}" for i, d in enumerate(domain)) + " END"


NAV_CTE = f"""
und AS (SELECT source AS src, target AS dst, weight FROM edges WHERE is_main
        UNION ALL SELECT target AS src, source AS dst, weight FROM edges WHERE is_main),
wn AS (SELECT src, dst, weight, ln(1 + weight) / ln(1 + (SELECT coalesce(max(weight), 1) FROM und)) AS norm FROM und),
p1 AS (SELECT src, dst, [src, dst] AS path, 1 AS hops, CAST(weight AS BIGINT) AS wsum, norm AS nsum FROM wn),
p2 AS (SELECT p.src, e.dst, list_append(p.path, e.dst) AS path, 2 AS hops, p.wsum + e.weight AS wsum,
              p.nsum + e.norm AS nsum
       FROM p1 p JOIN wn e ON e.src = p.dst AND NOT list_contains(p.path, e.dst)),
p3 AS (SELECT p.src, e.dst, list_append(p.path, e.dst) AS path, 3 AS hops, p.wsum + e.weight AS wsum,
              p.nsum + e.norm AS nsum
       FROM p2 p JOIN wn e ON e.src = p.dst AND NOT list_contains(p.path, e.dst)),
paths AS (SELECT *, array_to_string(path, '>') AS path_key, nsum / hops AS hist_score
          FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY wsum DESC, hops, path_key) AS rn
                        FROM paths) WHERE rn = 1),
alts AS (SELECT source, target, alt_rank, condition, freq FROM (
           SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY freq DESC, condition) AS alt_rank,
                  max(freq) OVER (PARTITION BY source, target) AS top_freq FROM edges)
         WHERE freq / top_freq >= {0.3}),
rules AS (SELECT source, target,
            CASE WHEN n_alt = 1 THEN printf('- For joining %s and %s use: %s', source, target, conds)
                 ELSE printf('- For joining %s and %s, multiple valid conditions exist depending on context, choose the correct one: %s', source, target, conds) END AS rule
          FROM (SELECT source, target, count(*) AS n_alt, string_agg(condition, ' OR ' ORDER BY alt_rank) AS conds
                FROM alts GROUP BY source, target)),
valid AS (SELECT query_id AS qid, table_pos, "table" FROM qt WHERE "table" IN (SELECT id FROM node_ids)),
pairs AS (SELECT a.qid, a.table_pos AS pa, b.table_pos AS pb, a."table" AS ta, b."table" AS tb
          FROM valid a JOIN valid b ON a.qid = b.qid AND a.table_pos < b.table_pos),
chosen AS (SELECT p.qid, b.path FROM pairs p JOIN best b ON b.src = p.ta AND b.dst = p.tb),
pedges AS (SELECT DISTINCT qid, least(x, y) AS source, greatest(x, y) AS target FROM (
             SELECT qid, path[i] AS x, path[i + 1] AS y FROM (SELECT qid, path, unnest(range(1, len(path))) AS i FROM chosen))),
qrules AS (SELECT qid, string_agg(rule, {q(chr(10))} ORDER BY rule) AS rules FROM (
             SELECT DISTINCT e.qid, r.rule FROM pedges e JOIN rules r ON r.source = e.source AND r.target = e.target)
           GROUP BY qid),
nvalid AS (SELECT qid, count(*) AS n_valid FROM valid GROUP BY qid),
top_cols AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY freq DESC, "column") AS rank FROM g_columns)
             WHERE rank <= {3}),
act_ops AS (SELECT id, string_agg(key, ', ' ORDER BY freq DESC, {_dom_case('key', OPERATIONS)}) AS operations
            FROM g_operations WHERE freq > 0 GROUP BY id),
act_aggs AS (SELECT id, string_agg(key, ', ' ORDER BY freq DESC, {_dom_case('key', AGGREGATIONS)}) AS aggregations
             FROM g_aggregations WHERE freq > 0 GROUP BY id),
act_preds AS (SELECT id, string_agg("column", ', ' ORDER BY rank) AS predicates FROM (
                SELECT *, row_number() OVER (PARTITION BY id ORDER BY freq DESC, "column") AS rank FROM g_predicates)
              WHERE rank <= {3} GROUP BY id),
patterns AS (SELECT n.id, o.operations, a.aggregations, p.predicates FROM node_ids n
             LEFT JOIN act_ops o ON o.id = n.id LEFT JOIN act_aggs a ON a.id = n.id LEFT JOIN act_preds p ON p.id = n.id)"""


def _questions_cte() -> str:
    return f"""
qv0 AS (SELECT query_id AS qid, question, {hash_embed_sql('question')} AS c FROM qlog),
qv AS (SELECT qid, {_norm_sql('c')} AS qvec FROM qv0)"""


def _cos(a: str, b: str) -> str:
    return (f"(CASE WHEN {a} IS NULL OR {b} IS NULL OR len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE "
            f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i])) / "
            f"(sqrt(list_sum(list_transform({a}, lambda x: x * x))) * sqrt(list_sum(list_transform({b}, lambda x: x * x)))) END)")


def metadata_cte() -> str:
    """The metadata block of every table, version 2."""
    newline = q(chr(10))
    return f"""
top AS (SELECT id, string_agg("column", ', ' ORDER BY rank) AS top FROM top_cols GROUP BY id),
scol AS (SELECT id, "column", string_agg('''' || value || '''', ', ' ORDER BY rn) AS vals FROM samples GROUP BY id, "column"),
slines AS (SELECT id, string_agg(printf('    * %s: [%s]' || {newline}, "column", vals), '' ORDER BY "column") AS samples
           FROM scol GROUP BY id),
v2blocks AS (
SELECT p.id,
  printf('{newline[1:-1]}Table: [%s]{newline[1:-1]}', p.id)
  || CASE WHEN t.top IS NOT NULL THEN printf('  - Frequently referenced columns: %s{newline[1:-1]}', t.top) ELSE '' END
  || CASE WHEN s.samples IS NOT NULL THEN '  - Sample data formats:{newline[1:-1]}' || s.samples ELSE '' END
  || '  - Historical SQL patterns:{newline[1:-1]}'
  || CASE WHEN p.predicates IS NULL AND p.operations IS NULL AND p.aggregations IS NULL
          THEN '    * No structural patterns identified.{newline[1:-1]}'
          ELSE CASE WHEN p.predicates IS NOT NULL THEN printf('    * WHERE clauses frequently use: %s{newline[1:-1]}', p.predicates) ELSE '' END
            || CASE WHEN p.operations IS NOT NULL THEN printf('    * Used operators: %s{newline[1:-1]}', p.operations) ELSE '' END
            || CASE WHEN p.aggregations IS NOT NULL THEN printf('    * Aggregations: %s{newline[1:-1]}', p.aggregations) ELSE '' END
     END AS block
FROM patterns p LEFT JOIN top t ON t.id = p.id LEFT JOIN slines s ON s.id = p.id)"""


def greedy_cte(ghost: bool = False) -> str:
    """The greedy connection unrolled: no question of the log asks for more than three tables, so two rounds suffice.

    ``ghost``: questions for two tables ask for a third one that is in no edge.
    """
    def step(n: int) -> str:
        return f"""
c{n} AS (SELECT s.qid, x.path, x.path_key, x.hops, x.hist_score FROM s{n} s JOIN paths x
         ON list_contains(s.connected, x.src) AND list_contains(s.pending, x.dst) WHERE s.active AND len(s.pending) > 0),
t{n} AS (SELECT c.*, (0.4 * hist_score + 0.6 * {_cos('v.qvec', 'p.pvec')}) * pow(0.95, hops - 1) AS total
         FROM c{n} c JOIN gpv p ON p.path_key = c.path_key JOIN qv v ON v.qid = c.qid),
b{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(total, 9) DESC, hops, path_key) AS r FROM t{n}) WHERE r = 1),
j{n} AS (SELECT s.*, b.path, b.path_key, b.total FROM s{n} s LEFT JOIN b{n} b ON b.qid = s.qid),
o{n} AS (SELECT qid, {n} AS round, path_key, round(total, 6) AS total,
                CASE WHEN path IS NULL THEN array_to_string(pending, ',') END AS fallback
         FROM j{n} WHERE path IS NOT NULL OR active AND len(pending) > 0),
s{n + 1} AS (SELECT qid, CASE WHEN path IS NULL THEN connected ELSE list_concat(connected, list_filter(path, lambda x: NOT list_contains(connected, x))) END AS connected,
                CASE WHEN path IS NULL THEN pending ELSE list_filter(pending, lambda x: NOT list_contains(path, x)) END AS pending,
                active AND path IS NOT NULL AS active FROM j{n})"""

    return f"""
gpv0 AS (SELECT DISTINCT path_key, array_to_string(path, ' ') AS path_text FROM paths),
gpv AS (SELECT path_key, {_norm_sql(hash_embed_sql('path_text'))} AS pvec FROM gpv0),
asked0 AS (SELECT qid, list("table" ORDER BY table_pos) AS ts FROM valid GROUP BY qid),
asked AS (SELECT qid, {"CASE WHEN len(ts) = 2 THEN list_append(ts, 'ghost') ELSE ts END" if ghost else "ts"} AS ts FROM asked0),
s1 AS (SELECT qid, ts[1:1] AS connected, ts[2:] AS pending, true AS active FROM asked),{step(1)},{step(2)}"""


def oracle() -> dict[str, str]:
    g = _with(qlog_cte(), facts_cte(), GRAPH_CTE, NAV_CTE)
    gs = _with(qlog_cte(), facts_cte(), GRAPH_CTE, samples_cte(), NAV_CTE)
    two = _with(qlog_cte(), facts_cte(), GRAPH_CTE, NAV_CTE, _questions_cte()) + f""",
two_q AS (SELECT qid FROM nvalid WHERE n_valid = 2),
cand AS (SELECT p.qid, x.path_key, x.hops, x.hist_score, x.path FROM pairs p JOIN paths x ON x.src = p.ta AND x.dst = p.tb
         WHERE p.qid IN (SELECT qid FROM two_q)),
pv0 AS (SELECT DISTINCT path_key, array_to_string(path, ' ') AS path_text FROM cand),
pv AS (SELECT path_key, {_norm_sql(hash_embed_sql('path_text'))} AS pvec FROM pv0),
sc AS (SELECT c.qid, c.path_key, c.hops, c.hist_score, {_cos('v.qvec', 'p.pvec')} AS sem_score
       FROM cand c JOIN pv p ON p.path_key = c.path_key JOIN qv v ON v.qid = c.qid),
tot AS (SELECT *, ({0.4} * hist_score + {0.6} * sem_score) * pow({0.95}, hops - 1) AS total FROM sc)"""
    newline = q(chr(10))
    return {
        "graph_undirected": g + "\nSELECT src, dst, weight FROM und",
        "graph_weight_norm": g + "\nSELECT src, dst, weight, round(norm, 6) AS norm FROM wn",
        "graph_paths_3hop": g + "\nSELECT src, dst, path_key, hops, wsum, round(hist_score, 6) AS hist_score FROM paths",
        "graph_best_path": g + "\nSELECT src, dst, path_key, hops, wsum FROM best WHERE EXISTS (SELECT 1 FROM pairs WHERE ta = src AND tb = dst)",
        "graph_join_alternatives": g + "\nSELECT source, target, alt_rank, condition, freq FROM alts",
        "nav_valid_tables": g + "\nSELECT qid, table_pos, \"table\" FROM valid",
        "nav_pairs": g + "\nSELECT qid, ta, tb FROM pairs",
        "nav_join_rules": g + f"""
SELECT n.qid, CASE WHEN n.n_valid = 1 THEN {q(TX.SINGLE_TABLE)}
                   ELSE {q(TX.JOIN_HEADER)} || coalesce(r.rules || {newline}, {q(TX.NO_PATHS)}) END AS join_text
FROM nvalid n LEFT JOIN qrules r ON r.qid = n.qid""",
        "nav_top_columns": g + "\nSELECT id, rank, \"column\", freq FROM top_cols",
        "nav_active_patterns": g + "\nSELECT id, operations, aggregations, predicates FROM patterns",
        "nav_metadata_text": gs + "," + metadata_cte() + "\nSELECT id, block FROM v2blocks",
        "nav_greedy_connect": _with(qlog_cte(), facts_cte(), GRAPH_CTE, NAV_CTE, _questions_cte(), greedy_cte())
        + "\nSELECT * FROM o1 UNION ALL SELECT * FROM o2",
        "nav_fallback": _with(qlog_cte(), facts_cte(), GRAPH_CTE, NAV_CTE, _questions_cte(), greedy_cte(ghost=True))
        + "\nSELECT * FROM o1 UNION ALL SELECT * FROM o2",
        "path_hybrid_score": two + """
SELECT qid, path_key, hops, round(hist_score, 6) AS hist_score, round(sem_score, 6) AS sem_score,
       round(total, 6) AS total FROM tot""",
        "nav_two_tables": two + """
SELECT qid, path_key, round(total, 6) AS total FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(total, 9) DESC, hops, path_key) AS r FROM tot)
WHERE r = 1""",
    }
