"""DuckDB SQL twins of the scoring queries."""

from __future__ import annotations

from ..sources import adapters as A
from .oracle_telemetry import runs_cte
from .oracle_workload import q


NULL_WORDS = ["none", "null", "nan", "na", "n/a"]
INTEGER = "^[+-]?[0-9]+$"
NUMBER = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$"
SPACES_AT_ENDS = "^[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{2000}-\\x{200A}]+|[\\s\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{2000}-\\x{200A}]+$"


def whole_sql(d: str) -> str:
    return (f"(CASE WHEN {d} IS NOT NULL AND NOT isnan({d}) AND abs({d}) < 1.7e38 AND {d} % 1 = 0 "
            f"THEN (CASE WHEN abs({d}) < 9e18 THEN CAST(CAST({d} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST(CAST({d} AS HUGEINT) AS VARCHAR) END) END)")


def canon_text_sql(c: str) -> str:
    s = f"regexp_replace({c}, {q(SPACES_AT_ENDS)}, '', 'g')"
    digits = f"regexp_replace({s}, '^[+-]?0*', '')"
    d = f"(CASE WHEN regexp_matches({s}, {q(NUMBER)}) THEN TRY_CAST({s} AS DOUBLE) END)"
    words = ", ".join(q(w) for w in NULL_WORDS)
    return (f"(CASE WHEN {c} IS NULL THEN '__NULL__' "
            f"WHEN regexp_matches({s}, {q(INTEGER)}) THEN (CASE WHEN {digits} = '' THEN '0' "
            f"WHEN starts_with({s}, '-') THEN '-' || {digits} ELSE {digits} END) "
            f"WHEN {whole_sql(d)} IS NOT NULL THEN {whole_sql(d)} "
            f"WHEN lower({s}) IN ({words}) THEN '__NULL__' ELSE {s} END)")


def canon_double_sql(c: str) -> str:
    return (f"(CASE WHEN {c} IS NULL OR isnan({c}) THEN '__NULL__' "
            f"ELSE coalesce({whole_sql(c)}, CAST({c} AS VARCHAR)) END)")


def canon_int_sql(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL THEN '__NULL__' ELSE CAST({c} AS VARCHAR) END)"


def h60_sql(x: str, at: int = 1) -> str:
    return f"CAST(('0x' || substr(md5({x}), {at}, 15)) AS BIGINT)"


CASES_CTE = f"""
cases AS (SELECT o_orderkey AS case_id, o_orderstatus AS status FROM orders),
li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag,
              row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
              count(*) OVER (PARTITION BY l_orderkey) AS n,
              l_orderkey % {A.N_VARIANTS} AS v
       FROM lineitem),
gold AS (SELECT l_orderkey AS case_id, pos, l_partkey AS g0, l_quantity AS g1, l_returnflag AS g2 FROM li),
p AS (SELECT l_orderkey AS case_id,
             CASE WHEN v = 3 THEN n - 1 - pos WHEN v = 4 THEN pos * 2 ELSE pos END AS pos,
             CASE WHEN v = 1 THEN l_returnflag WHEN v = 5 THEN CAST(l_partkey AS VARCHAR) || '.0'
                  ELSE CAST(l_partkey AS VARCHAR) END AS p0,
             CASE WHEN v = 1 THEN CAST(l_suppkey AS VARCHAR)
                  WHEN v = 2 AND pos = 0 THEN CAST(l_quantity + 1 AS VARCHAR)
                  ELSE CAST(l_quantity AS VARCHAR) END AS p1,
             CASE WHEN v = 1 THEN CAST(l_quantity AS VARCHAR) WHEN v = 5 THEN lower(l_returnflag)
                  ELSE l_returnflag END AS p2,
             CASE WHEN v = 1 THEN CAST(l_partkey AS VARCHAR) END AS p3
      FROM li WHERE v <> 6),
pred AS (SELECT * FROM p UNION ALL SELECT case_id, pos + 1, p0, p1, p2, p3 FROM p WHERE case_id % {A.N_VARIANTS} = 4),
gcells AS (SELECT case_id, pos, 0 AS col_idx, {canon_int_sql('g0')} AS value FROM gold
           UNION ALL SELECT case_id, pos, 1, {canon_double_sql('g1')} FROM gold
           UNION ALL SELECT case_id, pos, 2, {canon_text_sql('g2')} FROM gold),
pcells AS (SELECT case_id, pos, 0 AS col_idx, {canon_text_sql('p0')} AS value FROM pred
           UNION ALL SELECT case_id, pos, 1, {canon_text_sql('p1')} FROM pred
           UNION ALL SELECT case_id, pos, 2, {canon_text_sql('p2')} FROM pred
           UNION ALL SELECT case_id, pos, 3, {canon_text_sql('p3')} FROM pred),
gsig AS (SELECT case_id, col_idx, count(*) AS n,
                bit_xor({h60_sql("CAST(pos AS VARCHAR) || '|' || value")}) AS h1,
                bit_xor({h60_sql("CAST(pos AS VARCHAR) || '|' || value", 18)}) AS h2
         FROM gcells GROUP BY case_id, col_idx),
psig AS (SELECT case_id, col_idx, count(*) AS n,
                bit_xor({h60_sql("CAST(pos AS VARCHAR) || '|' || value")}) AS h1,
                bit_xor({h60_sql("CAST(pos AS VARCHAR) || '|' || value", 18)}) AS h2
         FROM pcells GROUP BY case_id, col_idx),
grel AS (SELECT case_id, col_idx, count(*) AS n, bit_xor({h60_sql('value')}) AS h1,
                bit_xor({h60_sql('value', 18)}) AS h2
         FROM (SELECT DISTINCT case_id, col_idx, lower(value) AS value FROM gcells) GROUP BY case_id, col_idx),
prel AS (SELECT case_id, col_idx, count(*) AS n, bit_xor({h60_sql('value')}) AS h1,
                bit_xor({h60_sql('value', 18)}) AS h2
         FROM (SELECT DISTINCT case_id, col_idx, lower(value) AS value FROM pcells) GROUP BY case_id, col_idx),
grows AS (SELECT case_id, count(*) AS rows FROM gold GROUP BY case_id),
prows AS (SELECT case_id, count(*) AS rows FROM pred GROUP BY case_id)"""


def _score_sql(g: str, p: str) -> str:
    return f"""
SELECT c.case_id,
       CASE WHEN coalesce(gr.rows, 0) = 0 AND coalesce(pr.rows, 0) = 0 THEN 1.0
            WHEN coalesce(gr.rows, 0) = 0 OR coalesce(pr.rows, 0) = 0 THEN 0.0
            WHEN coalesce(ok.all_found, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM cases c LEFT JOIN grows gr ON gr.case_id = c.case_id LEFT JOIN prows pr ON pr.case_id = c.case_id
LEFT JOIN (SELECT g.case_id, bool_and(coalesce(p.p_cnt, 0) >= g.g_cnt) AS all_found
           FROM (SELECT case_id, n, h1, h2, count(*) AS g_cnt FROM {g} GROUP BY ALL) g
           LEFT JOIN (SELECT case_id, n, h1, h2, count(*) AS p_cnt FROM {p} GROUP BY ALL) p
             ON p.case_id = g.case_id AND p.n = g.n AND p.h1 = g.h1 AND p.h2 = g.h2
           GROUP BY g.case_id) ok ON ok.case_id = c.case_id"""


EMPTY_RULES = f"""
SELECT f.case_id, CASE WHEN g AND p THEN 1.0::DOUBLE WHEN g OR p THEN 0.0::DOUBLE ELSE f.score END AS score
FROM (SELECT c.case_id, f.score, c.case_id % 4 < 2 OR gr.rows IS NULL AS g, c.case_id % 2 = 0 OR pr.rows IS NULL AS p
      FROM cases c JOIN ({_score_sql('gsig', 'psig')}) f ON f.case_id = c.case_id
      LEFT JOIN grows gr ON gr.case_id = c.case_id LEFT JOIN prows pr ON pr.case_id = c.case_id) f"""


def oracle() -> dict[str, str]:
    w = "WITH " + CASES_CTE.strip("\n")
    canon_src = """
s AS (SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_partkey, l_returnflag, l_linestatus,
             ' +0' || CAST(l_partkey AS VARCHAR) || ' ' AS padded_key,
             CAST(l_tax AS VARCHAR) || 'd' AS tax_d,
             CASE WHEN l_linestatus = 'O' THEN ' n/a ' ELSE l_linestatus END AS status_txt,
             CAST(l_quantity AS VARCHAR) || 'e2' AS sci_txt
      FROM lineitem)"""
    return {
        "accuracy_empty_rules": w + EMPTY_RULES,
        "execution_accuracy_exact": w + _score_sql("gsig", "psig"),
        "execution_accuracy_relaxed_exact": w + _score_sql("grel", "prel"),
        "canonical_value": "WITH " + canon_src.strip("\n") + f"""
SELECT l_orderkey, l_linenumber, {canon_double_sql('l_quantity')} AS quantity, {canon_double_sql('l_tax')} AS tax,
       {canon_int_sql('l_partkey')} AS partkey, {canon_text_sql('padded_key')} AS padded_key,
       {canon_text_sql('tax_d')} AS tax_d, {canon_text_sql('status_txt')} AS status_txt,
       {canon_text_sql('sci_txt')} AS sci_txt, {canon_text_sql('CAST(l_quantity AS VARCHAR)')} AS quantity_txt
FROM s""",
        "canonical_value_relaxed": "WITH " + canon_src.strip("\n") + f"""
SELECT l_orderkey, l_linenumber, lower({canon_text_sql('l_returnflag')}) AS flag,
       lower({canon_text_sql('status_txt')}) AS status_txt, lower({canon_text_sql('padded_key')}) AS padded_key
FROM s""",
        "column_signature_strict": w + """
SELECT 'gold' AS side, case_id, col_idx, n, h1, h2 FROM gsig
UNION ALL SELECT 'pred' AS side, case_id, col_idx, n, h1, h2 FROM psig""",
        "column_signature_relaxed": w + """
SELECT 'gold' AS side, case_id, col_idx, n, h1, h2 FROM grel
UNION ALL SELECT 'pred' AS side, case_id, col_idx, n, h1, h2 FROM prel""",
        "execution_accuracy": w + _score_sql("gsig", "psig"),
        "execution_accuracy_relaxed": w + _score_sql("grel", "prel"),
        "accuracy_per_run": "WITH " + ",".join([CASES_CTE.strip("\n"), runs_cte().strip("\n")]) + f""",
scores AS ({_score_sql("gsig", "psig")})
SELECT r.query_id, r.experiment, r.execution_status,
       CASE WHEN r.execution_status = 'VALID' THEN coalesce(s.score, 0.0) ELSE 0.0::DOUBLE END AS accuracy
FROM scored r LEFT JOIN scores s ON s.case_id = r.query_id
WHERE r.query_id IN (SELECT case_id FROM cases WHERE status <> 'P')""",
    }
