"""DuckDB SQL twins of the catalog, SQL pass-through and source queries."""

from __future__ import annotations

from ..sources import adapters as A
from ..sources.tables import ALL_TABLES
from .catalog_sql import GHOST_TABLE, IGNORED, SQL, SQL_ONE
from . import oracle_telemetry
from .oracle_telemetry import runs_cte
from .oracle_workload import STAR_COLUMNS, _with, facts_cte, q, qlog_cte
from .oracle_vectors import _norm_sql, hash_embed_sql

NL = q(chr(10))
TYPE_MAP = "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' " \
           "WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'FLOAT[]' THEN 'array<float>' " \
           "ELSE lower(data_type) END"
COLUMNS = STAR_COLUMNS | {
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"], "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "embeddings": ["vec_id", "embedding", "label"], "pages": ["page_id", "url", "html"], "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn", "role", "text"],
}
STAR_IN = "(" + ", ".join(q(t) for t in COLUMNS) + ")"


def _ddl_cte() -> str:
    return f"""
ddl AS (SELECT table_name, 'CREATE TABLE ' || table_name || ' (' ||
               string_agg(column_name || ' ' || {TYPE_MAP}, ', ' ORDER BY ordinal_position) || ');' AS ddl
        FROM information_schema.columns WHERE table_name IN {STAR_IN} GROUP BY table_name)"""


def _samples_cte(n: int = 3) -> str:
    parts = []
    for t, cols in COLUMNS.items():
        cell = lambda c: f"CAST({c} AS VARCHAR)" if c != "embedding" else "'[' || array_to_string(list_transform(embedding, lambda x: CAST(x AS DECIMAL(38,6))), ', ') || ']'"
        line = " || chr(9) || ".join(f"coalesce({cell(c)}, 'None')" for c in cols)
        parts.append(f"(SELECT {q(t)} AS table_name, {line} AS line FROM (SELECT * FROM {t} ORDER BY {', '.join(cols)} LIMIT {n}))")
    union = "\n  UNION ALL ".join(parts)
    headers = ", ".join(f"({q(t)}, {q(chr(9).join(cols))})" for t, cols in COLUMNS.items())
    return f"""
srows AS (SELECT table_name, row_number() OVER (PARTITION BY table_name ORDER BY line) AS rn, line FROM (
  {union})),
hdr(table_name, header) AS (VALUES {headers}),
profile AS (SELECT d.table_name, d.ddl || {q(chr(10) + chr(10) + '/*' + chr(10))} || printf('%d rows from %s table:', {n}, d.table_name)
                   || {NL} || h.header || {NL} || coalesce(r.rows, '') || {q(chr(10) + '*/')} AS info
            FROM ddl d JOIN hdr h ON h.table_name = d.table_name
            LEFT JOIN (SELECT table_name, string_agg(line, {NL} ORDER BY rn) AS rows FROM srows GROUP BY table_name) r
              ON r.table_name = d.table_name)"""


# What a run record holds of the fields that logs keep; other providers than the known ones are unknown.
RECORD = "WITH " + runs_cte().strip("\n") + """
SELECT query_id, experiment, CASE WHEN provider IN ('google', 'cloudflare', 'claude', 'openai') THEN provider ELSE 'unknown' END AS llm,
  CASE WHEN spark_error IS NOT NULL THEN 'ERROR' WHEN sparksql_query IS NOT NULL THEN 'VALID' ELSE 'NOT_EXECUTED' END AS execution_status,
  coalesce(total_time, -1.0) AS total_time, coalesce(spark_time, -1.0) AS spark_time, coalesce(input_tokens, 0) AS input_tokens,
  coalesce(output_tokens, 0) AS output_tokens, accuracy FROM runs"""


def oracle() -> dict[str, str]:
    out = {k: v for k, v in SQL.items()}
    all_in = "(" + ", ".join(q(t) for t in ALL_TABLES) + ")"
    usable = "(" + ", ".join(q(t) for t in ALL_TABLES if t not in IGNORED) + ")"
    spec = "WITH " + qlog_cte().strip("\n") + """,
spec AS (SELECT query_id AS question_id, db_id, question, CAST(NULL AS VARCHAR) AS evidence, sql AS "SQL",
                coalesce(difficulty, 'unknown') AS difficulty FROM qlog WHERE db_id = 'tpch')"""
    out.update({
        "sql_run_one": SQL_ONE + " LIMIT 1",
        "rows_as_strings": f"SELECT CAST(n_name AS VARCHAR) AS c0, CAST(n_customers AS VARCHAR) AS c1 FROM ({SQL['sql_join_on']})",
        "catalog_tables": f"SELECT table_name FROM information_schema.tables WHERE table_name IN {all_in}",
        "catalog_usable": f"SELECT table_name FROM information_schema.tables WHERE table_name IN {usable}",
        "schema_ddl": "WITH " + _ddl_cte().strip("\n") + "\nSELECT table_name, ddl FROM ddl",
        "sample_rows": _with(_ddl_cte(), _samples_cte()) + "\nSELECT table_name, rn, line FROM srows",
        "table_profile": _with(_ddl_cte(), _samples_cte()) + "\nSELECT table_name, info FROM profile",
        "table_info_lookup": _with(qlog_cte(), facts_cte(), _ddl_cte(), _samples_cte()) + f""",
req AS (SELECT query_id AS qid, CASE WHEN count(*) >= 3 THEN list("table" ORDER BY table_pos) || [{q(GHOST_TABLE)}]
               ELSE list("table" ORDER BY table_pos) END AS names FROM qt GROUP BY query_id),
ex AS (SELECT qid, unnest(names) AS table_name, unnest(range(len(names))) AS pos FROM req),
j AS (SELECT e.qid, e.pos, e.table_name, p.info FROM ex e LEFT JOIN profile p ON p.table_name = e.table_name)
SELECT qid, CASE WHEN count(*) FILTER (WHERE info IS NULL) > 0
                 THEN 'Error: table_names {{' || string_agg('''' || table_name || '''', ', ' ORDER BY table_name)
                      FILTER (WHERE info IS NULL) || '}} not found in database'
                 ELSE string_agg(info, {q(chr(10) * 2)} ORDER BY pos) END AS info
FROM j GROUP BY qid""",
        "sql_status": """SELECT * FROM (VALUES ('group', true, 'VALID', false), ('most', true, 'VALID', false), ('unknown', false, 'ERROR', true)) t(name, ran, status, told)""",
        "sql_timed": "SELECT " + q(SQL["sql_group_count"]) + " AS query, true AS ran, CAST(NULL AS VARCHAR) AS error, count(*) AS rows, "
        "sum(strlen(l_returnflag) + strlen(l_linestatus) + strlen(CAST(n AS VARCHAR)))::BIGINT AS bytes, true AS took_time FROM (" + SQL["sql_group_count"] + ")",
        "rows_same_names": "SELECT CAST(o_orderkey AS VARCHAR) AS c0, CAST(o_custkey AS VARCHAR) AS c1 FROM orders",
        "parse_result_text": """SELECT CAST(n_nationkey AS BIGINT) AS key, CAST(1 AS BIGINT) AS n_rows, n_nationkey || '|' || n_name AS first_row FROM nation
UNION ALL SELECT 1000 + CAST(r_regionkey AS BIGINT), CAST(1 AS BIGINT), r_name FROM region""",
        "run_log_source": RECORD,
        "results_sink": RECORD,
        "log_summary_file": oracle_telemetry.oracle()["log_summary"],
        "results_extra": "WITH " + oracle_telemetry.spans_cte().strip("\n") + "," + oracle_telemetry.agent_cte() + f"""
SELECT e.query_id, 'e' || e.query_id % 3 AS experiment, CASE WHEN e.query_id % 2 = 0 THEN 'replaced' WHEN e.query_id % 5 = 4 THEN 'unknown'
    ELSE {oracle_telemetry._list(A.PROVIDERS)}[e.query_id % 5 + 1] END AS llm,
  CASE WHEN sparksql_query IS NULL THEN 'NOT_EXECUTED' WHEN err <> '' THEN 'ERROR' ELSE 'VALID' END AS execution_status,
  round((run_end - run_start) / 1e6, 6) AS total_time, 'q-' || e.query_id AS run_id, coalesce(llm.n, 0)::BIGINT AS llm_requests,
  round(per_tool.us / 1e6, 6) AS time_query_sql_db, nullif(split_part(thoughts, '|', 1), '') AS first_thought,
  CASE WHEN e.query_id % 2 = 0 THEN 'run q-' || e.query_id END AS note, CASE WHEN e.query_id % 2 = 0 THEN e.query_id * 3 END AS seed, 'benchmark-1' AS write
FROM ends e LEFT JOIN sql1 ON sql1.query_id = e.query_id LEFT JOIN llm ON llm.query_id = e.query_id
LEFT JOIN per_tool ON per_tool.query_id = e.query_id AND per_tool.name = 'query_sql_db'""",
        "vector_collection": "WITH " + qlog_cte().strip("\n") + """,
d AS (SELECT b.item_id AS cid, b.text, coalesce(l.sql, '') AS sql FROM benchmark b LEFT JOIN qlog l ON l.query_id = b.item_id)
SELECT cid, text, sql, 64 AS dims, CAST(2 AS BIGINT) AS version FROM d
UNION ALL SELECT cid + 1000000, text, sql, 64, 2 FROM d WHERE cid % 2 = 0""",
        "date_as_string": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders""",
        "spec_scan": spec + "\nSELECT * FROM spec",
        "spec_lookup": spec + "," + runs_cte().strip("\n") + """
SELECT s.question_id, concat_ws(' ', s.question, coalesce(s.evidence, '')) AS text, s."SQL" AS sql, s.difficulty
FROM runs r JOIN spec s ON s.question_id = r.query_id""",
        "vector_corpus": "WITH " + qlog_cte().strip("\n") + """
SELECT b.item_id AS cid, b.text, coalesce(l.sql, '') AS sql, 64 AS dims
FROM benchmark b LEFT JOIN qlog l ON l.query_id = b.item_id""",
    })
    return out
