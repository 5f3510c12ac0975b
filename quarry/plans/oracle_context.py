"""DuckDB SQL twins of the linking and context queries."""

from __future__ import annotations

from ..functions import texts as TX
from ..sources.tables import STAR_TABLES
from .context import BAD_RESPONSE, DEFAULT_INSTRUCTIONS, GHOST_TABLE
from .oracle_navigation import NAV_CTE, _questions_cte, greedy_cte, metadata_cte
from .oracle_vectors import K, _knn_sql, _norm_sql, hash_embed_sql
from .oracle_vectors import oracle as oracle_vectors
from .oracle_workload import AGGREGATIONS, GRAPH_CTE, OPERATIONS, _with, facts_cte, q, qlog_cte, samples_cte

NL = q(chr(10))
WORD, FENCE = "[a-z0-9]+", "```json|```"
AVAIL = "[" + ", ".join(q(t) for t in STAR_TABLES) + "]"

LINK_CTE = f"""
svals AS (SELECT id, "column", string_agg('''' || value || '''', ', ' ORDER BY rn) AS vals FROM samples GROUP BY id, "column"),
qtabs AS (SELECT query_id, list("table" ORDER BY table_pos) AS tables FROM qt GROUP BY query_id),
resp AS (SELECT l.query_id AS qid,
           CASE WHEN t.tables IS NOT NULL
                THEN '```json' || {NL} || to_json(list_append(t.tables, {q(GHOST_TABLE)})) || {NL} || '```'
                ELSE {q(BAD_RESPONSE)} END AS response
         FROM qlog l LEFT JOIN qtabs t ON t.query_id = l.query_id),
parsed AS (SELECT qid, trim(regexp_replace(trim(response), {q(FENCE)}, '', 'g')) AS txt FROM resp),
linked AS (SELECT qid, coalesce(list_filter(CASE WHEN json_valid(txt) THEN from_json(txt, '["VARCHAR"]') END,
                                            lambda t: list_contains({AVAIL}, t)), []) AS tables FROM parsed)"""


def _ctx_cte() -> str:
    return f"""
items AS (SELECT item_id AS qid, text AS question FROM benchmark),
ivalid AS (SELECT * FROM valid WHERE qid IN (SELECT qid FROM items)),
ipairs AS (SELECT a.qid, a."table" AS ta, b."table" AS tb FROM ivalid a JOIN ivalid b
           ON a.qid = b.qid AND a.table_pos < b.table_pos),
ichosen AS (SELECT p.qid, b.path FROM ipairs p JOIN best b ON b.src = p.ta AND b.dst = p.tb),
iedges AS (SELECT DISTINCT qid, least(x, y) AS source, greatest(x, y) AS target FROM (
             SELECT qid, path[i] AS x, path[i + 1] AS y FROM (SELECT qid, path, unnest(range(1, len(path))) AS i FROM ichosen))),
irules AS (SELECT qid, string_agg(rule, {NL} ORDER BY rule) AS rules FROM (
             SELECT DISTINCT e.qid, r.rule FROM iedges e JOIN rules r ON r.source = e.source AND r.target = e.target)
           GROUP BY qid),
invalid AS (SELECT qid, count(*) AS n_valid FROM ivalid GROUP BY qid),
relevant AS (SELECT DISTINCT qid, "table" FROM (
               SELECT qid, unnest(path) AS "table" FROM ichosen WHERE qid IN (SELECT qid FROM irules)
               UNION ALL SELECT v.qid, v."table" FROM ivalid v JOIN invalid n ON n.qid = v.qid
               WHERE n.n_valid = 1 OR (n.n_valid > 1 AND v.qid NOT IN (SELECT qid FROM irules)))),
v1top AS (SELECT id, string_agg(printf('%s (freq: %d)', "column", freq), ', ' ORDER BY rank) AS top
          FROM top_cols GROUP BY id),
v1blocks AS (SELECT id, printf('{NL[1:-1]}Table: [%s]{NL[1:-1]}', id)
                 || CASE WHEN top IS NOT NULL THEN printf('  - Top Columns: %s{NL[1:-1]}', top) ELSE {q(TX.V1_NO_COLUMNS)} END
                 || {q(TX.V1_NO_FILTERS)} AS block FROM v1top),
imeta AS (SELECT r.qid, string_agg(b.block, '' ORDER BY r."table") AS meta
          FROM relevant r JOIN v1blocks b ON b.id = r."table" GROUP BY r.qid),
gctx AS (SELECT i.qid, CASE WHEN n.n_valid IS NULL THEN {q(TX.NO_VALID_TABLES)} ELSE
            (CASE WHEN n.n_valid = 1 THEN {q(TX.SINGLE_TABLE)}
                  ELSE {q(TX.JOIN_HEADER)} || coalesce(r.rules || {NL}, {q(TX.NO_PATHS)}) END)
            || {q(TX.METADATA_HEADER)} || coalesce(m.meta, '') END AS graph_ctx
         FROM items i LEFT JOIN invalid n ON n.qid = i.qid LEFT JOIN irules r ON r.qid = i.qid
         LEFT JOIN imeta m ON m.qid = i.qid)"""


def _vector_cte() -> str:
    return f"""
cnt AS (SELECT item_id, text, {hash_embed_sql('text')} AS c FROM benchmark),
docs AS (SELECT b.item_id AS id, b.text, coalesce(l.sql, '') AS sql, {_norm_sql('b.c')} AS vec
         FROM cnt b LEFT JOIN qlog l ON l.query_id = b.item_id),
hits AS ({_knn_sql('docs', K)}),
blocks AS (SELECT h.qid, string_agg(printf('- Example Question: ''%s''{NL[1:-1]}  Expected SQL: %s{NL[1:-1]}{NL[1:-1]}', d.text, d.sql), ''
                  ORDER BY h.rank) AS blocks
           FROM hits h JOIN docs d ON d.id = h.cid GROUP BY h.qid),
rag AS (SELECT d.id AS qid, 'As a strict reference, here are some examples:{NL[1:-1]}' || coalesce(b.blocks, '') AS rag_context
        FROM docs d LEFT JOIN blocks b ON b.qid = d.id)"""


def _hybrid2_cte() -> str:
    return f"""
picked AS (SELECT * FROM (SELECT * FROM o1 UNION ALL SELECT * FROM o2) WHERE qid IN (SELECT qid FROM items)),
h2chosen AS (SELECT qid, string_split(path_key, '>') AS path FROM picked WHERE path_key IS NOT NULL),
h2edges AS (SELECT DISTINCT qid, least(x, y) AS source, greatest(x, y) AS target FROM (
              SELECT qid, path[i] AS x, path[i + 1] AS y FROM (SELECT qid, path, unnest(range(1, len(path))) AS i FROM h2chosen))),
h2rules AS (SELECT qid, string_agg(rule, {NL} ORDER BY rule) AS rules FROM (
              SELECT DISTINCT e.qid, r.rule FROM h2edges e JOIN rules r ON r.source = e.source AND r.target = e.target) GROUP BY qid),
h2tables AS (SELECT DISTINCT qid, "table" FROM (
               SELECT qid, unnest(path) AS "table" FROM h2chosen
               UNION ALL SELECT qid, unnest(string_split(fallback, ',')) FROM picked WHERE fallback IS NOT NULL
               UNION ALL SELECT qid, arg_min("table", table_pos) FROM ivalid GROUP BY qid)),
h2meta AS (SELECT t.qid, string_agg(b.block, '' ORDER BY t."table") AS meta FROM h2tables t JOIN v2blocks b ON b.id = t."table" GROUP BY t.qid),
g2 AS (SELECT i.qid, CASE WHEN n.n_valid IS NULL THEN {q(TX.NO_VALID_TABLES)} ELSE
          (CASE WHEN n.n_valid = 1 THEN {q(TX.SINGLE_TABLE)} ELSE {q(TX.JOIN_HEADER)} || coalesce(r.rules || {NL}, {q(TX.NO_PATHS)}) END)
          || {q(TX.METADATA_HEADER)} || coalesce(m.meta, '') END AS graph_ctx
       FROM items i LEFT JOIN invalid n ON n.qid = i.qid LEFT JOIN h2rules r ON r.qid = i.qid LEFT JOIN h2meta m ON m.qid = i.qid),
elines AS (SELECT l.qid, v.id, string_agg('  - Column ''' || v."column" || ''' matches categorical values: [' || v.vals || ']' || {NL}, '' ORDER BY v."column") AS lines
           FROM (SELECT qid, unnest(tables) AS id FROM linked WHERE qid IN (SELECT qid FROM items)) l JOIN svals v ON v.id = l.id GROUP BY l.qid, v.id),
ents AS (SELECT qid, {q(TX.HYBRID2_ENTITIES)} || string_agg('Table [' || id || ']:' || {NL} || lines, '' ORDER BY id) || {NL} AS entities FROM elines GROUP BY qid)"""


def oracle() -> dict[str, str]:
    base = [qlog_cte(), facts_cte(), GRAPH_CTE, samples_cte()]
    g = _with(*base)
    gl = _with(*base, LINK_CTE)
    gn = _with(*base, NAV_CTE, _ctx_cte())
    gh = _with(*base, NAV_CTE, _ctx_cte(), _vector_cte())
    h2 = _with(*base, LINK_CTE, NAV_CTE, _ctx_cte(), _vector_cte(), _questions_cte(), greedy_cte(), metadata_cte(), _hybrid2_cte())
    out = {
        "schema_metadata": g + """
SELECT c.id, string_agg(c."column", ',' ORDER BY c."column") AS columns,
       coalesce(string_agg(CASE WHEN s.id IS NOT NULL THEN c."column" END, ',' ORDER BY c."column"), '') AS sample_columns,
       coalesce(string_agg(CASE WHEN s.id IS NOT NULL THEN c."column" || '=' || s.vals END, ';' ORDER BY c."column"), '') AS samples
FROM g_columns c LEFT JOIN (SELECT id, "column", string_agg(value, '|' ORDER BY rn) AS vals FROM samples GROUP BY id, "column") s ON s.id = c.id AND s."column" = c."column"
GROUP BY c.id""",
        "router_context": g + f""",
svals AS (SELECT id, "column", string_agg('''' || value || '''', ', ' ORDER BY rn) AS vals FROM samples GROUP BY id, "column")
SELECT c.id, to_json(map_from_entries(list(struct_pack(k := c."column",
         v := CASE WHEN v.vals IS NOT NULL THEN 'Examples: [' || v.vals || ']' ELSE {q(TX.NO_EXAMPLES)} END)
         ORDER BY c."column"))) AS router_json
FROM g_columns c LEFT JOIN svals v ON v.id = c.id AND v."column" = c."column"
WHERE list_contains({AVAIL}, c.id)
GROUP BY c.id""",
        "router_schema": g + f""",
svals AS (SELECT id, "column", string_agg('''' || value || '''', ', ' ORDER BY rn) AS vals FROM samples GROUP BY id, "column"),
rline AS (SELECT c.id, c."column", '    "' || c."column" || '": ' || to_json(CASE WHEN v.vals IS NOT NULL THEN 'Examples: [' || v.vals || ']' ELSE {q(TX.NO_EXAMPLES)} END)::VARCHAR AS line
          FROM g_columns c LEFT JOIN svals v ON v.id = c.id AND v."column" = c."column" WHERE list_contains({AVAIL}, c.id)),
rblock AS (SELECT id, '  "' || id || '": {{' || chr(10) || string_agg(line, ',' || chr(10) ORDER BY "column") || chr(10) || '  }}' AS block FROM rline GROUP BY id)
SELECT 'graph' AS kind, '{{' || chr(10) || string_agg(block, ',' || chr(10) ORDER BY id) || chr(10) || '}}' AS schema_context FROM rblock
UNION ALL SELECT 'list', '[''ghost'', ''phantom'']'""",
        "linked_tables_parse": gl + "\nSELECT qid, array_to_string(tables, ',') AS tables FROM linked",
        "linked_samples": gl + """
SELECT l.qid, s.id, s."column", s.value, s.rn
FROM (SELECT qid, unnest(tables) AS id FROM linked) l JOIN samples s ON s.id = l.id""",
        "lexical_link": g + f""",
mt AS (SELECT DISTINCT id, token FROM (
         SELECT id, unnest(regexp_extract_all(lower(id), {q(WORD)})) AS token FROM g_columns
         UNION ALL SELECT id, unnest(regexp_extract_all(lower("column"), {q(WORD)})) FROM g_columns
         UNION ALL SELECT id, unnest(regexp_extract_all(lower(value), {q(WORD)})) FROM samples)
       ),
qtok AS (SELECT query_id AS qid, unnest(list_distinct(regexp_extract_all(lower(question), {q(WORD)}))) AS token
         FROM qlog),
per AS (SELECT t.qid, m.id AS "table", count(*) AS hits FROM qtok t JOIN mt m ON m.token = t.token GROUP BY t.qid, m.id)
SELECT qid, "table", hits, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, "table") AS rank FROM per""",
        "ctx_graph": gn + f"""
SELECT i.qid AS question_id, {q(TX.GRAPH_CTX_HEAD)} || g.graph_ctx || {q(TX.QUESTION_TAIL)} || i.question AS context
FROM items i JOIN gctx g ON g.qid = i.qid""",
        "ctx_hybrid1": gh + f"""
SELECT i.qid AS question_id,
  '{NL[1:-1]}        --- SEMANTIC CONTEXT (Examples) ---{NL[1:-1]}        ' || coalesce(r.rag_context, '')
  || '{NL[1:-1]}{NL[1:-1]}        --- STRUCTURAL CONTEXT (Graph Rules) ---{NL[1:-1]}        ' || g.graph_ctx
  || '{NL[1:-1]}        ' || {q(TX.QUESTION_TAIL)} || i.question AS context
FROM items i LEFT JOIN rag r ON r.qid = i.qid LEFT JOIN gctx g ON g.qid = i.qid""",
        "ctx_hybrid2": h2 + f"""
SELECT i.qid AS question_id, {q(DEFAULT_INSTRUCTIONS)} || {q(TX.HYBRID2_SEMANTIC)} || coalesce(r.rag_context, '') || {NL} || {NL}
  || coalesce(e.entities, '') || {q(TX.HYBRID2_STRUCTURAL)} || g.graph_ctx || {NL} || {NL} || {q(TX.HYBRID2_QUESTION)} || i.question || {NL} || {NL} AS context
FROM items i LEFT JOIN rag r ON r.qid = i.qid LEFT JOIN g2 g ON g.qid = i.qid LEFT JOIN ents e ON e.qid = i.qid""",
    }
    parts = [("baseline", oracle_vectors()["ctx_baseline"]), ("vector", oracle_vectors()["ctx_vector"]), ("graph", out["ctx_graph"]),
             ("hybrid_v1", out["ctx_hybrid1"]), ("hybrid_v2", out["ctx_hybrid2"])]
    out["ctx_all"] = "\nUNION ALL\n".join(f"SELECT {q(name)} AS strategy, question_id, context FROM ({sql})" for name, sql in parts)
    return out
