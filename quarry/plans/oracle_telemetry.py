"""DuckDB SQL twins of the telemetry and report queries."""

from __future__ import annotations

from ..functions import texts as TX
from ..sources import adapters as A
from .oracle_workload import qlog_cte, q
from .telemetry import PRICES

SCHEMA_TOOL, MAX_SCHEMA_CALLS = "schema_sql_db", 3
KNOWN_PROVIDERS = ["google", "cloudflare", "claude", "openai"]
DIFFICULTY_ORDER = ["Simple", "Moderate", "Challenging"]
QUESTION_RANGE = (195, 339)


def _list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def spans_cte() -> str:
    return f"""
spans AS (
  SELECT 'run-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS run_id, event_id AS span_id,
         CASE event_type WHEN 'click' THEN 'llm' WHEN 'view' THEN 'tool' WHEN 'purchase' THEN 'spark'
                         ELSE 'tool' END AS type,
         CASE WHEN event_type = 'click' THEN 'llm_call' WHEN event_type = 'purchase' THEN 'spark_run'
              ELSE {_list(A.TOOL_NAMES)}[user_id % {len(A.TOOL_NAMES)} + 1] END AS name,
         epoch_us(ts) AS start,
         CASE WHEN event_type <> 'error'
              THEN epoch_us(ts) + CAST(round(value * {A.SPAN_SECONDS_PER_VALUE * 1_000_000}) AS BIGINT) END AS "end",
         CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 7 END AS input_tokens,
         CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) * 3 END AS output_tokens,
         CASE WHEN event_id - 1 - event_id % 3 >= 0 THEN event_id - 1 - event_id % 3 END AS parent_id,
         CASE WHEN event_type = 'click' THEN 'Prompt ' || event_id || ' of user ' || user_id END AS prompt,
         CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS cache_read,
         CASE WHEN event_type = 'click' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) // 2 END AS reasoning
  FROM events),
bounds AS (SELECT run_id, min(start) AS run_start, max(coalesce("end", start)) AS run_end
           FROM spans GROUP BY run_id),
closed AS (SELECT s.run_id, s.span_id, s.type, s.name, s.start, coalesce(s."end", b.run_end) AS "end",
                  CASE WHEN s."end" IS NOT NULL THEN NULL
                       WHEN s.name = {q(SCHEMA_TOOL)} THEN {q(TX.EARLY_EXIT_SCHEMA)}
                       ELSE {q(TX.EARLY_EXIT_OTHER)} END AS closed_reason
           FROM spans s LEFT JOIN bounds b ON b.run_id = s.run_id)"""


def runs_cte() -> str:
    return f"""
runs AS (
  SELECT event_id AS query_id,
         {_list(A.ARCHITECTURES)}[user_id % 5 + 1] AS experiment,
         {_list(A.DIFFICULTIES)}[event_id % 3 + 1] AS difficulty,
         {_list(A.PROVIDERS)}[user_id % 5 + 1] AS provider,
         CASE WHEN event_type <> 'signup' THEN 'SELECT * FROM t WHERE id = ' || CAST(event_id AS VARCHAR) END AS sparksql_query,
         CASE WHEN event_type = 'error' THEN 'Error: AnalysisException' END AS spark_error,
         CASE WHEN event_type NOT IN ('signup', 'error') THEN '[[' || json_extract_string(props, '$.k') || ']]' END AS query_result,
         CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy,
         CASE WHEN event_type IN ('purchase', 'view') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS relaxed_accuracy,
         CAST(json_extract_string(props, '$.k') AS BIGINT) * 7 AS input_tokens,
         CAST(json_extract_string(props, '$.k') AS BIGINT) * 3 AS output_tokens,
         value AS total_time,
         CASE WHEN event_type IN ('click', 'view', 'purchase') THEN value / 4 END AS spark_time
  FROM events),
scored AS (
  SELECT *, CASE WHEN spark_error IS NOT NULL THEN 'ERROR' WHEN sparksql_query IS NOT NULL THEN 'VALID'
                 ELSE 'NOT_EXECUTED' END AS execution_status,
         CASE WHEN spark_error IS NULL AND sparksql_query IS NOT NULL
              THEN coalesce(TRY_CAST(CAST(accuracy AS VARCHAR) AS DOUBLE), 0.0) ELSE 0.0::DOUBLE END AS score,
         CASE WHEN spark_error IS NULL AND sparksql_query IS NOT NULL
              THEN coalesce(relaxed_accuracy, 0.0) ELSE 0.0::DOUBLE END AS relaxed_score
  FROM runs),
by_arch AS (SELECT experiment AS architecture, avg(score) AS accuracy, avg(score) * 100 AS accuracy_pct
            FROM scored GROUP BY experiment)"""


def agent_cte() -> str:
    """Runs of eight events: ``ev`` (one row per span, open tool spans closed) and the pieces of the full record."""
    tools = _list(A.TOOL_NAMES)
    return f"""
raw AS (SELECT s.*, event_id // 8 AS query_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id FROM spans s JOIN events ON event_id = span_id),
ends AS (SELECT query_id, min(start) AS run_start, max(coalesce("end", start)) AS run_end FROM raw GROUP BY query_id),
ev AS (
  SELECT raw.query_id, span_id, type, name, start, coalesce("end", run_end) AS "end", parent_id, k, coalesce(input_tokens, 0) AS tin, coalesce(output_tokens, 0) AS tout,
    cache_read, reasoning, run_start, run_end,
    CASE type WHEN 'llm' THEN prompt WHEN 'tool' THEN 'table_' || user_id % 5 ELSE 'SELECT * FROM t WHERE id = ' || span_id END AS input,
    CASE WHEN type = 'llm' THEN CASE WHEN k % 5 = 0 THEN ' ' || chr(10) ELSE 'Thought: value ' || k || chr(10) END
         WHEN type = 'spark' THEN CASE WHEN k % 10 <> 3 THEN '[[' || k || ']]' END
         WHEN "end" IS NOT NULL THEN 'rows ' || k WHEN name = {q(SCHEMA_TOOL)} THEN {q(TX.EARLY_EXIT_SCHEMA)} ELSE {q(TX.EARLY_EXIT_OTHER)} END AS output,
    CASE WHEN type = 'spark' AND k % 10 = 3 THEN 'Error: AnalysisException' END AS error,
    CASE WHEN type = 'llm' AND k % 2 = 0 THEN {tools}[k % 4 + 1] || '/q=' || k || '/call-' || span_id || '/tool_call' ELSE '' END AS tool_calls
  FROM raw JOIN ends ON ends.query_id = raw.query_id),
sql1 AS (SELECT query_id, arg_min(input, (start, span_id)) AS sparksql_query, min(start) AS s0, arg_min("end" - start, (start, span_id)) AS us,
           arg_min(coalesce(error, ''), (start, span_id)) AS err, arg_min(coalesce(output, ''), (start, span_id)) AS res FROM ev WHERE type = 'spark' GROUP BY query_id),
per_tool AS (SELECT query_id, name, count(*) AS n, sum("end" - start) AS us,
    string_agg(span_id || '=' || ("end" - start) || ':' || input || ':' || output || ':' || coalesce(CAST(parent_id AS VARCHAR), ''), ',' ORDER BY CAST(span_id AS VARCHAR)) AS calls
  FROM ev WHERE type = 'tool' GROUP BY query_id, name),
tools AS (SELECT query_id, string_agg(name || '=' || us, ',' ORDER BY name) AS times, sum(us) AS us,
    string_agg(name || '=' || n || ':' || us || '(' || calls || ')', ',' ORDER BY name) AS metrics FROM per_tool GROUP BY query_id),
llm AS (SELECT query_id, count(*) AS n, sum(tin) AS tin, sum(tout) AS tout, sum("end" - start) AS us,
    string_agg(span_id || '=' || ("end" - start), ',' ORDER BY CAST(span_id AS VARCHAR)) AS times,
    string_agg(span_id || '=' || cache_read, ',' ORDER BY CAST(span_id AS VARCHAR)) AS din,
    string_agg(span_id || '=' || reasoning, ',' ORDER BY CAST(span_id AS VARCHAR)) AS dout,
    string_agg(CASE WHEN trim(output, ' ' || chr(10)) <> '' THEN trim(output, ' ' || chr(10)) END, '|' ORDER BY start, span_id) AS thoughts,
    arg_max(input, (start, span_id)) AS prompt, arg_max(output, ("end", start, span_id)) AS answer,
    string_agg(span_id || '=' || concat_ws(':', input, span_id, coalesce(CAST(parent_id AS VARCHAR), ''), tin + tout, tin, tout, cache_read, reasoning, "end" - start, tool_calls, output),
               ',' ORDER BY CAST(span_id AS VARCHAR)) AS calls
  FROM ev WHERE type = 'llm' GROUP BY query_id),
said AS (
  SELECT query_id, start AS t, 0 AS no, span_id, CASE type WHEN 'tool' THEN 'Action: ' || name || chr(10) || 'Action Input: ' || input ELSE 'Spark Query Executed: ' || input END AS text
  FROM ev WHERE type <> 'llm' UNION ALL SELECT query_id, "end", 1, span_id, 'Observation: ' || output FROM ev WHERE type = 'tool'),
chain AS (SELECT query_id, string_agg(text, '|' ORDER BY t, no, span_id) AS text FROM said GROUP BY query_id),
aev AS (SELECT query_id AS run_id, start AS t, CAST(type = 'llm' AS INTEGER) AS dl, CAST(type = 'spark' AS INTEGER) AS ds, CAST(type = 'tool' AS INTEGER) AS dt FROM ev
        UNION ALL SELECT query_id, "end", -CAST(type = 'llm' AS INTEGER), -CAST(type = 'spark' AS INTEGER), -CAST(type = 'tool' AS INTEGER) FROM ev),
apts AS (SELECT run_id, t, sum(dl) AS dl, sum(ds) AS ds, sum(dt) AS dt FROM aev GROUP BY run_id, t),
asw AS (SELECT run_id, sum(dl) OVER w AS cl, sum(ds) OVER w AS cs, sum(dt) OVER w AS ct, coalesce(lead(t) OVER w - t, 0) AS seg
        FROM apts WINDOW w AS (PARTITION BY run_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
parts AS (SELECT run_id AS query_id, sum(CASE WHEN cl > 0 THEN seg ELSE 0 END) + sum(CASE WHEN cs > 0 THEN seg ELSE 0 END) AS busy,
            sum(CASE WHEN ct > 0 AND cl = 0 AND cs = 0 THEN seg ELSE 0 END) AS overhead FROM asw GROUP BY run_id)"""


def _s(x: str) -> str:
    return f"round(({x}) / 1e6, 6)"


SWEEP = """
ev AS (SELECT run_id, start AS t, CAST(type = 'llm' AS INTEGER) AS dl, CAST(type = 'spark' AS INTEGER) AS ds,
              CAST(type = 'tool' AS INTEGER) AS dt
       FROM closed WHERE start IS NOT NULL AND "end" IS NOT NULL AND "end" >= start
       UNION ALL
       SELECT run_id, "end" AS t, -CAST(type = 'llm' AS INTEGER), -CAST(type = 'spark' AS INTEGER),
              -CAST(type = 'tool' AS INTEGER)
       FROM closed WHERE start IS NOT NULL AND "end" IS NOT NULL AND "end" >= start),
pts AS (SELECT run_id, t, sum(dl) AS dl, sum(ds) AS ds, sum(dt) AS dt FROM ev GROUP BY run_id, t),
sw AS (SELECT *, sum(dl) OVER w AS cl, sum(ds) OVER w AS cs, sum(dt) OVER w AS ct,
              coalesce(lead(t) OVER w - t, 0) AS seg, lead(t) OVER w AS t_next
       FROM pts WINDOW w AS (PARTITION BY run_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


CALLS = """,
held AS (SELECT c.span_id, arg_max(t.span_id, {'s': t.start, 'i': t.span_id}) AS tool_span_id
         FROM spans c JOIN spans t ON t.run_id = c.run_id AND t.start <= c.start AND (t."end" > c.start OR t."end" IS NULL)
         WHERE c.type = 'llm' AND t.type = 'tool' GROUP BY c.span_id),
calls AS (SELECT c.*, held.tool_span_id, t.name AS tool FROM spans c LEFT JOIN held ON held.span_id = c.span_id
          LEFT JOIN spans t ON t.span_id = held.tool_span_id WHERE c.type = 'llm')"""


def _union_sql(src: str, keys: str) -> str:
    """Gaps-and-islands over ``src`` (keys, s, e) -> (keys, start_us, end_us)."""
    return f"""
SELECT {keys}, min(s) AS start_us, max(e) AS end_us FROM (
  SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY s, e, nw DESC ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END AS nw
        FROM (SELECT *, max(e) OVER (PARTITION BY {keys} ORDER BY s, e
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe
              FROM {src})))
GROUP BY {keys}, island"""


def oracle() -> dict[str, str]:
    w = "WITH " + spans_cte().strip("\n")
    wr = "WITH " + ",".join([qlog_cte().strip("\n"), runs_cte().strip("\n")])
    raw_iv = "(SELECT run_id, type, start AS s, \"end\" AS e FROM spans WHERE start IS NOT NULL AND \"end\" IS NOT NULL AND \"end\" >= start)"
    tools = A.TOOL_NAMES
    prices = ", ".join(f"({q(p)}, {a}, {b})" for p, a, b in PRICES)
    agent_log = """
agent AS (SELECT conv_id, turn, role,
            CASE WHEN role = 'assistant' THEN 'Thought: ' || text || chr(10) || 'Action: query_sql_db' ELSE text END AS log,
            CASE WHEN role = 'assistant' THEN 'lc_run--' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) || '-0'
                 ELSE CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) END AS message_id
          FROM conversations)"""
    return {
        "span_pairing": w + f"""
SELECT span_id, run_id, type, name, {_s('start')} AS start, {_s('"end"')} AS "end",
       {_s('"end" - start')} AS duration FROM spans""",
        "span_close_open": w + f"""
SELECT span_id, run_id, name, {_s('"end"')} AS "end", closed_reason FROM closed""",
        "span_meta": w + """
SELECT span_id, parent_id, concat_ws(',', CASE WHEN "end" IS NOT NULL AND input_tokens IS NOT NULL THEN 'input_tokens=' || input_tokens END,
  CASE WHEN "end" IS NOT NULL AND output_tokens IS NOT NULL THEN 'output_tokens=' || output_tokens END,
  CASE WHEN prompt IS NOT NULL THEN 'prompt_len=' || length(prompt) END) AS meta FROM spans""",
        "span_tree": w.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
own AS (SELECT s.*, p.span_id AS up FROM spans s LEFT JOIN spans p ON p.run_id = s.run_id AND p.span_id = s.parent_id),
above AS (SELECT run_id, span_id, span_id AS anc, 0 AS d FROM own
          UNION ALL SELECT a.run_id, a.span_id, o.up, a.d + 1 FROM above a JOIN own o ON o.run_id = a.run_id AND o.span_id = a.anc WHERE o.up IS NOT NULL),
depths AS (SELECT run_id, span_id, max(d) AS depth, arg_max(anc, d) AS root FROM above GROUP BY run_id, span_id),
below AS (SELECT a.run_id, a.anc AS span_id, count(*) - 1 AS n_below, sum(coalesce(o.input_tokens, 0)) AS input_tokens_below,
            sum(coalesce(o.output_tokens, 0)) AS output_tokens_below
          FROM above a JOIN own o ON o.run_id = a.run_id AND o.span_id = a.span_id GROUP BY a.run_id, a.anc),
clipped AS (SELECT c.run_id, c.up, greatest(c.start, p.start) AS s, least(c."end", p."end") AS e
            FROM own c JOIN own p ON p.run_id = c.run_id AND p.span_id = c.up
            WHERE c."end" IS NOT NULL AND p."end" IS NOT NULL AND least(c."end", p."end") >= greatest(c.start, p.start)),
covered AS (SELECT run_id, up, sum(end_us - start_us) AS us FROM ({_union_sql('clipped', 'run_id, up')}) GROUP BY run_id, up)
SELECT o.run_id, o.span_id, o.up AS parent_id, d.root, d.depth::BIGINT AS depth, b.n_below::BIGINT AS n_below,
  b.input_tokens_below::BIGINT AS input_tokens_below, b.output_tokens_below::BIGINT AS output_tokens_below,
  {_s('o."end" - o.start')} AS duration, {_s('o."end" - o.start - coalesce(c.us, 0)')} AS self_time
FROM own o JOIN depths d ON d.run_id = o.run_id AND d.span_id = o.span_id JOIN below b ON b.run_id = o.run_id AND b.span_id = o.span_id
LEFT JOIN covered c ON c.run_id = o.run_id AND c.up = o.span_id""",
        "llm_calls": w + CALLS + f"""
SELECT run_id, span_id, parent_id, prompt, {_s('"end" - start')} AS duration, input_tokens, output_tokens,
  input_tokens + output_tokens AS total_tokens, cache_read, reasoning, tool_span_id, tool FROM calls""",
        "tool_tokens": w + CALLS + """
SELECT run_id, tool, count(*) AS llm_calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
  sum(input_tokens + output_tokens)::BIGINT AS total_tokens FROM calls GROUP BY run_id, tool""",
        "run_record_full": w + "," + agent_cte() + f"""
SELECT 'q-' || e.query_id AS run_id,
  CASE WHEN {_list(A.PROVIDERS)}[e.query_id % 5 + 1] IN ({", ".join(q(p) for p in KNOWN_PROVIDERS)}) THEN {_list(A.PROVIDERS)}[e.query_id % 5 + 1] ELSE 'unknown' END AS llm,
  sparksql_query, e.query_id::BIGINT AS query_id, 1 AS iteration, {_list(A.DIFFICULTIES)}[e.query_id % 3 + 1] AS difficulty,
  CASE WHEN sparksql_query IS NULL THEN 'NOT_EXECUTED' WHEN err <> '' THEN 'ERROR' ELSE 'VALID' END AS execution_status,
  nullif(res, '') AS query_result, nullif(err, '') AS spark_error, {_s('run_end - run_start')} AS total_time,
  CASE WHEN sql1.us IS NULL THEN -1.0 ELSE {_s('sql1.us')} END AS spark_time, CASE WHEN sql1.us IS NULL THEN 0.0 ELSE {_s('run_end - run_start - sql1.us')} END AS translation_time,
  coalesce(tools.times, '') AS total_times_per_tool, {_s('coalesce(tools.us, 0)')} AS total_time_tools, {_s('overhead')} AS total_time_tools_excl_spark_llm,
  coalesce(llm.times, '') AS total_times_per_llm_call, {_s('coalesce(llm.us, 0)')} AS total_time_llm_calls,
  {_s('greatest(0, run_end - run_start - busy - overhead)')} AS orchestration_time, coalesce(llm.n, 0)::BIGINT AS llm_requests,
  coalesce(chain.text, '') AS chain_of_thought, coalesce(thoughts, '') AS agent_thoughts,
  coalesce(tin + tout, 0)::BIGINT AS total_tokens, coalesce(tin, 0)::BIGINT AS input_tokens, coalesce(din, '') AS input_token_details,
  coalesce(tout, 0)::BIGINT AS output_tokens, coalesce(dout, '') AS output_token_details,
  CASE WHEN e.query_id % 5 = 1 THEN round(coalesce(tin, 0) / 1e6 * (0.27 / 0.011 * 1000) + coalesce(tout, 0) / 1e6 * (0.85 / 0.011 * 1000), 6) END AS cloudflare_neurons,
  prompt, answer AS final_answer, coalesce(calls, '') AS llm_calls, coalesce(metrics, '') AS tool_metrics
FROM ends e JOIN parts ON parts.query_id = e.query_id LEFT JOIN sql1 ON sql1.query_id = e.query_id LEFT JOIN tools ON tools.query_id = e.query_id
LEFT JOIN llm ON llm.query_id = e.query_id LEFT JOIN chain ON chain.query_id = e.query_id""",
        "interval_union": w + f"""
SELECT run_id, type, {_s('start_us')} AS start, {_s('end_us')} AS "end" FROM ({_union_sql(raw_iv, 'run_id, type')})""",
        "interval_total": w + f"""
SELECT run_id, type, {_s('sum(end_us - start_us)')} AS total FROM ({_union_sql(raw_iv, 'run_id, type')})
GROUP BY run_id, type""",
        "interval_subtract": w + "," + SWEEP.replace(
            "CAST(type = 'llm' AS INTEGER) AS dl, CAST(type = 'spark' AS INTEGER) AS ds",
            "CAST(type IN ('llm', 'spark') AS INTEGER) AS dl, 0 AS ds").replace(
            "-CAST(type = 'llm' AS INTEGER), -CAST(type = 'spark' AS INTEGER)",
            "-CAST(type IN ('llm', 'spark') AS INTEGER), 0") + f""",
pieces AS (SELECT run_id, t AS s, t_next AS e FROM sw WHERE ct > 0 AND cl = 0 AND seg > 0)
SELECT run_id, {_s('start_us')} AS start, {_s('end_us')} AS "end" FROM ({_union_sql('pieces', 'run_id')})""",
        "time_breakdown": w + "," + SWEEP + f""",
parts AS (SELECT run_id,
            sum(CASE WHEN cl > 0 THEN seg ELSE 0 END) AS llm_us,
            sum(CASE WHEN cs > 0 THEN seg ELSE 0 END) AS spark_us,
            sum(CASE WHEN ct > 0 AND cl = 0 AND cs = 0 THEN seg ELSE 0 END) AS tool_us,
            sum(CASE WHEN cl > 0 AND cs > 0 THEN seg ELSE 0 END) AS overlap_us
          FROM sw GROUP BY run_id)
SELECT b.run_id, {_s('b.run_end - b.run_start')} AS total_time, {_s('coalesce(llm_us, 0)')} AS llm_time,
       {_s('coalesce(spark_us, 0)')} AS spark_time, {_s('coalesce(tool_us, 0)')} AS tool_overhead_time,
       {_s('greatest(0, b.run_end - b.run_start - coalesce(llm_us, 0) - coalesce(spark_us, 0) - coalesce(tool_us, 0))')} AS orchestration_time,
       {_s('coalesce(overlap_us, 0)')} AS llm_spark_overlap
FROM bounds b LEFT JOIN parts p ON p.run_id = b.run_id""",
        "tool_metrics": w + f"""
SELECT run_id, name AS tool, count(*) AS call_count, {_s('sum("end" - start)')} AS total_duration
FROM closed WHERE type = 'tool' GROUP BY run_id, name""",
        "tool_metrics_wide": w + """
SELECT run_id, """ + ", ".join(
            f"{_s(f'coalesce(sum(CASE WHEN name = {q(t)} THEN \"end\" - start END), 0)')} AS time_{t}" for t in tools)
        + ", " + _s(" + ".join(f"coalesce(sum(CASE WHEN name = {q(t)} THEN \"end\" - start END), 0)" for t in tools))
        + " AS total_time_tools FROM closed WHERE type = 'tool' GROUP BY run_id",
        "token_totals": w + f"""
SELECT run_id, count(*) AS llm_requests, coalesce(sum(input_tokens), 0) AS input_tokens,
       coalesce(sum(output_tokens), 0) AS output_tokens,
       coalesce(sum(input_tokens), 0) + coalesce(sum(output_tokens), 0) AS total_tokens,
       {_s('coalesce(sum("end" - start), 0)')} AS total_time_llm_calls
FROM spans WHERE type = 'llm' GROUP BY run_id""",
        "loop_guard": w + f"""
SELECT run_id, span_id, {_s('start')} AS start, call_no FROM (
  SELECT *, count(*) OVER (PARTITION BY run_id ORDER BY start, span_id ROWS UNBOUNDED PRECEDING) AS call_no
  FROM spans WHERE type = 'tool' AND name = {q(SCHEMA_TOOL)})
WHERE call_no = {MAX_SCHEMA_CALLS + 1}""",
        "thought_extract": "WITH " + agent_log.strip("\n") + """
SELECT conv_id, turn,
  CASE WHEN contains(log, 'Action:')
       THEN trim(regexp_replace(trim(split_part(log, 'Action:', 1), chr(32)||chr(9)||chr(10)||chr(13)), '^Thought:', ''), chr(32)||chr(9)||chr(10)||chr(13))
       ELSE log END AS thought
FROM agent""",
        "run_id_parse": "WITH " + agent_log.strip("\n") + """,
p AS (SELECT *, CASE WHEN starts_with(message_id, 'lc_run--') THEN substr(message_id, 9) ELSE message_id END AS s
      FROM agent)
SELECT conv_id, turn, message_id,
       CASE WHEN contains(s, '-') THEN regexp_replace(s, '-[^-]*$', '') ELSE s END AS run_id
FROM p""",
        "token_cost": wr + f""",
prices(provider, input_per_m, output_per_m) AS (VALUES {prices})
SELECT r.query_id, r.provider,
       r.input_tokens / 1e6 * p.input_per_m AS input_cost,
       r.output_tokens / 1e6 * p.output_per_m AS output_cost,
       r.input_tokens / 1e6 * p.input_per_m + r.output_tokens / 1e6 * p.output_per_m AS total_cost
FROM runs r LEFT JOIN prices p ON p.provider = r.provider""",
        "run_record": wr + f"""
SELECT query_id, experiment, difficulty,
       CASE WHEN provider IN {tuple(KNOWN_PROVIDERS)} THEN provider ELSE 'unknown' END AS llm,
       CASE WHEN spark_error IS NOT NULL THEN 'ERROR' WHEN sparksql_query IS NOT NULL THEN 'VALID'
            ELSE 'NOT_EXECUTED' END AS execution_status,
       coalesce(total_time, -1.0) AS total_time, coalesce(spark_time, -1.0) AS spark_time,
       total_time - coalesce(spark_time, total_time) AS translation_time,
       coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens,
       coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS total_tokens
FROM runs""",
        "run_trace": w + """
SELECT run_id, count(*) OVER (PARTITION BY run_id ORDER BY start, span_id ROWS UNBOUNDED PRECEDING) AS step_no,
       span_id, type, name FROM spans""",
        "first_query_per_run": w + "," + agent_cte() + f"""
SELECT 'q-' || query_id AS run_id, span_id, {_s('start')} AS start, {_s('"end" - start')} AS duration, input AS query,
  CASE WHEN error IS NULL THEN output END AS result, error FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY start, span_id) AS rn FROM ev WHERE type = 'spark') WHERE rn = 1""",
        "run_status": wr + """
SELECT query_id, CASE WHEN spark_error IS NOT NULL THEN 'ERROR' WHEN sparksql_query IS NOT NULL THEN 'VALID'
                      ELSE 'NOT_EXECUTED' END AS execution_status FROM runs""",
        "experiment_summary": wr + """
SELECT experiment, count(*) AS evaluated_queries, round(avg(score), 6) AS average_accuracy,
       sum(input_tokens) AS total_input_tokens, sum(output_tokens) AS total_ouput_tokens,
       sum(input_tokens + output_tokens) AS total_tokens,
       round(coalesce(sum(input_tokens + output_tokens) / count(*), 0.0), 6) AS avg_tokens_per_query
FROM scored GROUP BY experiment""",
        "log_summary": wr + f"""
SELECT s.query_id, coalesce(l.question, {q(TX.NOT_FOUND)}) AS nl_query,
       coalesce(l.sql, {q(TX.NOT_FOUND)}) AS golden_query,
       coalesce(s.sparksql_query, {q(TX.NO_SQL)}) AS generated_query,
       s.execution_status, s.spark_error, s.query_result,
       coalesce(CAST(s.accuracy AS VARCHAR), {q(TX.NOT_AVAILABLE)}) AS accuracy
FROM scored s LEFT JOIN qlog l ON l.query_id = s.query_id""",
        "accuracy_by_arch": wr + """
SELECT architecture, round(accuracy, 6) AS accuracy, round(accuracy_pct, 6) AS accuracy_pct FROM by_arch""",
        "accuracy_by_difficulty": wr + """,
ord(difficulty_label, difficulty_rank) AS (VALUES """ + ", ".join(
            f"({q(d)}, {i})" for i, d in enumerate(DIFFICULTY_ORDER)) + """)
SELECT s.experiment AS architecture, o.difficulty_label, o.difficulty_rank, round(avg(s.score), 6) AS accuracy
FROM scored s JOIN ord o ON o.difficulty_label = upper(substr(s.difficulty, 1, 1)) || lower(substr(s.difficulty, 2))
GROUP BY s.experiment, o.difficulty_label, o.difficulty_rank""",
        "accuracy_gain": wr + """
SELECT a.architecture, round(a.accuracy_pct, 6) AS accuracy_pct, round(a.accuracy_pct - b.accuracy_pct, 6) AS improvement
FROM by_arch a CROSS JOIN (SELECT accuracy_pct FROM by_arch WHERE architecture = 'baseline') b
WHERE a.architecture <> 'baseline'""",
        "strict_vs_relaxed": wr + """
SELECT experiment, round(avg(score), 6) AS strict_accuracy, round(avg(relaxed_score), 6) AS relaxed_accuracy,
       round(avg(relaxed_score) - avg(score), 6) AS difference
FROM scored GROUP BY experiment""",
        "spec_range": "WITH " + qlog_cte().strip("\n") + f"""
SELECT query_id, question, sql, difficulty FROM qlog WHERE query_id BETWEEN {QUESTION_RANGE[0]} AND {QUESTION_RANGE[1]}""",
    }
