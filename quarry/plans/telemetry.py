"""Named queries over run telemetry (T, X4, X6) and experiment reports (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls as C
from ..operators import intervals as I
from ..operators import records as RR
from ..operators import reports as R
from ..operators import telemetry as T
from ..sources import adapters as A
from ..sources.tables import table

# Price per million tokens (input, output) by provider.
PRICES = [("google", 0.30, 2.50), ("cloudflare", 0.27, 0.85), ("claude", 3.00, 15.00),
          ("openai", 2.50, 10.00)]


def _s(c):
    """Microseconds to seconds, rounded to 6 places (same in the oracle)."""
    return F.round(c / F.lit(1e6), 6)


def _closed(spark, sf_dir):
    return T.close_open_spans(A.spans(spark, sf_dir), A.run_bounds(spark, sf_dir))


def q_span_pairing(spark, sf_dir):
    p = T.pair_spans(T.span_events(A.spans(spark, sf_dir)))
    return p.select("span_id", "run_id", "type", "name", _s(F.col("start")).alias("start"),
                    _s(F.col("end")).alias("end"), _s(F.col("duration")).alias("duration"))


def q_span_meta(spark, sf_dir):
    p = T.pair_spans(T.span_events(A.spans(spark, sf_dir)))
    items = F.transform(F.array_sort(F.map_entries("meta")), lambda m: F.concat(m["key"], F.lit("="), m["value"]))
    return p.select("span_id", "parent_id", F.array_join(items, ",").alias("meta"))


def q_span_tree(spark, sf_dir):
    spans = A.spans(spark, sf_dir)
    tree = C.span_tree(spans, ["run_id"], ["input_tokens", "output_tokens"])
    own = C.self_times(spans, ["run_id"])
    return tree.join(own, ["run_id", "span_id"]).select(
        "run_id", "span_id", "parent_id", "root", "depth", "n_below", "input_tokens_below", "output_tokens_below",
        _s(F.col("duration")).alias("duration"), _s(F.col("self_time")).alias("self_time"))


def q_llm_calls(spark, sf_dir):
    c = C.llm_calls(A.spans(spark, sf_dir))
    return c.select("run_id", "span_id", "parent_id", "prompt", _s(F.col("duration")).alias("duration"), "input_tokens", "output_tokens",
                    "total_tokens", "cache_read", "reasoning", "tool_span_id", "tool")


def q_tool_tokens(spark, sf_dir):
    return C.tool_tokens(C.llm_calls(A.spans(spark, sf_dir)))


def q_span_close_open(spark, sf_dir):
    c = _closed(spark, sf_dir)
    return c.select("span_id", "run_id", "name", _s(F.col("end")).alias("end"), "closed_reason")


def q_interval_union(spark, sf_dir):
    u = I.union(A.spans(spark, sf_dir), ["run_id", "type"])
    return u.select("run_id", "type", _s(F.col("start")).alias("start"), _s(F.col("end")).alias("end"))


def q_interval_total(spark, sf_dir):
    u = I.union(A.spans(spark, sf_dir), ["run_id", "type"])
    return I.total(u, ["run_id", "type"]).select("run_id", "type", _s(F.col("total")).alias("total"))


def q_interval_subtract(spark, sf_dir):
    d = I.subtract_sides(A.spans(spark, sf_dir), ["run_id"], F.col("type") == "tool", F.col("type").isin("llm", "spark"), open_ends=True)
    return d.select("run_id", _s(F.col("start")).alias("start"), _s(F.col("end")).alias("end"))


def q_time_breakdown(spark, sf_dir):
    b = I.breakdown(A.spans(spark, sf_dir), None, ["run_id"])
    return b.select("run_id", _s(F.col("total_us")).alias("total_time"),
                    _s(F.col("llm_us")).alias("llm_time"), _s(F.col("spark_us")).alias("spark_time"),
                    _s(F.col("tool_overhead_us")).alias("tool_overhead_time"),
                    _s(F.col("orchestration_us")).alias("orchestration_time"),
                    _s(F.col("llm_spark_overlap_us")).alias("llm_spark_overlap"))


def q_tool_metrics(spark, sf_dir):
    m = T.tool_metrics(_closed(spark, sf_dir))
    return m.select("run_id", "tool", "call_count", _s(F.col("total_duration_us")).alias("total_duration"))


def q_tool_metrics_wide(spark, sf_dir):
    w = T.tool_metrics_wide(_closed(spark, sf_dir), A.TOOL_NAMES)
    return w.select("run_id", *[_s(F.col(c)).alias(c) for c in w.columns if c != "run_id"])


def q_token_totals(spark, sf_dir):
    t = T.token_totals(A.spans(spark, sf_dir))
    return t.select("run_id", "llm_requests", "input_tokens", "output_tokens", "total_tokens",
                    _s(F.col("total_time_llm_calls_us")).alias("total_time_llm_calls"))


def q_loop_guard(spark, sf_dir):
    g = T.loop_guard(A.spans(spark, sf_dir))
    return g.select("run_id", "span_id", _s(F.col("start")).alias("start"), "call_no")


def _agent_log(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    log = F.when(F.col("role") == "assistant",
                 F.concat(F.lit("Thought: "), F.col("text"), F.lit("\nAction: query_sql_db"))
                 ).otherwise(F.col("text"))
    msg = F.when(F.col("role") == "assistant",
                 F.concat(F.lit("lc_run--"), F.col("conv_id").cast("string"), F.lit("-"),
                          F.col("turn").cast("string"), F.lit("-0"))
                 ).otherwise(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")))
    return c.select("conv_id", "turn", "role", log.alias("log"), msg.alias("message_id"))


def q_thought_extract(spark, sf_dir):
    a = _agent_log(spark, sf_dir)
    return a.select("conv_id", "turn", T.thought_text(F.col("log")).alias("thought"))


def q_run_id_parse(spark, sf_dir):
    a = _agent_log(spark, sf_dir)
    return a.select("conv_id", "turn", "message_id", T.parse_run_id(F.col("message_id")).alias("run_id"))


def q_token_cost(spark, sf_dir):
    prices = spark.createDataFrame(PRICES, "provider string, input_per_m double, output_per_m double")
    c = T.token_cost(A.runs(spark, sf_dir), prices)
    return c.select("query_id", "provider", "input_cost", "output_cost", "total_cost")


def q_run_record(spark, sf_dir):
    return T.run_record(A.runs(spark, sf_dir))


def q_run_record_full(spark, sf_dir):
    """All 30 fields; maps and lists as text, their entries in order of key or time, times in them in microseconds."""
    prices = next((a, b) for p, a, b in PRICES if p == "cloudflare")
    r = RR.run_records(A.agent_events(spark, sf_dir), prices)
    us = lambda c: F.coalesce(F.round(c * T.US).cast("long").cast("string"), F.lit(""))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def entries(c, value):
        shown = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("k"), value(e["value"]).alias("v"))))
        return F.array_join(F.transform(shown, lambda e: F.concat(e["k"], F.lit("="), e["v"])), ",")

    def call(v):
        tools = F.array_join(F.transform(F.coalesce(v["tool_calls"], F.array()), lambda t: F.concat_ws("/", t["name"], t["args"], t["id"], t["type"])), "+")
        parts = [text(v[c]) for c in ("prompt", "run_id", "parent_run_id", "total_tokens", "input_tokens", "output_tokens")]
        details = [text(v["input_token_details"]["cache_read"]), text(v["output_token_details"]["reasoning"])]
        return F.concat_ws(":", *parts, *details, us(v["duration"]), tools, text(v["thought"]))

    def tool(v):
        calls = entries(v["calls"], lambda c: F.concat_ws(":", us(c["duration"]), text(c["input"]), text(c["output"]), text(c["parent_run_id"])))
        return F.concat(text(v["call_count"]), F.lit(":"), us(v["total_duration"]), F.lit("("), calls, F.lit(")"))

    shown = {c: F.round(c, 6) for c in ("total_time", "spark_time", "translation_time", "total_time_tools", "total_time_tools_excl_spark_llm",
                                       "total_time_llm_calls", "orchestration_time", "cloudflare_neurons")}
    shown |= {c: entries(F.col(c), us) for c in ("total_times_per_tool", "total_times_per_llm_call")}
    shown |= {c: F.array_join(c, "|") for c in ("chain_of_thought", "agent_thoughts")}
    shown |= {"input_token_details": entries(F.col("input_token_details"), lambda v: text(v["cache_read"])),
              "output_token_details": entries(F.col("output_token_details"), lambda v: text(v["reasoning"])),
              "llm_calls": entries(F.col("llm_calls"), call), "tool_metrics": entries(F.col("tool_metrics"), tool),
              "llm_requests": F.col("llm_requests").cast("long")}
    return r.select("run_id", *[(shown[f].alias(f) if f in shown else F.col(f)) for f in RR.FIELDS])


def q_run_trace(spark, sf_dir):
    return T.run_trace(A.spans(spark, sf_dir))


def q_first_query_per_run(spark, sf_dir):
    f = T.first_query_per_run(A.agent_events(spark, sf_dir))
    return f.select("run_id", "span_id", _s(F.col("start")).alias("start"),
                    _s(F.col("duration")).alias("duration"), "query", "result", "error")


def q_run_status(spark, sf_dir):
    r = A.runs(spark, sf_dir)
    return r.select("query_id", T.execution_status(F.col("spark_error"), F.col("sparksql_query"))
                    .alias("execution_status"))


def q_experiment_summary(spark, sf_dir):
    s = R.experiment_summary(A.runs(spark, sf_dir))
    return s.select("experiment", "evaluated_queries", F.round("average_accuracy", 6).alias("average_accuracy"),
                    "total_input_tokens", "total_ouput_tokens", "total_tokens",
                    F.round("avg_tokens_per_query", 6).alias("avg_tokens_per_query"))


def q_log_summary(spark, sf_dir):
    return R.log_summary(A.runs(spark, sf_dir), A.qlog(spark, sf_dir))


def q_accuracy_by_arch(spark, sf_dir):
    a = R.accuracy_by_arch(A.runs(spark, sf_dir))
    return a.select("architecture", F.round("accuracy", 6).alias("accuracy"),
                    F.round("accuracy_pct", 6).alias("accuracy_pct"))


def q_accuracy_by_difficulty(spark, sf_dir):
    a = R.accuracy_by_difficulty(A.runs(spark, sf_dir))
    return a.select("architecture", "difficulty_label", "difficulty_rank",
                    F.round("accuracy", 6).alias("accuracy"))


def q_accuracy_gain(spark, sf_dir):
    a = R.accuracy_gain(A.runs(spark, sf_dir))
    return a.select("architecture", F.round("accuracy_pct", 6).alias("accuracy_pct"),
                    F.round("improvement", 6).alias("improvement"))


def q_strict_vs_relaxed(spark, sf_dir):
    a = R.strict_vs_relaxed(A.runs(spark, sf_dir))
    return a.select("experiment", F.round("strict_accuracy", 6).alias("strict_accuracy"),
                    F.round("relaxed_accuracy", 6).alias("relaxed_accuracy"),
                    F.round("difference", 6).alias("difference"))


def q_spec_range(spark, sf_dir):
    return R.question_range(A.qlog(spark, sf_dir)).select("query_id", "question", "sql", "difficulty")


QUERIES = {
    "span_pairing": q_span_pairing,
    "span_close_open": q_span_close_open,
    "span_meta": q_span_meta,
    "span_tree": q_span_tree,
    "llm_calls": q_llm_calls,
    "tool_tokens": q_tool_tokens,
    "interval_union": q_interval_union,
    "interval_total": q_interval_total,
    "interval_subtract": q_interval_subtract,
    "time_breakdown": q_time_breakdown,
    "tool_metrics": q_tool_metrics,
    "tool_metrics_wide": q_tool_metrics_wide,
    "token_totals": q_token_totals,
    "loop_guard": q_loop_guard,
    "thought_extract": q_thought_extract,
    "run_id_parse": q_run_id_parse,
    "token_cost": q_token_cost,
    "run_record": q_run_record,
    "run_record_full": q_run_record_full,
    "run_trace": q_run_trace,
    "first_query_per_run": q_first_query_per_run,
    "run_status": q_run_status,
    "experiment_summary": q_experiment_summary,
    "log_summary": q_log_summary,
    "accuracy_by_arch": q_accuracy_by_arch,
    "accuracy_by_difficulty": q_accuracy_by_difficulty,
    "accuracy_gain": q_accuracy_gain,
    "strict_vs_relaxed": q_strict_vs_relaxed,
    "spec_range": q_spec_range,
}
