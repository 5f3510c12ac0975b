"""The full run record (T15): all fields of a run out of its mixed event rows, in one grouped pass.

``events`` holds one row per callback span of a run: run_id, type (llm / tool / spark),
span_id, parent_id, name, start and end (microseconds; end null: still open when the run ended), input (prompt, tool
input, SQL), output, error, input_tokens, output_tokens, cache_read, reasoning, tool_calls, and the run's own
query_id, iteration, difficulty, provider, repeated on each row.

A run's spans are gathered once, as one array, and every map, list and time of the record is
read from that array by expressions: no join, and no second pass for the disjoint times.  The record holds a
whole run by definition, so it is for runs of a bounded number of spans, as an agent with a loop
guard makes them; ``calls`` and ``telemetry`` have the same facts in long form for any run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import telemetry as T
from ..functions import texts as TX

SPAN_FIELDS = ("start", "span_id", "type", "name", "end", "parent_id", "input", "output", "error", "input_tokens", "output_tokens", "cache_read",
               "reasoning", "tool_calls")
RUN_FIELDS = ("query_id", "iteration", "difficulty", "provider")
FIELDS = (
    "llm", "sparksql_query", "query_id", "iteration", "difficulty", "execution_status", "query_result", "spark_error", "total_time", "spark_time",
    "translation_time", "total_times_per_tool", "total_time_tools", "total_time_tools_excl_spark_llm", "total_times_per_llm_call",
    "total_time_llm_calls", "orchestration_time", "llm_requests", "chain_of_thought", "agent_thoughts", "total_tokens", "input_tokens",
    "input_token_details", "output_tokens", "output_token_details", "cloudflare_neurons", "prompt", "final_answer", "llm_calls", "tool_metrics")


def covered(spans: Column) -> Column:
    """Microseconds that an array of spans covers: sorted by start, each adds what lies after the greatest end so far."""
    start = F.struct(F.lit(None).cast("long").alias("end"), F.lit(0).cast("long").alias("us"))

    def step(a, s):
        reached = F.greatest(a["end"], s["start"])  # null counts for nothing
        return F.struct(F.greatest(a["end"], s["end"]).alias("end"), (a["us"] + F.greatest(F.lit(0).cast("long"), s["end"] - reached)).alias("us"))

    return F.aggregate(spans, start, step, lambda a: a["us"])


def _seconds(us: Column) -> Column:
    return us / F.lit(T.US)


def _of(kind: str) -> Column:
    return F.filter("spans", lambda s: s["type"] == kind)


def _sum(spans: Column, value, zero: Column | None = None) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long") if zero is None else zero, lambda a, s: a + F.coalesce(value(s), F.lit(0).cast("long")))


def _took(s: Column) -> Column:
    return s["end"] - s["start"]


def _per_id(spans: Column, value) -> Column:
    """A map from span id to a value; of spans with one id the first counts."""
    once = F.filter(spans, lambda s, k: F.array_position(F.transform(spans, lambda x: x["span_id"]), s["span_id"]) == k + 1)
    return F.map_from_entries(F.transform(once, lambda s: F.struct(s["span_id"].cast("string"), value(s))))


def _details(s: Column, name: str, field: str) -> Column:
    return F.map_filter(F.create_map(F.lit(name), s[field].cast("long")), lambda k, v: v.isNotNull())


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _messages() -> Column:
    """The chain of thought: what was called, executed and observed, in order of time."""
    def of(s):
        line = lambda t, no, text: F.struct(t.alias("t"), F.lit(no).alias("no"), s["span_id"].alias("id"), text.alias("text"))
        called = line(s["start"], 0, F.concat(F.lit("Action: "), s["name"], F.lit("\nAction Input: "), F.coalesce(s["input"], F.lit(""))))
        seen = line(s["end"], 1, F.concat(F.lit("Observation: "), F.coalesce(s["output"], F.lit(""))))
        executed = line(s["start"], 0, F.concat(F.lit("Spark Query Executed: "), F.coalesce(s["input"], F.lit(""))))
        return F.when(s["type"] == "tool", F.array(called, seen)).when(s["type"] == "spark", F.array(executed)).otherwise(F.array_except(F.array(called), F.array(called)))

    return F.transform(F.array_sort(F.flatten(F.transform("spans", of))), lambda m: m["text"])


def run_records(events: DataFrame, neuron_prices: tuple[float, float] | None = None) -> DataFrame:
    """One row per run with the 30 ``FIELDS`` (times in seconds) and run_id.

    A tool span that is still open ends with the run, its output being the reason.  A
    run's first executed statement is its query.  Missing times are -1, missing counts 0, missing texts and the query null,
    missing maps and lists empty; without a time of its own execution counts as the whole run, so that
    translation takes 0.  ``neuron_prices``: price per million input and output tokens of the provider
    that bills by neurons; null for every other provider.  Empty table: no rows.
    """
    span = F.struct(*[F.col(c) for c in SPAN_FIELDS])
    runs = events.groupBy("run_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("start").isNotNull() & F.col("span_id").isNotNull(), span))).alias("spans"),
        F.min("start").alias("run_start"), F.max(F.coalesce("end", "start")).alias("run_end"), *[F.max(c).alias(c) for c in RUN_FIELDS])

    def closed(s):
        reason = F.when(s["name"] == T.SCHEMA_TOOL, F.lit(TX.EARLY_EXIT_SCHEMA)).otherwise(F.lit(TX.EARLY_EXIT_OTHER))
        still = s["end"].isNull() & (s["type"] == "tool")
        s = s.withField("name", F.coalesce(s["name"], F.lit("unknown")))
        return s.withField("output", F.when(still, reason).otherwise(s["output"])).withField("end", F.when(still, F.col("run_end")).otherwise(s["end"]))

    runs = runs.withColumn("spans", F.transform("spans", closed))
    whole = F.filter("spans", lambda s: s["end"] >= s["start"])
    runs = runs.withColumns({
        "llm_spans": _of("llm"), "tool_spans": _of("tool"), "first_query": F.get(_of("spark"), F.lit(0)),
        "all_us": covered(whole), "llm_spark_us": covered(F.filter(whole, lambda s: s["type"] != "tool")),
        "llm_us": covered(F.filter(whole, lambda s: s["type"] == "llm")), "spark_us": covered(F.filter(whole, lambda s: s["type"] == "spark"))})
    tools = F.array_distinct(F.transform("tool_spans", lambda s: s["name"]))
    calls_of = lambda t: F.filter("tool_spans", lambda s: s["name"] == t)
    total, query_us = F.col("run_end") - F.col("run_start"), _took(F.col("first_query"))
    runs = runs.withColumns({
        "tools": tools, "n_in": _sum(F.col("llm_spans"), lambda s: s["input_tokens"]), "n_out": _sum(F.col("llm_spans"), lambda s: s["output_tokens"]),
        "overhead_us": F.col("all_us") - F.col("llm_spark_us"), "total_us": total})
    last = F.try_element_at(F.filter("llm_spans", lambda s: s["input"].isNotNull()), F.lit(-1))
    answer = F.try_element_at(F.array_sort(F.filter("llm_spans", lambda s: s["output"].isNotNull() & s["end"].isNotNull()), lambda a, b: F.when(a["end"] < b["end"], -1)
                                       .when(a["end"] > b["end"], 1).otherwise(0)), F.lit(-1))
    per_m = [T.neurons_per_m(F.lit(p)) for p in neuron_prices or (0.0, 0.0)]
    neurons = F.col("n_in") / F.lit(1e6) * per_m[0] + F.col("n_out") / F.lit(1e6) * per_m[1]

    def call(s):
        return F.struct(
            s["input"].alias("prompt"), _seconds(_took(s)).alias("duration"), s["span_id"].alias("run_id"), s["parent_id"].alias("parent_run_id"),
            (F.coalesce(s["input_tokens"], F.lit(0)) + F.coalesce(s["output_tokens"], F.lit(0))).alias("total_tokens"),
            F.coalesce(s["input_tokens"], F.lit(0)).alias("input_tokens"), _details(s, "cache_read", "cache_read").alias("input_token_details"),
            F.coalesce(s["output_tokens"], F.lit(0)).alias("output_tokens"), _details(s, "reasoning", "reasoning").alias("output_token_details"),
            s["tool_calls"].alias("tool_calls"), s["output"].alias("thought"))

    def tool_call(s):
        return F.struct(_seconds(_took(s)).alias("duration"), s["input"].alias("input"), s["output"].alias("output"), s["parent_id"].alias("parent_run_id"))

    none = F.lit(-1.0)
    record = {
        "llm": T.provider_label(F.coalesce("provider", F.lit("unknown"))), "sparksql_query": F.col("first_query.input"), "query_id": F.col("query_id"),
        "iteration": F.col("iteration"), "difficulty": F.col("difficulty"),
        "execution_status": T.execution_status(F.col("first_query.error"), F.col("first_query.input")),
        "query_result": F.when(F.col("first_query.error").isNull(), F.col("first_query.output")), "spark_error": F.col("first_query.error"),
        "total_time": F.coalesce(_seconds(F.col("total_us")), none), "spark_time": F.coalesce(_seconds(query_us), none),
        "translation_time": F.coalesce(_seconds(F.col("total_us") - F.coalesce(query_us, F.col("total_us"))), none),
        "total_times_per_tool": F.map_from_arrays("tools", F.transform("tools", lambda t: _seconds(_sum(calls_of(t), _took)))),
        "total_time_tools": _seconds(_sum(F.col("tool_spans"), _took)), "total_time_tools_excl_spark_llm": _seconds(F.col("overhead_us")),
        "total_times_per_llm_call": _per_id(F.col("llm_spans"), lambda s: _seconds(_took(s))),
        "total_time_llm_calls": _seconds(_sum(F.col("llm_spans"), _took)),
        "orchestration_time": F.coalesce(_seconds(F.greatest(F.lit(0), F.col("total_us") - F.col("llm_us") - F.col("spark_us") - F.col("overhead_us"))), none),
        "llm_requests": F.size("llm_spans"), "chain_of_thought": _messages(),
        "agent_thoughts": F.filter(F.transform("llm_spans", lambda s: _stripped(s["output"])), lambda t: t != ""),
        "total_tokens": F.col("n_in") + F.col("n_out"), "input_tokens": F.col("n_in"),
        "input_token_details": _per_id(F.col("llm_spans"), lambda s: _details(s, "cache_read", "cache_read")), "output_tokens": F.col("n_out"),
        "output_token_details": _per_id(F.col("llm_spans"), lambda s: _details(s, "reasoning", "reasoning")),
        "cloudflare_neurons": F.when((F.col("provider") == "cloudflare") & F.lit(neuron_prices is not None), neurons),
        "prompt": last["input"], "final_answer": answer["output"],
        "llm_calls": _per_id(F.col("llm_spans"), call),
        "tool_metrics": F.map_from_arrays("tools", F.transform("tools", lambda t: F.struct(
            F.size(calls_of(t)).alias("call_count"), _seconds(_sum(calls_of(t), _took)).alias("total_duration"), _per_id(calls_of(t), tool_call).alias("calls")))),
    }
    return runs.select("run_id", *[record[f].alias(f) for f in FIELDS])
