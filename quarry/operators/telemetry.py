"""Run telemetry (T1, T2, T7-T17) and run status (X4, X6) on span / run DataFrames.

Spans: run_id, span_id, type (llm / tool / spark), name, start, end (us).
Runs:  one run record per question (see ``sources.adapters.runs``).
Every per-run rollup is algebraic (count / sum / min), so a run holding a
third of all spans is combined map-side; ordered per-run scans use the
two-level scan of ``intervals.running``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from ..functions import texts as TX

from . import intervals as I

# The reasons written when a tool span is still open at the end
# of a run, the schema tool and its call limit, the provider labels.
SCHEMA_TOOL = "schema_sql_db"
MAX_SCHEMA_CALLS = 3
KNOWN_PROVIDERS = ["google", "cloudflare", "claude", "openai"]
US = 1_000_000.0


def seconds(c: Column) -> Column:
    return c / F.lit(US)


def span_events(spans: DataFrame) -> DataFrame:
    """Callback-style event log of spans: one start row, one end row when the span ended.

    Where the spans have them, the parent and what is known at the start (length of the prompt) come with the start row,
    what is known at the end (tokens) with the end row, as ``meta``.
    """
    text = lambda c: F.col(c).cast("string") if c in spans.columns else F.lit(None).cast("string")
    known = lambda **c: F.map_filter(F.map_from_arrays(F.array(*map(F.lit, c)), F.array(*c.values())), lambda k, v: v.isNotNull())
    parent = F.col("parent_id") if "parent_id" in spans.columns else F.lit(None).cast("long")
    cols = ["run_id", "span_id", "type", "name"]
    st = spans.select(*cols, parent.alias("parent_id"), F.lit("start").alias("kind"), F.col("start").alias("t"),
                      known(prompt_len=F.length(text("prompt")).cast("string")).alias("meta"))
    en = spans.where(F.col("end").isNotNull()).select(
        *cols, parent.alias("parent_id"), F.lit("end").alias("kind"), F.col("end").alias("t"),
        known(input_tokens=text("input_tokens"), output_tokens=text("output_tokens")).alias("meta"))
    return st.unionByName(en)


def pair_spans(events: DataFrame) -> DataFrame:
    """Pair start and end events by span id; duration = end - start; meta of both, that of the end counts where a name is in both."""
    of = lambda kind, c: F.max_by(c, F.col("kind") == kind)
    paired = events.groupBy("span_id").agg(
        F.first("run_id").alias("run_id"), F.first("type").alias("type"),
        F.first("name").alias("name"), F.max("parent_id").alias("parent_id"),
        F.max(F.when(F.col("kind") == "start", F.col("t"))).alias("start"),
        F.max(F.when(F.col("kind") == "end", F.col("t"))).alias("end"),
        of("start", "meta").alias("_first"), of("end", "meta").alias("_last"),
    )
    only_first = F.map_filter("_first", lambda k, v: ~F.map_contains_key("_last", k))
    return paired.withColumns({"duration": F.col("end") - F.col("start"), "meta": F.map_concat(only_first, "_last")}).drop("_first", "_last")


def close_open_spans(spans: DataFrame, bounds: DataFrame) -> DataFrame:
    """Spans that never ended are closed at the run end, with a reason."""
    reason = (F.when(F.col("end").isNotNull(), F.lit(None).cast("string"))
              .when(F.col("name") == SCHEMA_TOOL, F.lit(TX.EARLY_EXIT_SCHEMA))
              .otherwise(F.lit(TX.EARLY_EXIT_OTHER)))
    return (spans.join(bounds.select("run_id", "run_end"), "run_id", "left")
            .withColumns({"closed_reason": reason,
                          "end": F.coalesce(F.col("end"), F.col("run_end"))})
            .drop("run_end"))


def tool_metrics(closed: DataFrame) -> DataFrame:
    """Per run and tool, number of calls and total duration."""
    return (closed.where(F.col("type") == "tool")
            .groupBy("run_id", F.col("name").alias("tool"))
            .agg(F.count(F.lit(1)).alias("call_count"),
                 F.sum(F.col("end") - F.col("start")).alias("total_duration_us")))


def tool_metrics_wide(closed: DataFrame, tools: list[str]) -> DataFrame:
    """One duration column per tool (pivot values given, so no extra pass) and the total."""
    t = closed.where(F.col("type") == "tool").withColumn("d", F.col("end") - F.col("start"))
    wide = t.groupBy("run_id").pivot("name", tools).agg(F.sum("d"))
    wide = wide.fillna(0, tools)
    total = sum((F.col(c) for c in tools), F.lit(0))
    return wide.select("run_id", *[F.col(c).alias(f"time_{c}") for c in tools],
                       total.alias("total_time_tools"))


def token_totals(spans: DataFrame) -> DataFrame:
    """Model calls, token sums and summed call duration per run (missing = 0)."""
    llm = spans.where(F.col("type") == "llm")
    return llm.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("llm_requests"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("total_time_llm_calls_us"),
    ).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def loop_guard(spans: DataFrame, tool: str = SCHEMA_TOOL, limit: int = MAX_SCHEMA_CALLS,
               bucket_us: int | None = I.DEFAULT_BUCKET_US) -> DataFrame:
    """The call of ``tool`` that passes ``limit`` calls in a run (the stop point)."""
    t = (spans.where((F.col("type") == "tool") & (F.col("name") == tool))
         .select("run_id", "span_id", "start", F.lit(1).alias("one")))
    t = I.bucketed(t, ["run_id"], "start", bucket_us)
    t = I.running(t, ["run_id"], ["start", "span_id"], {"call_no": "one"}, how="sum")
    return t.where(F.col("call_no") == limit + 1).select("run_id", "span_id", "start", "call_no")


def thought_text(log: Column) -> Column:
    """Text before "Action:", without a "Thought:" prefix, trimmed; else the log as is."""
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    head = bare(F.split(log, "Action:", 2).getItem(0))
    return F.when(log.contains("Action:"), bare(F.regexp_replace(head, r"^Thought:", ""))).otherwise(log)


def parse_run_id(message_id: Column) -> Column:
    """Drop a leading ``lc_run--`` and the last ``-`` part."""
    s = F.when(message_id.startswith("lc_run--"), F.substr(message_id, F.lit(9))).otherwise(message_id)
    return F.when(s.contains("-"), F.regexp_replace(s, r"-[^-]*$", "")).otherwise(s)


def token_cost(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens / 1e6 x price per million, for input and output.

    ``prices`` (provider, input_per_m, output_per_m) is a fixed, small dimension
    and is broadcast.
    """
    p = F.broadcast(prices)
    return (runs.join(p, "provider", "left")
            .select("query_id", "provider",
                    (F.col("input_tokens") / F.lit(1e6) * F.col("input_per_m")).alias("input_cost"),
                    (F.col("output_tokens") / F.lit(1e6) * F.col("output_per_m")).alias("output_cost"))
            .withColumn("total_cost", F.col("input_cost") + F.col("output_cost")))


def neurons_per_m(price_per_m: Column) -> Column:
    """Price per million tokens to neurons per million (1000 neurons cost 0.011)."""
    return price_per_m / F.lit(0.011) * F.lit(1000)


def execution_status(error: Column, query: Column) -> Column:
    """ERROR if an error, VALID if a query ran, else NOT_EXECUTED."""
    return (F.when(error.isNotNull(), F.lit("ERROR"))
            .when(query.isNotNull(), F.lit("VALID")).otherwise(F.lit("NOT_EXECUTED")))


def provider_label(p: Column) -> Column:
    """Known provider, else ``unknown``."""
    return F.when(p.isin(*KNOWN_PROVIDERS), p).otherwise(F.lit("unknown"))


def run_record(runs: DataFrame) -> DataFrame:
    """T14-T16 + X6: the flat run record with the reference's defaults."""
    return runs.select(
        "query_id", "experiment", "difficulty",
        provider_label(F.col("provider")).alias("llm"),
        execution_status(F.col("spark_error"), F.col("sparksql_query")).alias("execution_status"),
        F.coalesce(F.col("total_time"), F.lit(-1.0)).alias("total_time"),
        F.coalesce(F.col("spark_time"), F.lit(-1.0)).alias("spark_time"),
        (F.col("total_time") - F.coalesce(F.col("spark_time"), F.col("total_time"))).alias("translation_time"),
        F.coalesce(F.col("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.col("output_tokens"), F.lit(0)).alias("output_tokens"),
        (F.coalesce(F.col("input_tokens"), F.lit(0)) + F.coalesce(F.col("output_tokens"), F.lit(0)))
        .alias("total_tokens"),
    )


def first_query_per_run(spans: DataFrame) -> DataFrame:
    """The first executed statement (spark span) of each run, as an algebraic min: its text, result, error and time.

    Spans without ``input``, ``output`` or ``error`` give nulls.  A statement that failed has no result.
    """
    of = lambda c: (F.col(c) if c in spans.columns else F.lit(None).cast("string")).alias(c)
    first = F.min(F.struct("start", "span_id", "end", of("input"), of("output"), of("error")))
    return (spans.where((F.col("type") == "spark") & F.col("start").isNotNull()).groupBy("run_id").agg(first.alias("f"))
            .select("run_id", F.col("f.span_id").alias("span_id"), F.col("f.start").alias("start"), (F.col("f.end") - F.col("f.start")).alias("duration"),
                    F.col("f.input").alias("query"), F.when(F.col("f.error").isNull(), F.col("f.output")).alias("result"), F.col("f.error").alias("error")))


def run_trace(spans: DataFrame, bucket_us: int | None = I.DEFAULT_BUCKET_US) -> DataFrame:
    """Ordered trace of steps per run, long form (run_id, step_no, type, name).

    Kept long instead of one string per run: a run is unbounded in steps.
    """
    t = spans.select("run_id", "span_id", "type", "name", "start", F.lit(1).alias("one"))
    t = I.bucketed(t, ["run_id"], "start", bucket_us)
    t = I.running(t, ["run_id"], ["start", "span_id"], {"step_no": "one"}, how="sum")
    return t.select("run_id", "step_no", "span_id", "type", "name")
