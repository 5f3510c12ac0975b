"""The full run record on literal runs: every field, its default, ties and repeated ids."""

from quarry.functions import texts as TX
from quarry.operators import records as RR

COLS = ("run_id string, type string, span_id string, parent_id string, name string, start long, end long, input string, output string, error string, "
        "input_tokens long, output_tokens long, cache_read long, reasoning long, tool_calls array<struct<name:string,args:string,id:string,type:string>>, "
        "query_id long, iteration int, difficulty string, provider string")
S = 1_000_000


def event(run, kind, i, name, start, end, given=None, out=None, error=None, tokens=(None, None), details=(None, None), calls=None, parent=None, provider="google"):
    return (run, kind, i, parent, name, start, end, given, out, error, *tokens, *details, calls, 7, 2, "simple", provider)


def record(spark, rows, prices=None):
    return {r.run_id: r for r in RR.run_records(spark.createDataFrame(rows, COLS), prices).collect()}


def test_all_fields_of_a_run(spark):
    rows = [
        event("r", "llm", "m1", "llm_call", 1 * S, 5 * S, "ask", " think\n", tokens=(10, 4), details=(3, None), calls=[("list", "a=1", "c1", "tool_call")], parent="p"),
        event("r", "llm", "m2", "llm_call", 4 * S, 8 * S, "ask more", " \n", tokens=(5, None), details=(None, 2)),
        event("r", "tool", "t1", "list", 6 * S, 14 * S, "in", "two tables"),
        event("r", "tool", "t2", "schema_sql_db", 13 * S, None, "x"),
        event("r", "spark", "s1", "spark_run", 9 * S, 12 * S, "SELECT 1", "[[1]]"),
        event("r", "spark", "s2", "spark_run", 19 * S, 20 * S, "SELECT 2", None, "late"),
        event("r", "run", "b", None, 0, 0),
    ]
    r = record(spark, rows)["r"]
    assert (r.llm, r.sparksql_query, r.query_id, r.iteration, r.difficulty) == ("google", "SELECT 1", 7, 2, "simple")
    assert (r.execution_status, r.query_result, r.spark_error) == ("VALID", "[[1]]", None)
    assert (r.total_time, r.spark_time, r.translation_time) == (20, 3, 17)
    assert r.total_times_per_tool == {"list": 8, "schema_sql_db": 7} and r.total_time_tools == 15
    assert r.total_times_per_llm_call == {"m1": 4, "m2": 4} and r.total_time_llm_calls == 8
    assert (r.total_time_tools_excl_spark_llm, r.orchestration_time) == (8, 1)  # tools 8-9 and 12-19; nothing ran from 0 to 1
    assert (r.llm_requests, r.total_tokens, r.input_tokens, r.output_tokens) == (2, 19, 15, 4)
    assert r.input_token_details == {"m1": {"cache_read": 3}, "m2": {}} and r.output_token_details == {"m1": {}, "m2": {"reasoning": 2}}
    assert r.chain_of_thought == ["Action: list\nAction Input: in", "Spark Query Executed: SELECT 1", "Action: schema_sql_db\nAction Input: x",
                                  "Observation: two tables", "Spark Query Executed: SELECT 2", "Observation: " + TX.EARLY_EXIT_SCHEMA]
    assert r.agent_thoughts == ["think"] and (r.prompt, r.final_answer) == ("ask more", " \n") and r.cloudflare_neurons is None
    call = r.llm_calls["m1"]
    assert (call.prompt, call.duration, call.parent_run_id, call.total_tokens, call.tool_calls[0].name, call.thought) == ("ask", 4, "p", 14, "list", " think\n")
    tool = r.tool_metrics["schema_sql_db"]
    assert (tool.call_count, tool.total_duration, tool.calls["t2"].output) == (1, 7, TX.EARLY_EXIT_SCHEMA)
    assert set(r.asDict()) == {"run_id", *RR.FIELDS} and len(RR.FIELDS) == 30


def test_defaults_and_odd_rows(spark):
    rows = [event("none", "tool", "t", None, 5, None, provider=None), event("failed", "spark", "s", "spark_run", 0, S, "SELECT x", None, "no column", provider="cloudflare"),
            event("lost", "llm", None, "llm_call", 3, 4), event("lost", "llm", "m", "llm_call", None, 4),
            event("twice", "llm", "m", "llm_call", 0, S, "a", "one", tokens=(1_000_000, 0), provider="cloudflare"),
            event("twice", "llm", "m", "llm_call", 0, S, "a", "one", tokens=(1_000_000, 0), provider="cloudflare")]
    got = record(spark, rows, (0.011, 0.022))
    r = got["none"]
    assert (r.llm, r.execution_status, r.spark_time, r.total_time, r.translation_time, r.llm_requests, r.prompt) == ("unknown", "NOT_EXECUTED", -1, 0, 0, 0, None)
    assert (r.tool_metrics["unknown"].call_count, r.chain_of_thought[1], r.llm_calls, r.agent_thoughts) == (1, "Observation: " + TX.EARLY_EXIT_OTHER, {}, [])
    r = got["failed"]
    assert (r.execution_status, r.spark_error, r.query_result, r.cloudflare_neurons) == ("ERROR", "no column", None, 0)
    assert got["lost"].llm_requests == 0 and got["lost"].llm_calls == {}
    r = got["twice"]
    assert (r.llm_requests, list(r.llm_calls), r.input_tokens, r.cloudflare_neurons) == (2, ["m"], 2_000_000, 2000.0)
    assert record(spark, []) == {}
