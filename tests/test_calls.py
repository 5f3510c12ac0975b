"""Model calls inside tools, and the span forest, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import calls as C
from quarry.operators import intervals as I

COLS = "run_id string, span_id long, type string, name string, start long, end long, input_tokens long, output_tokens long"


def plain_innermost(rows):
    out = {}
    for run, i, kind, _, start, *_ in rows:
        if kind == "llm" and start is not None:
            held = [(s, j) for r, j, k, _, s, e, *_ in rows if r == run and k == "tool" and s is not None and s <= start and (e is None or e > start)]
            out[run, i] = max(held)[1] if held else None
    return out


def spans(seed, n=300, width=2000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.choice([rng.randint(0, width), rng.randint(500, 520)])
        end = rng.choice([None, start, start - 3, start + rng.randint(1, 30), start + rng.randint(1, width)])
        rows.append((rng.choice("aaab"), i, rng.choice(["llm", "tool", "tool", "spark"]), f"t{i % 4}", start, end, rng.choice([None, 5]), i))
    return rows + [("a", 1000, "llm", "x", None, 4, 1, 1), ("c", 1001, "llm", "x", 5, None, 1, 1)]


@pytest.mark.parametrize("bucket", [None, 1, 7, 100])
def test_innermost_equals_plain_version(spark, bucket):
    rows = spans(bucket or 0)
    df = spark.createDataFrame(rows, COLS)
    got = C.innermost(df, ["run_id"], F.col("type") == "llm", F.col("type") == "tool", bucket_us=bucket).collect()
    assert {(r.run_id, r.point_id): r.cover_id for r in got} == plain_innermost(rows) and len(got) == len(plain_innermost(rows))


def test_hot_run_is_split_into_fitted_buckets(spark, monkeypatch):
    monkeypatch.setattr(I, "ROWS_PER_BUCKET", 40)
    rows = spans(5, 400, 100)  # one burst: hundreds of spans within 100 microseconds
    df = spark.createDataFrame(rows, COLS)
    got = C.innermost(df, ["run_id"], F.col("type") == "llm", F.col("type") == "tool").collect()
    assert {(r.run_id, r.point_id): r.cover_id for r in got} == plain_innermost(rows)
    sizes = [r["count"] for r in I.bucketed(df.where("start IS NOT NULL"), ["run_id"], "start").groupBy("run_id", "bucket").count().collect()]
    assert len(sizes) > 6 and max(sizes) < 150


def test_tool_tokens(spark):
    rows = [("r", 1, "tool", "list", 0, 10, None, None), ("r", 2, "tool", "check", 3, 6, None, None), ("r", 3, "llm", "c", 4, 5, 7, 2), ("r", 4, "llm", "c", 6, 9, 1, None),
            ("r", 5, "llm", "c", 10, 12, 3, 1), ("r", 6, "tool", "late", 11, None, None, None), ("r", 7, "llm", "c", 50, 51, 1, 1)]
    calls = C.llm_calls(spark.createDataFrame(rows, COLS))
    assert {(r.span_id, r.tool, r.tool_span_id, r.duration) for r in calls.collect()} == {(3, "check", 2, 1), (4, "list", 1, 3), (5, None, None, 2), (7, "late", 6, 1)}
    assert {tuple(r) for r in C.tool_tokens(calls).collect()} == {("r", "check", 1, 7, 2, 9), ("r", "list", 1, 1, 0, 1), ("r", None, 1, 3, 1, 4), ("r", "late", 1, 1, 1, 2)}
    assert C.llm_calls(spark.createDataFrame([], COLS)).count() == 0


def plain_tree(edges, value):
    up = {i: p if p in dict(edges) else None for i, p in edges}
    out = {}
    for i in up:
        path, at = [i], up[i]
        while at is not None and at not in path:
            path.append(at)
            at = up[at]
        out[i] = None if at is not None else path
    below = {i: [j for j, p in out.items() if p and i in p] for i in up}
    return {i: (up[i], p and p[-1], p and len(p) - 1, p and len(below[i]) - 1, p and sum(value[j] for j in below[i]), p is None) for i, p in out.items()}


def test_span_tree_equals_plain_version(spark):
    rng = random.Random(2)
    edges = [(i, rng.choice([None, i - 1, rng.randint(0, 80), 500])) for i in range(80)]
    value = {i: rng.randint(0, 9) for i, _ in edges}
    df = spark.createDataFrame([("k", i, p, value[i] or None) for i, p in edges] + [("other", 0, 1, 5)], "k string, span_id long, parent_id long, v long")
    got = {r.span_id: tuple(r)[2:] for r in C.span_tree(df, ["k"], ["v"]).where("k = 'k'").collect()}
    assert got == plain_tree(edges, value)
    assert C.span_tree(df.limit(0), ["k"]).count() == 0


def test_chain_of_a_thousand_takes_ten_rounds(spark, monkeypatch):
    df = spark.range(1001).select(F.lit("k").alias("k"), F.col("id").alias("span_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    rounds, plain = [], type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a, **b: rounds.append(1) or plain(self, *a, **b))
    last = C.span_tree(df, ["k"]).orderBy(F.desc("depth")).first()
    assert (last.span_id, last.root, last.depth, last.n_below) == (1000, 0, 1000, 0)
    assert len(rounds) == 11  # the table itself, and one a round


def test_self_times(spark):
    rows = [("r", 1, None, 0, 100), ("r", 2, 1, 10, 30), ("r", 3, 1, 20, 40), ("r", 4, 3, 25, 500), ("r", 5, 1, 90, None), ("r", 6, 1, 50, 50), ("r", 7, 9, 5, 9), ("r", 8, 1, 9, 2)]
    df = spark.createDataFrame(rows, "run_id string, span_id long, parent_id long, start long, end long")
    got = {r.span_id: (r.duration, r.self_time) for r in C.self_times(df, ["run_id"]).collect()}
    assert got == {1: (100, 70), 2: (20, 20), 3: (20, 5), 4: (475, 475), 5: (None, None), 6: (0, 0), 7: (4, 4), 8: (None, None)}


def test_self_times_walk_small_parents_and_sweep_large_ones(spark, monkeypatch):
    """One walk for all parents but those of many children; ids that come twice are one base, nulls have none."""
    rng = random.Random(4)
    rows = [("r", i, rng.choice([None, 0, 0, 1, rng.randint(0, 60)]), s, s + rng.randint(-3, 30)) for i in range(200) for s in [rng.randint(0, 100)]]
    rows += [rows[7], ("r", 0, None, 90, 140), (None, 3, 1, 0, 9), ("r", None, 1, 5, 8), ("r", 500, 0, None, 9), ("q", 1, 1, 0, 50)]
    df = spark.createDataFrame(rows, "run_id string, span_id long, parent_id long, start long, end long")
    whole = lambda: sorted(map(tuple, C.self_times(df, ["run_id"]).collect()), key=str)
    sweeps, plain = [], I.subtract_sides
    monkeypatch.setattr(I, "subtract_sides", lambda *a, **b: sweeps.append(1) or plain(*a, **b))
    wanted = sorted(map(tuple, C.self_times(df, ["run_id"], bucket_us=10).collect()), key=str)
    assert sweeps == [1] and whole() == wanted and sweeps == [1]
    monkeypatch.setattr(I, "KEY_ROWS", 20)
    assert whole() == wanted and sweeps == [1, 1]


def test_settled_spans_join_no_more(spark, monkeypatch):
    """Roots have no ancestor to ask: they are in no shuffle by a null key."""
    df = spark.createDataFrame([("k", i, i - 1 if i % 4 else None) for i in range(40)], "k string, span_id long, parent_id long")
    joined, plain = [], type(df).join
    monkeypatch.setattr(type(df), "join", lambda self, other, on=None, how=None: joined.append((on, self)) or plain(self, other, on, how))
    got = C.span_tree(df, ["k"])
    assert {r.span_id: r.depth for r in got.collect()} == {i: i % 4 for i in range(40)}
    asked = [d for on, d in joined if on == ["k", "jump"]]
    assert asked and all(d.where("jump IS NULL").isEmpty() for d in asked)
