"""Interval algebra: FIXTURES §4 cases and random groups against a brute-force model."""

import random

from pyspark.sql import functions as F

from quarry.operators import intervals as I


def py_union(iv):
    iv = sorted((s, e) for s, e in iv if s is not None and e is not None and e >= s)
    out = []
    for s, e in iv:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def py_subtract(base, sub):
    """Point-set difference on a unit grid (intervals are integer here)."""
    b, s = py_union(base), py_union(sub)
    pts = set()
    for x, y in b:
        pts.update(range(x, y))
    for x, y in s:
        pts.difference_update(range(x, y))
    return py_union([(p, p + 1) for p in sorted(pts)])


def frame(spark, rows, cols="k string, start long, end long"):
    return spark.createDataFrame(rows, cols)


def union_rows(spark, iv, bucket=I.DEFAULT_BUCKET_US):
    df = frame(spark, [("a", s, e) for s, e in iv])
    return sorted((r["start"], r["end"]) for r in I.union(df, ["k"], bucket_us=bucket).collect())


def test_union_fixtures(spark):
    assert union_rows(spark, [(0, 5), (3, 8)]) == [(0, 8)]
    assert union_rows(spark, [(0, 5), (5, 8)]) == [(0, 8)]
    assert union_rows(spark, [(0, 2), (4, 5)]) == [(0, 2), (4, 5)]
    assert union_rows(spark, [(3, 1), (None, 2), (0, 1)]) == [(0, 1)]


def sub_rows(spark, base, other, bucket=I.DEFAULT_BUCKET_US):
    b = frame(spark, [("a", s, e) for s, e in base])
    o = frame(spark, [("a", s, e) for s, e in other] or [("z", 0, 0)])
    return sorted((r["start"], r["end"]) for r in I.subtract(b, o, ["k"], bucket_us=bucket).collect())


def test_subtract_fixtures(spark):
    assert sub_rows(spark, [(0, 10)], [(3, 7)]) == [(0, 3), (7, 10)]
    assert sub_rows(spark, [(2, 4)], [(0, 9)]) == []
    assert sub_rows(spark, [(0, 3)], []) == [(0, 3)]


def test_breakdown_fixture(spark):
    spans = spark.createDataFrame(
        [("r", "llm", 1, 5), ("r", "llm", 4, 8), ("r", "tool", 6, 14), ("r", "spark", 9, 12)],
        "run_id string, type string, start long, end long")
    bounds = spark.createDataFrame([("r", 0, 20)], "run_id string, run_start long, run_end long")
    r = I.breakdown(spans, bounds, ["run_id"]).first()
    assert (r["total_us"], r["llm_us"], r["spark_us"], r["tool_overhead_us"], r["orchestration_us"]) == (20, 7, 3, 3, 7)


def test_random_groups_against_brute_force(spark):
    rnd = random.Random(7)
    base_rows, other_rows, expect_u, expect_d = [], [], {}, {}
    for g in range(30):
        k = f"g{g}"
        b = [(s, s + rnd.randint(0, 12)) for s in (rnd.randint(0, 60) for _ in range(rnd.randint(1, 8)))]
        o = [(s, s + rnd.randint(1, 9)) for s in (rnd.randint(0, 60) for _ in range(rnd.randint(0, 5)))]
        base_rows += [(k, s, e) for s, e in b]
        other_rows += [(k, s, e) for s, e in o]
        expect_u[k] = py_union(b)
        expect_d[k] = [iv for iv in py_subtract(b, o) if iv[1] > iv[0]]
    # tiny buckets, so every group spans many buckets and the two-level scans are exercised
    base = frame(spark, base_rows)
    other = frame(spark, other_rows)
    got_u, got_d = {}, {}
    for r in I.union(base, ["k"], bucket_us=7).collect():
        got_u.setdefault(r["k"], []).append((r["start"], r["end"]))
    for r in I.subtract(base, other, ["k"], bucket_us=7).collect():
        got_d.setdefault(r["k"], []).append((r["start"], r["end"]))
    for k in expect_u:
        assert sorted(got_u.get(k, [])) == expect_u[k], k
        # zero-length base intervals have no length to keep
        assert sorted(got_d.get(k, [])) == py_union([iv for iv in expect_d[k]]), k


def test_running_two_level_equals_one_level(spark):
    rnd = random.Random(3)
    rows = [("a", i, rnd.randint(-3, 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t long, v long").withColumn("bucket", (F.col("t") / 13).cast("long"))
    got = {r["t"]: r["run"] for r in I.running(df, ["k"], ["t"], {"run": "v"}).collect()}
    acc = 0
    for _, t, v in rows:
        acc += v
        assert got[t] == acc


def test_one_scan_of_the_spans(spark):
    """The plan over the source is evaluated once, whatever the number of sides."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("r", "llm", 1, 5), ("r", "tool", 2, None), ("r", "spark", 9, 12), ("q", "tool", 0, 3)]
    spans = spark.createDataFrame(rows, "run_id string, type string, start long, end long").mapInArrow(count, "run_id string, type string, start long, end long")
    got = {r["run_id"]: tuple(r)[1:] for r in I.breakdown(spans, None, ["run_id"]).collect()}
    assert got == {"r": (11, 4, 3, 4, 0, 0), "q": (3, 0, 0, 3, 0, 0)} and seen.value == len(rows)
    left = I.subtract_sides(spans, ["run_id"], F.col("type") == "tool", F.col("type") != "tool", open_ends=True)
    assert {tuple(r) for r in left.collect()} == {("r", 5, 9), ("q", 0, 3)} and seen.value == 2 * len(rows)


def test_fitted_buckets_equal_fixed_ones(spark, monkeypatch):
    rnd = random.Random(11)
    rows = [(rnd.choice("aab"), s, s + rnd.choice([0, 1, 5, 900])) for s in (rnd.choice([rnd.randint(0, 40), rnd.randint(0, 3000)]) for _ in range(400))]
    df = frame(spark, rows)
    want = {k: py_union([(s, e) for g, s, e in rows if g == k]) for k in "ab"}
    monkeypatch.setattr(I, "ROWS_PER_BUCKET", 30)
    for bucket in (None, 50):
        got = I.union(df, ["k"], bucket_us=bucket).collect()
        assert {k: sorted((r["start"], r["end"]) for r in got if r["k"] == k) for k in "ab"} == want


def test_rows_of_large_keys_are_numbered_as_of_small_ones(spark, monkeypatch):
    df = spark.createDataFrame([(k, (i * 7) % n) for k, n in ((1, 12), (2, 3), (None, 2)) for i in range(n)], "k long, t long")
    want = sorted([(k, i, i + 1, n) for k, n in ((1, 12), (2, 3), (None, 2)) for i in range(n)], key=str)
    for most in (100, 4):
        monkeypatch.setattr(I, "KEY_ROWS", most)
        monkeypatch.setattr(I, "ROWS_PER_BUCKET", most)
        assert sorted(map(tuple, I.numbered(df, ["k"], ["t"]).collect()), key=str) == want
