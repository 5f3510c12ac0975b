"""Result-set scoring: the 18 reference cases and the canonical-value table (FIXTURES §2-3)."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.canonical import NULL_TOKEN, canonical, canonicalize
from quarry.operators import scoring as S


def _type(col):
    vals = [v for v in col if v is not None]
    if vals and all(isinstance(v, bool) for v in vals):
        return "boolean", col
    if vals and all(isinstance(v, int) and not isinstance(v, bool) for v in vals):
        return "long", col
    if vals and all(isinstance(v, float) for v in vals):
        return "double", col
    return "string", [None if v is None else str(v) for v in col]


def _frame(spark, cols):
    typed = [_type(c) for c in cols]
    n = len(cols[0])
    schema = "case_id long, pos long" + "".join(f", c{i} {t}" for i, (t, _) in enumerate(typed))
    rows = [(1, r, *[vals[r] for _, vals in typed]) for r in range(n)]
    return spark.createDataFrame(rows, schema)


def score(spark, gold, pred, relaxed=False):
    cases = spark.createDataFrame([(1,)], "case_id long")
    out = S.execution_accuracy(_frame(spark, gold), _frame(spark, pred), cases, relaxed_mode=relaxed)
    return out.first()["score"]


X, Y, Z = "x", "y", "z"
CASES = [
    ("both_empty", [[]], [[]], 1.0),
    ("gt_empty", [[]], [[1, 2]], 0.0),
    ("inf_empty", [[1, 2]], [[]], 0.0),
    ("exact_match", [[1, 2, 3], [X, Y, Z]], [[1, 2, 3], [X, Y, Z]], 1.0),
    ("different_column_names", [[1, 2, 3], [X, Y, Z]], [[1, 2, 3], [X, Y, Z]], 1.0),
    ("extra_columns_in_inf", [[1, 2, 3]], [[1, 2, 3], [X, Y, Z], [4, 5, 6]], 1.0),
    ("missing_column", [[1, 2, 3], [X, Y, Z]], [[1, 2, 3]], 0.0),
    ("different_order", [[1, 2, 3]], [[3, 2, 1]], 0.0),
    ("different_order_columns", [[1, 2, 3], [X, Y, Z]], [[X, Y, Z], [1, 2, 3]], 1.0),
    ("numeric_normalization", [[49729, 49729.0, "49729"]], [[49729, 49729, 49729]], 1.0),
    ("null_values", [[None, "hello"]], [["null", "hello"]], 1.0),
    ("partial_column_match", [[1, 2, 3]], [[1, 2, 4]], 0.0),
    ("reordered_columns_in_inf", [[1, 2], [3, 4]], [[3, 4], [1, 2]], 1.0),
    ("single_row", [[1], [X]], [[1], [X]], 1.0),
    ("single_column_different_name", [[1, 2, 3]], [[1, 2, 3]], 1.0),
    ("list_input", [[1, 2], [X, Y]], [[1, 2], [X, Y]], 1.0),
    ("duplicate_columns", [[1, 2], [1, 2]], [[1, 2], [1, 2]], 1.0),
    ("duplicate_columns_missing", [[1, 2], [1, 2]], [[1, 2]], 0.0),
]


@pytest.mark.parametrize("name,gold,pred,expected", CASES, ids=[c[0] for c in CASES])
def test_reference_cases(spark, name, gold, pred, expected):
    assert score(spark, gold, pred) == expected


def test_relaxed_order_duplicates_and_case(spark):
    assert score(spark, [[1, 2, 3]], [[3, 2, 1]], relaxed=True) == 1.0
    assert score(spark, [[1, 1, 2]], [[2, 1]], relaxed=True) == 1.0
    assert score(spark, [["C"]], [["c"]], relaxed=True) == 1.0
    assert score(spark, [["C"]], [["c"]]) == 0.0


CANON = [
    ("49729", "49729"), (" 49729 ", "49729"), ("49729.0", "49729"), ("+5", "5"), ("-0", "0"),
    ("1e3", "1000"), ("12345678901234567890", "12345678901234567890"), ("1.50", "1.50"),
    ("", ""), ("NaN", "__NULL__"), ("NULL", "__NULL__"), (" n/a ", "__NULL__"), ("None", "__NULL__"),
    ("True", "True"), ("0x10", "0x10"), ("5d", "5d"), ("5f", "5f"), ("inf", "inf"), ("1e400", "1e400"),
    (None, "__NULL__"),
]


def test_canonical_text_table(spark):
    df = spark.createDataFrame([(v,) for v, _ in CANON], "v string")
    got = [r[0] for r in df.select(canonical(F.col("v"), T.StringType())).collect()]
    assert got == [e for _, e in CANON]
    staged = canonicalize(df, [("o", F.col("v"), T.StringType())]).select("o").collect()
    assert [r[0] for r in staged] == [e for _, e in CANON]


def test_canonical_typed_values(spark):
    d = spark.createDataFrame([(49729.0, True, 1.5), (-0.0, False, 1e22), (float("nan"), None, None)],
                              "a double, b boolean, c double")
    rows = d.select(canonical(F.col("a"), T.DoubleType()), canonical(F.col("b"), T.BooleanType()),
                    canonical(F.col("c"), T.DoubleType())).collect()
    assert [tuple(r) for r in rows] == [("49729", "1", "1.5"), ("0", "0", "10000000000000000000000"),
                                        ("__NULL__", "__NULL__", "__NULL__")]


def test_strict_signature_is_order_sensitive(spark):
    a = _frame(spark, [[1, 2, 3]])
    b = _frame(spark, [[3, 2, 1]])
    sa = S.strict_signatures(a, "case_id", "pos", ["c0"]).first()
    sb = S.strict_signatures(b, "case_id", "pos", ["c0"]).first()
    assert (sa["h1"], sa["h2"]) != (sb["h1"], sb["h2"])
    ra = S.relaxed_signatures(a, "case_id", ["c0"]).first()
    rb = S.relaxed_signatures(b, "case_id", ["c0"]).first()
    assert (ra["n"], ra["h1"], ra["h2"]) == (rb["n"], rb["h1"], rb["h2"])
    assert not math.isnan(float(sa["h1"]))


def test_large_whole_numbers_and_spaces(spark):
    """Every digit of a whole double, as Python's int gives it; any white space at the ends goes."""
    values = [1e15, 2.0 ** 53 + 2, -(2.0 ** 62), 2.0 ** 63, 9.3e18, 1e19, 1e22, 1e23, 1e37, -1e37, 1e38, 1.7e308, 12345678901234567890.0, 0.0, -0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(canonical(F.col("v"), T.DoubleType())).collect()]
    assert got == [str(int(v)) for v in values]
    texts = ["1e23", " 1e37 ", "12345678901234567890.0", " 7 ", " x　", "\x1fnull\x85", "2.50", "inf", "9007199254740994.0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(canonical(F.col("t"), T.StringType())).collect()]
    assert got == [str(int(1e23)), str(int(1e37)), "12345678901234567168", "7", "x", NULL_TOKEN, "2.50", "inf", "9007199254740994"]


def _result(spark, rows, cols):
    return spark.createDataFrame([("c", k, *r) for k, r in enumerate(rows)], "case_id string, pos long, " + ", ".join(f"{c} string" for c in cols))


def test_exact_mode_equals_signatures_on_the_reference_rules(spark):
    cases = spark.createDataFrame([("c",)], "case_id string")
    rows = [("1", "x"), ("2", "y"), ("2", "y")]
    swapped, more = [(b, a) for a, b in rows], [(b, a, "z") for a, b in rows]
    twice = [(a, a) for a, _ in rows]
    for gold, pred, strict, relaxed in ((rows, swapped, 1, 1), (rows, more, 1, 1), (rows, rows[::-1], 0, 1), (rows, rows[:2], 0, 1), (rows, twice, 0, 0), (twice, rows, 0, 0),
                                        (twice, twice, 1, 1), ([], [], 1, 1), (rows, [], 0, 0), ([("A", "b")], [("B", "a")], 0, 1)):
        g, p = _result(spark, gold, "gh"), _result(spark, pred, "pqr"[:len(pred[0]) if pred else 2])
        for mode, want in ((False, strict), (True, relaxed)):
            assert S.execution_accuracy(g, p, cases, relaxed_mode=mode, exact=True).first().score == want, (gold, pred, mode)


def test_forced_hash_clash_is_scored_zero_in_exact_mode(spark, monkeypatch):
    cases = spark.createDataFrame([("c",)], "case_id string")
    g, p = _result(spark, [("1", "x"), ("2", "y")], "gh"), _result(spark, [("1", "x"), ("2", "other")], "pq")
    monkeypatch.setattr(S, "halves", lambda s: [F.lit(5).cast("bigint") + F.length(s) * 0, F.lit(7).cast("bigint") + F.length(s) * 0])
    for mode in (False, True):
        assert S.execution_accuracy(g, p, cases, relaxed_mode=mode).first().score == 1.0
        assert S.execution_accuracy(g, p, cases, relaxed_mode=mode, exact=True).first().score == 0.0


def test_large_cases_score_as_small_ones(spark, monkeypatch):
    cases = spark.createDataFrame([(k,) for k in range(4)], "case_id long")
    cells = {0: [("1", "x"), ("2", "y"), ("2", "z")], 1: [("1", "x")], 2: [("7.0", "N"), ("+8", "n/a"), ("8", "N")], 3: []}
    rows = lambda at: [(k, i, *r) for k, part in cells.items() for i, r in enumerate(at(k, part))]
    g = spark.createDataFrame(rows(lambda k, part: part), "case_id long, pos long, g string, h string")
    p = spark.createDataFrame(rows(lambda k, part: part[::-1] if k == 0 else [(a.lower(), b) for b, a in part]), "case_id long, pos long, p string, q string")
    sets = lambda: {tuple(r) for r in S.relaxed_signatures(g, "case_id", ["g", "h"]).collect()}
    want = {(mode, exact): {k: 1.0 if k else float(mode) for k in range(4)} for mode in (False, True) for exact in (False, True)}
    for k in (False, True):
        want[False, k][2] = 0.0  # lower-cased there
    small = sets()
    for most in (100, 2):
        monkeypatch.setattr(S, "CASE_ROWS", most)
        assert sets() == small
        for (mode, exact), scores in want.items():
            assert dict(S.execution_accuracy(g, p, cases, relaxed_mode=mode, exact=exact).collect()) == scores, (most, mode, exact)


def test_quick_texts_are_canonical(spark):
    texts = ["0", "-0", "00", "7", "-7", "7.", "7.0", "-7.00", "0.0", "-0.0", "999999999999999.0", "9999999999999999.0", "N", "NaN", "nan", "Na", "nulls", "N/A", "n/a ", "a b", "7\n", "x\n", "None", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = canonicalize(df, [("o", F.col("t"), T.StringType())]).select("o", canonical(F.col("t"), T.StringType()).alias("c")).collect()
    assert [r["o"] for r in both] == [r["c"] for r in both]
