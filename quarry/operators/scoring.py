"""Result-set scoring (E3-E8): does a predicted result contain every gold column?

A result set is a wide DataFrame (case column, position column, value columns).
A column is summarised by a signature: value count and two 60-bit halves of one md5 digest
a cell, XOR-ed over its cells (strict: over (position, value), so order matters;
relaxed: over distinct lower-cased values, so it is a set).  XOR is
associative, so the strict signature is one partial aggregation per case (no
unpivot of the data); a case with a third of all rows is combined map-side.
Sets of values, and cells that are compared, are gathered per case, a row each; cases of
more than ``CASE_ROWS`` rows, of which there are few, are spread by value or position instead.
Matching is an equivalence, so "every gold column has its own equal predicted
column" is, per signature, gold count <= predicted count.  Both sides have one row per case and meet in one join.

Signatures that agree are strong evidence, no proof.  With ``exact`` the columns of cases that
pass are compared cell by cell (``match``, for large cases ``proven``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonicalize

CASE_ROWS = 100_000  # rows of a case that are gathered in one row


def halves(s: Column) -> list[Column]:
    """The first 15 and the last 15 hexadecimal digits of one md5 digest, as bigints (same values in Spark and DuckDB)."""
    return [F.conv(F.substring(s, at, 15), 16, 10).cast("bigint") for at in (1, 18)]


def _canon(df: DataFrame, keep: list[str], cols: list[str], relaxed_mode: bool) -> DataFrame:
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    specs = [(f"_v{i}", F.col(c), types[c]) for i, c in enumerate(cols)]
    return canonicalize(df.select(*keep, *cols), specs, relaxed_mode).select(
        *keep, *[f"_v{i}" for i in range(len(cols))])


def _strict(df: DataFrame, case: str, pos: str, cols: list[str], cells: bool = False) -> DataFrame:
    """One row per case: case_id, rows, sigs (n, h1, h2 of each column); with ``cells`` each column's (position, value) pairs in order."""
    v = _canon(df.select(F.col(case).alias("case_id"), F.col(pos).cast("string").alias("_p"), *cols),
               ["case_id", "_p"], cols, False)
    v = v.select("*", *[F.md5(F.concat_ws("|", "_p", f"_v{i}")).alias(f"_d{i}") for i in range(len(cols))])
    aggs = [F.bit_xor(h).alias(f"h{k}_{i}") for i in range(len(cols)) for k, h in enumerate(halves(F.col(f"_d{i}")), 1)]
    if cells:
        aggs.append(F.collect_list(F.struct("_p", *[f"_v{i}" for i in range(len(cols))])).alias("_rows"))
    wide = v.groupBy("case_id").agg(F.count(F.lit(1)).alias("rows"), *aggs)
    sigs = F.array(*[F.struct(F.col("rows").alias("n"), F.col(f"h1_{i}").alias("h1"), F.col(f"h2_{i}").alias("h2")) for i in range(len(cols))])
    out = wide.select("case_id", "rows", sigs.alias("sigs"), *(["_rows"] if cells else []))
    return out.withColumn("_rows", F.array(*[F.array_sort(F.transform("_rows", _pair(i))) for i in range(len(cols))])) if cells else out


def _pair(i: int):
    return lambda r: F.struct(r["_p"].alias("p"), r[f"_v{i}"].alias("v"))


def _relaxed(df: DataFrame, case: str, cols: list[str], cells: bool = False) -> DataFrame:
    """One row per case: case_id, rows, sigs (n, h1, h2 of each column's set of values); with ``cells`` the sets, sorted."""
    v = _canon(df.select(F.col(case).alias("case_id"), *cols), ["case_id"], cols, True)
    wide = v.groupBy("case_id").agg(F.count(F.lit(1)).alias("rows"), F.collect_list(F.struct(*[f"_v{i}" for i in range(len(cols))])).alias("_r"))
    sets = wide.select("case_id", "rows", *[F.array_distinct(F.col("_r")[f"_v{i}"]).alias(f"_s{i}") for i in range(len(cols))])
    digests = sets.select("*", *[F.transform(f"_s{i}", F.md5).alias(f"_d{i}") for i in range(len(cols))])
    folded = lambda d, k: F.aggregate(d, F.lit(0).cast("long"), lambda x, one: x.bitwiseXOR(halves(one)[k]))
    sigs = F.array(*[F.struct(F.size(f"_s{i}").cast("long").alias("n"), folded(F.col(f"_d{i}"), 0).alias("h1"), folded(F.col(f"_d{i}"), 1).alias("h2"))
                     for i in range(len(cols))])
    kept = [F.array(*[F.array_sort(f"_s{i}") for i in range(len(cols))]).alias("_rows")] if cells else []
    return digests.select("case_id", "rows", sigs.alias("sigs"), *kept)


def _spread_relaxed(df: DataFrame, case: str, cols: list[str]) -> DataFrame:
    """``_relaxed`` for large cases: unpivoted, then made distinct on (case, column, value), so one case spreads over all partitions."""
    v = _canon(df.select(F.col(case).alias("case_id"), *cols), ["case_id"], cols, True)
    cells = v.select("case_id", F.inline(F.array(*[
        F.struct(F.lit(i).alias("col_idx"), F.col(f"_v{i}").alias("value")) for i in range(len(cols))])))
    d = cells.distinct().select("case_id", "col_idx", F.md5("value").alias("_d"))
    h1, h2 = halves(F.col("_d"))
    long = d.groupBy("case_id", "col_idx").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h1).alias("h1"), F.bit_xor(h2).alias("h2"))
    sigs = long.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", "n", "h1", "h2"))).alias("sigs"))
    sigs = sigs.withColumn("sigs", F.transform("sigs", lambda s: F.struct(s["n"].alias("n"), s["h1"].alias("h1"), s["h2"].alias("h2"))))
    return row_counts(df, case).join(sigs, "case_id")


def _per_column(wide: DataFrame) -> DataFrame:
    return wide.select("case_id", F.posexplode("sigs").alias("col_idx", "s")).select("case_id", "col_idx", "s.n", "s.h1", "s.h2")


def strict_signatures(df: DataFrame, case: str, pos: str, cols: list[str]) -> DataFrame:
    """(case, col_idx, n, h1, h2) per column, in one wide aggregation per case."""
    return _per_column(_strict(df, case, pos, cols))


def relaxed_signatures(df: DataFrame, case: str, cols: list[str]) -> DataFrame:
    """(case, col_idx, n, h1, h2) over the set of relaxed values of each column."""
    large = large_cases(case, df)
    out = _per_column(_relaxed(_without(df, case, large), case, cols))
    return out if large is None else out.unionByName(_per_column(_spread_relaxed(_only(df, case, large), case, cols)))


def large_cases(case: str, *sides: DataFrame) -> DataFrame | None:
    """case_id of the cases with more than ``CASE_ROWS`` rows on a side; None if there are none."""
    found = None
    for df in sides:
        some = row_counts(df, case).where((F.col("rows") > CASE_ROWS) & F.col("case_id").isNotNull()).select("case_id")
        found = some if found is None else found.union(some)
    found = found.distinct().checkpoint(eager=True)
    return None if found.isEmpty() else found


def _without(df: DataFrame, case: str, large: DataFrame | None) -> DataFrame:
    return df if large is None else df.join(F.broadcast(large.withColumnRenamed("case_id", case)), case, "left_anti")


def _only(df: DataFrame, case: str, large: DataFrame) -> DataFrame:
    return df.join(F.broadcast(large.withColumnRenamed("case_id", case)), case, "left_semi")


def match(gold: DataFrame, pred: DataFrame, cases: DataFrame, cells: bool = False) -> DataFrame:
    """Score per case.  ``cases``: case_id; ``gold``, ``pred``: case_id, rows, sigs, and _rows with ``cells``.

    Both empty -> 1.0, one empty -> 0.0, else 1.0 iff every gold signature
    occurs at least as often among the predicted columns; with ``cells`` every gold column's cells as well.
    """
    named = lambda df, side: df.select("case_id", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "case_id"])
    c = cases.select("case_id").join(named(gold, "g"), "case_id", "left").join(named(pred, "p"), "case_id", "left")
    often = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    held = lambda what: F.forall(f"g_{what}", lambda x: often(f"p_{what}", x) >= often(f"g_{what}", x))
    agree = F.coalesce(held("sigs"), F.lit(False))
    if cells:
        agree = F.when(agree, F.coalesce(held("_rows"), F.lit(False))).otherwise(F.lit(False))
    g_empty, p_empty = F.col("g_rows").isNull(), F.col("p_rows").isNull()
    score = (F.when(g_empty & p_empty, F.lit(1.0))
             .when(g_empty | p_empty, F.lit(0.0))
             .when(agree, F.lit(1.0))
             .otherwise(F.lit(0.0)))
    return c.select("case_id", score.alias("score"))


def row_counts(df: DataFrame, case: str) -> DataFrame:
    return df.groupBy(F.col(case).alias("case_id")).agg(F.count(F.lit(1)).alias("rows"))


def proven(gold: DataFrame, pred: DataFrame, gcols: list[str], pcols: list[str], case: str, pos: str, relaxed_mode: bool) -> DataFrame:
    """case_id of the cases in which every gold column has its own predicted column with the same cells, compared value by value.

    Strict: gold and predicted rows meet by (case, position).  Relaxed: each distinct value of a case
    tells the columns that hold it.  Either way a row tells which columns agree there, and a
    case's columns are equal if they agree on all its rows: a conjunction that is combined before the shuffle, for any size of a case.
    """
    keep = ["case_id"] if relaxed_mode else ["case_id", "_p"]
    sides = []
    for df, cols in ((gold, gcols), (pred, pcols)):
        at = [F.col(case).alias("case_id")] if relaxed_mode else [F.col(case).alias("case_id"), F.col(pos).cast("string").alias("_p")]
        sides.append(_canon(df.select(*at, *cols), keep, cols, relaxed_mode))
    n, m = len(gcols), len(pcols)
    if relaxed_mode:
        held = [v.select("case_id", F.inline(F.array(*[F.struct(F.lit(i + shift).alias("c"), F.col(f"_v{i}").alias("value")) for i in range(k)])))
                for v, k, shift in ((sides[0], n, 0), (sides[1], m, n))]
        rows = held[0].unionByName(held[1]).groupBy("case_id", "value").agg(*[F.max(F.col("c") == i).alias(f"_v{i}") for i in range(n + m)])
    else:
        g, p = (v.toDF("case_id", "_p", *[f"_v{i + shift}" for i in range(k)]) for v, k, shift in ((sides[0], n, 0), (sides[1], m, n)))
        rows = g.join(p, ["case_id", "_p"], "full")
    same = {(i, j): F.bool_and(F.col(f"_v{i}").eqNullSafe(F.col(f"_v{j}"))) for i in range(n) for j in range(n + m) if i != j}
    equal = rows.groupBy("case_id").agg(*[c.alias(f"e{i}_{j}") for (i, j), c in same.items()])
    count = lambda i, js: sum((F.col(f"e{i}_{j}").cast("int") for j in js if j != i), F.lit(0))
    found = [count(i, range(n, n + m)) >= count(i, range(n)) + 1 for i in range(n)]
    return equal.where(F.array_min(F.array(*found))).select("case_id")


def execution_accuracy(gold: DataFrame, pred: DataFrame, cases: DataFrame, case: str = "case_id",
                       pos: str = "pos", relaxed_mode: bool = False, exact: bool = False) -> DataFrame:
    """E5 (strict) or the relaxed variant, per case: score 1.0 / 0.0.

    ``exact``: a case whose signatures agree scores only if its cells do; positions are then unique within a case.
    """
    gcols = [c for c in gold.columns if c not in (case, pos)]
    pcols = [c for c in pred.columns if c not in (case, pos)]
    if not relaxed_mode and not exact:
        return match(_strict(gold, case, pos, gcols), _strict(pred, case, pos, pcols), cases)
    large = large_cases(case, gold, pred)
    sides = [(_without(df, case, large), cols) for df, cols in ((gold, gcols), (pred, pcols))]
    light = [_relaxed(df, case, cols, exact) if relaxed_mode else _strict(df, case, pos, cols, exact) for df, cols in sides]
    if large is None:
        return match(*light, cases, exact)
    gold, pred = _only(gold, case, large), _only(pred, case, large)
    heavy = [_spread_relaxed(df, case, cols) if relaxed_mode else _strict(df, case, pos, cols) for df, cols in ((gold, gcols), (pred, pcols))]
    scores = match(*heavy, _only(cases.select("case_id"), "case_id", large))
    if exact:
        scores = scores.checkpoint(eager=True)
        passed = F.broadcast(heavy[0].select("case_id").join(scores.where("score = 1.0"), "case_id", "left_semi"))  # both empty: nothing to prove
        of_passed = lambda df: df.join(passed.select(F.col("case_id").alias(case)), case, "left_semi")
        proof = proven(of_passed(gold), of_passed(pred), gcols, pcols, case, pos, relaxed_mode).withColumn("proven", F.lit(True))
        failed = passed.join(proof, "case_id", "left_anti").withColumn("failed", F.lit(True))
        scores = scores.join(failed, "case_id", "left").select("case_id", F.when(F.col("failed"), F.lit(0.0)).otherwise(F.col("score")).alias("score"))
    return match(*light, _without(cases.select("case_id"), "case_id", large), exact).unionByName(scores)


def accuracy_per_run(scores: DataFrame, runs: DataFrame, gold_valid: DataFrame) -> DataFrame:
    """Runs whose gold query fails leave the denominator; a run scores only if VALID."""
    from .telemetry import execution_status
    st = execution_status(F.col("spark_error"), F.col("sparksql_query"))
    r = runs.select("query_id", "experiment", st.alias("execution_status"))
    r = r.join(gold_valid.select(F.col("case_id").alias("query_id")), "query_id", "left_semi")
    s = scores.select(F.col("case_id").alias("query_id"), "score")
    return (r.join(s, "query_id", "left")
            .withColumn("accuracy", F.when(F.col("execution_status") == "VALID",
                                           F.coalesce("score", F.lit(0.0))).otherwise(F.lit(0.0)))
            .drop("score"))
