"""Named queries for result-set scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.canonical import canonicalize
from ..operators import scoring as S
from ..sources import adapters as A
from ..sources.tables import table


def _canon_source(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_partkey", "l_returnflag", "l_linestatus",
        F.concat(F.lit(" +0"), F.col("l_partkey").cast("string"), F.lit(" ")).alias("padded_key"),
        F.concat(F.col("l_tax").cast("string"), F.lit("d")).alias("tax_d"),
        F.when(F.col("l_linestatus") == "O", F.lit(" n/a ")).otherwise(F.col("l_linestatus")).alias("status_txt"),
        F.concat(F.col("l_quantity").cast("string"), F.lit("e2")).alias("sci_txt"),
    )


def q_canonical_value(spark, sf_dir):
    s = _canon_source(spark, sf_dir)
    t = dict((f.name, f.dataType) for f in s.schema.fields)
    specs = [("quantity", F.col("l_quantity"), t["l_quantity"]), ("tax", F.col("l_tax"), t["l_tax"]),
             ("partkey", F.col("l_partkey"), t["l_partkey"])]
    specs += [(c, F.col(c), t[c]) for c in ("padded_key", "tax_d", "status_txt", "sci_txt")]
    specs += [("quantity_txt", F.col("l_quantity").cast("string"), t["padded_key"])]
    out = [o for o, _, _ in specs]
    base = s.select("l_orderkey", "l_linenumber", *[c.alias(f"_in_{o}") for o, c, _ in specs])
    specs = [(o, F.col(f"_in_{o}"), ty) for o, _, ty in specs]
    return canonicalize(base, specs).select("l_orderkey", "l_linenumber", *out)


def q_canonical_value_relaxed(spark, sf_dir):
    s = _canon_source(spark, sf_dir)
    st = s.schema["padded_key"].dataType
    specs = [("flag", F.col("l_returnflag"), st), ("status_txt", F.col("status_txt"), st),
             ("padded_key", F.col("padded_key"), st)]
    base = s.select("l_orderkey", "l_linenumber", *[c.alias(f"_in_{o}") for o, c, _ in specs])
    specs = [(o, F.col(f"_in_{o}"), ty) for o, _, ty in specs]
    return canonicalize(base, specs, relaxed_mode=True).select("l_orderkey", "l_linenumber",
                                                                "flag", "status_txt", "padded_key")


def _sigs(spark, sf_dir, relaxed_mode):
    _, gold, pred = A.result_cases(spark, sf_dir)
    gc, pc = ["g0", "g1", "g2"], ["p0", "p1", "p2", "p3"]
    if relaxed_mode:
        g, p = S.relaxed_signatures(gold, "case_id", gc), S.relaxed_signatures(pred, "case_id", pc)
    else:
        g, p = S.strict_signatures(gold, "case_id", "pos", gc), S.strict_signatures(pred, "case_id", "pos", pc)
    return (g.withColumn("side", F.lit("gold")).unionByName(p.withColumn("side", F.lit("pred")))
            .select("side", "case_id", "col_idx", "n", "h1", "h2"))


def q_column_signature_strict(spark, sf_dir):
    return _sigs(spark, sf_dir, False)


def q_column_signature_relaxed(spark, sf_dir):
    return _sigs(spark, sf_dir, True)


def _accuracy(spark, sf_dir, relaxed_mode, exact=False):
    cases, gold, pred = A.result_cases(spark, sf_dir)
    return S.execution_accuracy(gold, pred, cases, relaxed_mode=relaxed_mode, exact=exact)


def q_execution_accuracy(spark, sf_dir):
    return _accuracy(spark, sf_dir, False)


def q_execution_accuracy_relaxed(spark, sf_dir):
    return _accuracy(spark, sf_dir, True)


def q_execution_accuracy_exact(spark, sf_dir):
    return _accuracy(spark, sf_dir, False, exact=True)


def q_execution_accuracy_relaxed_exact(spark, sf_dir):
    return _accuracy(spark, sf_dir, True, exact=True)


def q_accuracy_empty_rules(spark, sf_dir):
    """Of every four cases one has rows on both sides, one on none, and one on either."""
    cases, gold, pred = A.result_cases(spark, sf_dir)
    return S.execution_accuracy(gold.where("case_id % 4 >= 2"), pred.where("case_id % 2 = 1"), cases)


def q_accuracy_per_run(spark, sf_dir):
    cases, gold, pred = A.result_cases(spark, sf_dir)
    scores = S.execution_accuracy(gold, pred, cases)
    gold_valid = cases.where(F.col("status") != "P")  # a failing gold query leaves the denominator
    return S.accuracy_per_run(scores, A.runs(spark, sf_dir), gold_valid)


QUERIES = {
    "canonical_value": q_canonical_value,
    "canonical_value_relaxed": q_canonical_value_relaxed,
    "column_signature_strict": q_column_signature_strict,
    "column_signature_relaxed": q_column_signature_relaxed,
    "execution_accuracy": q_execution_accuracy,
    "execution_accuracy_relaxed": q_execution_accuracy_relaxed,
    "execution_accuracy_exact": q_execution_accuracy_exact,
    "execution_accuracy_relaxed_exact": q_execution_accuracy_relaxed_exact,
    "accuracy_empty_rules": q_accuracy_empty_rules,
    "accuracy_per_run": q_accuracy_per_run,
}
