"""Experiment reports (R1-R7) over run records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from ..functions import texts as TX

from .telemetry import execution_status

# Difficulty order of the report, the default texts of the log summary.
DIFFICULTY_ORDER = ["Simple", "Moderate", "Challenging"]
QUESTION_RANGE = (195, 339)


def scored(runs: DataFrame) -> DataFrame:
    """E7 on run records: accuracy counts only for VALID runs, else 0 (non-numeric -> 0, D13)."""
    st = execution_status(F.col("spark_error"), F.col("sparksql_query"))
    acc = F.coalesce(F.col("accuracy").cast("string").try_cast("double"), F.lit(0.0))
    return runs.withColumns({"execution_status": st,
                             "score": F.when(st == "VALID", acc).otherwise(F.lit(0.0))})


def experiment_summary(runs: DataFrame) -> DataFrame:
    """Count, mean accuracy, token sums and tokens per query (0 when empty)."""
    s = scored(runs)
    return s.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("evaluated_queries"),
        F.avg("score").alias("average_accuracy"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_ouput_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
    ).withColumn("avg_tokens_per_query",
                 F.coalesce(F.try_divide(F.col("total_tokens"), F.col("evaluated_queries")), F.lit(0.0)))


def log_summary(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """R2: run log left-joined to the benchmark, with the reference's default texts."""
    q = questions.select("query_id", F.col("question").alias("q_text"), F.col("sql").alias("q_sql"))
    s = scored(runs)
    return s.join(q, "query_id", "left").select(
        "query_id",
        F.coalesce("q_text", F.lit(TX.NOT_FOUND)).alias("nl_query"),
        F.coalesce("q_sql", F.lit(TX.NOT_FOUND)).alias("golden_query"),
        F.coalesce("sparksql_query", F.lit(TX.NO_SQL)).alias("generated_query"),
        "execution_status", "spark_error", (F.col("query_result") if "query_result" in runs.columns else F.lit(None).cast("string")).alias("query_result"),
        F.coalesce(F.col("accuracy").cast("string"), F.lit(TX.NOT_AVAILABLE)).alias("accuracy"),
    )


def accuracy_by_arch(runs: DataFrame) -> DataFrame:
    """Mean accuracy and percentage per architecture."""
    return (scored(runs).groupBy(F.col("experiment").alias("architecture"))
            .agg(F.avg("score").alias("accuracy"))
            .withColumn("accuracy_pct", F.col("accuracy") * 100))


def accuracy_by_difficulty(runs: DataFrame) -> DataFrame:
    """Per architecture and capitalised difficulty (Simple, Moderate, Challenging only)."""
    order = F.broadcast(runs.sparkSession.createDataFrame(
        [(d, i) for i, d in enumerate(DIFFICULTY_ORDER)], "difficulty_label string, difficulty_rank int"))
    s = scored(runs).withColumn("difficulty_label", F.initcap(F.lower("difficulty")))
    return (s.join(order, "difficulty_label")
            .groupBy(F.col("experiment").alias("architecture"), "difficulty_label", "difficulty_rank")
            .agg(F.avg("score").alias("accuracy")))


def accuracy_gain(runs: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Percentage-point gain over the baseline architecture (one-row broadcast)."""
    a = accuracy_by_arch(runs)
    base = F.broadcast(a.where(F.col("architecture") == baseline)
                       .select(F.col("accuracy_pct").alias("baseline_pct")))
    return (a.where(F.col("architecture") != baseline).crossJoin(base)
            .select("architecture", "accuracy_pct",
                    (F.col("accuracy_pct") - F.col("baseline_pct")).alias("improvement")))


def strict_vs_relaxed(runs: DataFrame) -> DataFrame:
    """Strict and relaxed mean accuracy and their difference per log."""
    s = scored(runs).withColumn(
        "relaxed_score", F.when(F.col("execution_status") == "VALID",
                                F.coalesce(F.col("relaxed_accuracy"), F.lit(0.0))).otherwise(F.lit(0.0)))
    return (s.groupBy("experiment")
            .agg(F.avg("score").alias("strict_accuracy"), F.avg("relaxed_score").alias("relaxed_accuracy"))
            .withColumn("difference", F.col("relaxed_accuracy") - F.col("strict_accuracy")))


def question_range(questions: DataFrame, lo: int = QUESTION_RANGE[0], hi: int = QUESTION_RANGE[1]) -> DataFrame:
    """Keep question ids lo..hi (pushed into the scan as a range filter)."""
    return questions.where(F.col("query_id").between(lo, hi))
