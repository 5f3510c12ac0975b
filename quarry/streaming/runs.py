"""Run records as a stream (S12 -> R1): experiment summaries kept up to date while
runs are written.

Run records land as JSON files (``sources.artefacts.write_runs``); this reads
the folder with Structured Streaming and maintains the per-experiment summary
incrementally (state = one row per experiment).  Late or repeated files are
just more rows: the summary is a running aggregate, no window is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.artefacts import RUN_SCHEMA


def run_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    return (spark.readStream.schema(RUN_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .json(path))


def summary(runs: DataFrame) -> DataFrame:
    """R1 on a stream: count, mean accuracy (VALID runs only), token sums."""
    score = F.when(F.col("execution_status") == "VALID", F.coalesce("accuracy", F.lit(0.0))).otherwise(F.lit(0.0))
    return runs.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("evaluated_queries"),
        F.avg(score).alias("average_accuracy"),
        F.sum("input_tokens").alias("total_input_tokens"),
        F.sum("output_tokens").alias("total_ouput_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


def start_summary(spark: SparkSession, path: str, checkpoint: str, query_name: str = "experiment_summary",
                  sink: str = "memory") -> StreamingQuery:
    """Start the incremental summary; ``checkpoint`` must be on shared storage on a cluster."""
    return (summary(run_stream(spark, path)).writeStream.outputMode("complete").format(sink)
            .queryName(query_name).option("checkpointLocation", checkpoint).start())
