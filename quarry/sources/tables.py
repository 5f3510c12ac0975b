"""Parquet base tables (the star schema and the text tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
ALL_TABLES = STAR_TABLES + ["events", "documents", "embeddings", "pages", "benchmark",
                            "labels", "conversations"]

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=None) -> list[str]:
    """Register each table as a temp view named after the table."""
    names = list(names or ALL_TABLES)
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)
    return names
