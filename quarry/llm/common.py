"""Helpers shared by the operators: column plumbing, written intermediate tables, text pieces."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every word and line rule, as a regular expression class and as characters.
WHITE = r"\x20\x09-\x0D"
WHITE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def col_of(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots included."""
    return df[f"`{name}`"]


def others(df: DataFrame, *without: str) -> Column:
    """``row``: all other columns of a table as one struct, so that no name in it clashes with an operator's own."""
    left = [col_of(df, c).alias(c) for c in df.columns if c not in without]
    return (F.struct(*left) if left else F.lit(None).cast("struct<none:int>")).alias("row")


def with_columns_of(rows: DataFrame, columns: list[str], **given: Column) -> DataFrame:
    """The named columns again: those given, the rest out of ``row``."""
    return rows.select(*[(given[c] if c in given else F.col("row").getField(c)).alias(c) for c in columns])


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are no white space, in order."""
    bare = F.btrim(text, F.lit(WHITE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{WHITE}]+"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; one of our own only where that is unset, as in local tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quarry-llm-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage ends here, and a lost executor loses nothing."""
    spark = df.sparkSession
    path, schema = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a stored table that no later plan reads."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished phases, which it does when the driver's garbage is collected.

    Two rounds: the first frees the driver's handles, the second what they held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
