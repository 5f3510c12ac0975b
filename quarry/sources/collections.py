"""A stored collection of vectors with get-or-create and insert by id.

A collection is a folder.  ``segments`` holds one Parquet table per insert, ``versions`` one
small file per version that lists the segments of that version; the greatest number is
the current one.  An insert writes a segment with the ids that the current version does not hold, then creates
the next version's file.  A reader sees a version or the one before, never half an insert.  If the
writer is lost before its version file stands, nothing has changed, and the insert can be done again: what the lost
one had committed is there by id, and adds nothing.  Two writers cannot create the same version: the one that is late reads
the new version and starts over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

DIGITS = 10
ATTEMPTS = 20


def _version(n: int) -> str:
    return f"{n:0{DIGITS}d}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed versions."""
    return [int(n) for n in files.names(spark, f"{path}/versions") if n.isdigit()]


def get_or_create(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The collection's current rows; an empty collection with the given columns where there is none."""
    if not versions(spark, path):
        files.create(spark, f"{path}/versions/{_version(0)}", schema)
    return current(spark, path)


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the current version, or of an earlier one."""
    schema, *segments = files.read(spark, f"{path}/versions/{_version(max(versions(spark, path)) if version is None else version)}").split("\n")
    if not segments:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/segments/{s}" for s in segments])


def insert(spark: SparkSession, path: str, rows: DataFrame, id_col: str) -> int:
    """Adds the rows whose id is new, as one version; the number of the version that holds them.

    An id that the collection holds stays as it is.  Of rows with one id in one insert the least counts (by their columns in order);
    rows without id are left out.  Where every id is known no version is made.
    """
    for _ in range(ATTEMPTS):
        n = max(versions(spark, path))
        held = current(spark, path, n)
        schema = held.columns
        least = rows.where(F.col(id_col).isNotNull()).select(*schema).groupBy(id_col).agg(F.min(F.struct(*schema)).alias("row")).select("row.*")
        segment = uuid.uuid4().hex
        least.join(held.select(id_col), id_col, "left_anti").select(*schema).write.parquet(f"{path}/segments/{segment}")
        if spark.read.parquet(f"{path}/segments/{segment}").isEmpty():
            files.delete(spark, f"{path}/segments/{segment}")
            return n
        if files.create(spark, f"{path}/versions/{_version(n + 1)}", files.read(spark, f"{path}/versions/{_version(n)}") + f"\n{segment}"):
            return n + 1
        files.delete(spark, f"{path}/segments/{segment}")
    raise RuntimeError(f"{path}: other writers committed first {ATTEMPTS} times")
