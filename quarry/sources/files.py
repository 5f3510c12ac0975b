"""Small files and folders of any store that Spark reaches: the commit steps of sinks and collections."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies directly in a folder, in order; none if there is no folder."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Moves a folder to a place where nothing is yet, in one step; False if there is something."""
    fs, p = _at(spark, old)
    target = _at(spark, new)[1]
    fs.mkdirs(target.getParent())
    return not fs.exists(target) and fs.rename(p, target)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small new file whole: under a name of its own first, then renamed; False if the file is there already."""
    fs, p = _at(spark, path)
    if fs.exists(p):
        return False
    own = f"{path}.{uuid.uuid4().hex}"
    out = fs.create(_at(spark, own)[1], False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if rename(spark, own, path):
        return True
    delete(spark, own)
    return False


def read(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    return "\n".join(r.value for r in spark.read.text(path).collect())
