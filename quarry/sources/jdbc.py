"""Relational sources (S1, S2): JDBC with a partitioned scan, and SQLite files
through a Python data source when no JDBC driver is on the classpath.

Both keep date-like declared types as text (S3).  Nothing here starts a server.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import (DoubleType, LongType, StringType, StructField, StructType)

from .artefacts import date_like


def read_jdbc(spark: SparkSession, url: str, table: str, driver: str | None = None,
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None, custom_schema: str | None = None,
              fetch_size: int = 10_000) -> DataFrame:
    """JDBC scan; with a numeric ``partition_column`` and bounds it is split into
    ``num_partitions`` range queries read in parallel (filters and columns are pushed)."""
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if driver:
        opts["driver"] = driver
    if custom_schema:
        opts["customSchema"] = custom_schema
    if partition_column is not None:
        opts.update(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
                    numPartitions=str(num_partitions or 8))
    return spark.read.format("jdbc").options(**opts).load()


def jdbc_tables(spark: SparkSession, url: str, driver: str | None = None,
                query: str = "SELECT name FROM sqlite_master WHERE type = 'table'") -> DataFrame:
    """The tables of a source database, read through the metadata query."""
    opts = {"url": url, "query": query}
    if driver:
        opts["driver"] = driver
    return spark.read.format("jdbc").options(**opts).load()


# --- SQLite files as a Python data source --------------------------------------

_AFFINITY = [("INT", LongType()), ("CHAR", StringType()), ("CLOB", StringType()), ("TEXT", StringType()),
             ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType())]


def _spark_type(declared: str | None):
    if date_like(declared):
        return StringType()  # S3: date-like declared types stay text
    d = (declared or "").upper()
    for key, t in _AFFINITY:
        if key in d:
            return t
    return StringType()


class _RowidRange(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: StructType, parts: int):
        self.path, self.table, self.schema, self.parts = path, table, schema, parts

    def partitions(self):
        con = sqlite3.connect(self.path)
        lo, hi = con.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        con.close()
        if lo is None:
            return [_RowidRange(0, -1)]
        step = max(1, (hi - lo + self.parts) // self.parts)
        return [_RowidRange(s, min(hi, s + step - 1)) for s in range(lo, hi + 1, step)]

    def read(self, partition: _RowidRange) -> Iterator[tuple]:
        con = sqlite3.connect(self.path)
        cols = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        cur = con.execute(f'SELECT {cols} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?',
                          (partition.lo, partition.hi))
        conv = [str if isinstance(f.dataType, StringType) else None for f in self.schema.fields]
        for row in cur:
            yield tuple(c(v) if (c and v is not None) else v for c, v in zip(conv, row))
        con.close()


class SqliteDataSource(DataSource):
    """``spark.read.format("sqlite").option("path", ..).option("table", ..)``; one
    partition per rowid range (``numPartitions``, default 4)."""

    @classmethod
    def name(cls):
        return "sqlite"

    def schema(self):
        con = sqlite3.connect(self.options["path"])
        info = con.execute(f'PRAGMA table_info("{self.options["table"]}")').fetchall()
        con.close()
        return StructType([StructField(r[1], _spark_type(r[2])) for r in info])

    def reader(self, schema: StructType):
        return SqliteReader(self.options["path"], self.options["table"], schema,
                            int(self.options.get("numPartitions", 4)))


def register_sqlite(spark: SparkSession) -> None:
    spark.dataSource.register(SqliteDataSource)


def load_sqlite_tables(spark: SparkSession, path: str) -> list[str]:
    """S1 + S2 + S4: every table of a SQLite file as a temp view of the same name."""
    register_sqlite(spark)
    con = sqlite3.connect(path)
    names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]
    con.close()
    for n in names:
        spark.read.format("sqlite").option("path", path).option("table", n).load().createOrReplaceTempView(n)
    return names
