"""Catalog and profiling (C1-C7) and SQL pass-through.

Catalog facts are metadata (table and column names), bounded by the catalog;
they are built as small DataFrames.  Sample rows are a sorted top-n per table
(``orderBy().limit()`` plans a TakeOrderedAndProject, a partial top-n per
partition).
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import texts as TX

def catalog_tables(spark: SparkSession) -> DataFrame:
    """Names of the registered tables and views."""
    return spark.sql("SHOW TABLES").select(F.col("tableName").alias("table_name"))


def usable_tables(catalog: DataFrame, include: list[str] | None = None,
                  ignore: list[str] | None = None) -> DataFrame:
    """Include list wins, else all minus ignore, sorted.  Unknown names raise."""
    spark = catalog.sparkSession
    known = {r[0] for r in catalog.collect()}  # catalog names only, bounded by the catalog
    for label, names in (("include_tables", include), ("ignore_tables", ignore)):
        missing = set(names or []) - known
        if missing:
            raise ValueError(f"{label} {sorted(missing)} not found in database")
    if include:
        keep = spark.createDataFrame([(t,) for t in include], "table_name string")
        return catalog.join(keep, "table_name", "left_semi").orderBy("table_name")
    drop = spark.createDataFrame([(t,) for t in (ignore or [])], "table_name string")
    return catalog.join(drop, "table_name", "left_anti").orderBy("table_name")


def schema_ddl(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """``CREATE TABLE t (col type, ..);`` from each DataFrame schema (no data read)."""
    rows = []
    for name, df in tables.items():
        cols = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        rows.append((name, f"CREATE TABLE {name} ({cols});"))
    return spark.createDataFrame(rows, "table_name string, ddl string")


def _cell(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        return F.concat(F.lit("["), F.array_join(F.transform(F.col(name), lambda x: x.cast("decimal(38,6)").cast("string")), ", "), F.lit("]"))
    return F.col(name).cast("string")


def sample_rows(tables: dict[str, DataFrame], n: int = 3) -> DataFrame:
    """C4: first ``n`` rows per table ordered by all columns, tab-separated (rn from 1).

    The first column alone is scanned for its n-th smallest value (one scalar per table); the rows up to it are
    then read, a filter that the scan gets.  Numbers inside arrays are written with six decimals.
    """
    parts = []
    for name, df in tables.items():
        cols = df.columns
        key = F.col(cols[0])
        last = df.select(key).where(key.isNotNull()).orderBy(key).limit(n).agg(F.max(key), F.count("*")).first()
        near = df.where(key.isNull() | (key <= F.lit(last[0]))) if last[1] == n else df  # nulls come first
        top = near.orderBy(*cols).limit(n)
        line = F.concat_ws("\t", *[F.coalesce(_cell(c, df.schema[c].dataType), F.lit("None")) for c in cols])
        parts.append(top.select(F.lit(name).alias("table_name"), line.alias("line")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    from pyspark.sql import Window
    w = Window.partitionBy("table_name").orderBy("line")
    return out.select("table_name", F.row_number().over(w).alias("rn"), "line")


def table_profile(spark: SparkSession, tables: dict[str, DataFrame], n: int = 3) -> DataFrame:
    """DDL plus a comment block with the header and ``n`` sample rows per table."""
    ddl = schema_ddl(spark, tables)
    header = spark.createDataFrame([(t, "\t".join(df.columns)) for t, df in tables.items()],
                                   "table_name string, header string")
    rows = sample_rows(tables, n).groupBy("table_name").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]), "\n").alias("rows"))
    return (ddl.join(header, "table_name").join(rows, "table_name", "left")
            .select("table_name", F.concat(
                "ddl", F.lit("\n\n/*\n"),
                F.format_string(TX.SAMPLE_ROWS_HEADER, F.lit(n), F.col("table_name")),
                "header", F.lit("\n"), F.coalesce("rows", F.lit("")), F.lit("\n*/")).alias("info")))


def table_info_lookup(requests: DataFrame, info: DataFrame) -> DataFrame:
    """Per request (qid, names as "a, b"), the joined info of the named tables, or
    an error text naming the unknown ones.  ``info``: table_name, info (catalog-bounded)."""
    r = requests.select("qid", F.posexplode(F.split("names", r",\s*")).alias("pos", "table_name"))
    j = r.join(info, "table_name", "left")
    per = j.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.when(F.col("info").isNull(), F.col("table_name")))).alias("missing"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "info"))),
                                 lambda x: x["info"]), "\n\n").alias("found"))
    err = F.format_string(TX.UNKNOWN_TABLES,
                          F.array_join(F.transform("missing", lambda m: F.concat(F.lit("'"), m, F.lit("'"))), ", "))
    return per.select("qid", F.when(F.size("missing") > 0, err).otherwise(F.col("found")).alias("info"))


def run_sql(spark: SparkSession, command: str, fetch: str = "all") -> DataFrame:
    """Run Spark SQL; ``fetch="one"`` keeps one row."""
    df = spark.sql(command)
    return df.limit(1) if fetch == "one" else df


def by_position(df: DataFrame) -> DataFrame:
    """Columns named by position (c0, c1, ..), so that two of one name stay two."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def rows_as_strings(df: DataFrame) -> DataFrame:
    """Every cell as text, columns by position (c0, c1, ..), duplicates kept."""
    df = by_position(df)
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def timed(spark: SparkSession, command: str) -> DataFrame:
    """Run to completion on the no-op sink: query, seconds, ran, error, rows, bytes.

    rows and bytes (of all cells as text) are observed on the run itself; a statement that fails has
    neither, but its time and its error text.  The result never comes to the driver.
    """
    start = time.time()
    err, seen = None, {}
    try:
        df = by_position(run_sql(spark, command))
        size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
        metrics = Observation()
        df.observe(metrics, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).write.format("noop").mode("overwrite").save()
        seen = metrics.get
    except Exception as e:  # noqa: BLE001 - the error text is the result
        err = f"Error: {e}"
    return spark.createDataFrame([(command, time.time() - start, err is None, err, seen.get("rows"), seen.get("bytes"))],
                                 "query string, seconds double, ran boolean, error string, rows long, bytes long")


def parse_result_text(text: Column) -> Column:
    """A result given as text -> rows of cells: a JSON array of arrays, else one cell."""
    parsed = F.from_json(text, "array<array<string>>")
    return F.when(text.isNull(), F.lit(None).cast("array<array<string>>")).otherwise(
        F.coalesce(parsed, F.array(F.array(text))))
