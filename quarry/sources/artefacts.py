"""Artefact sources and sinks (S3, S5-S14) with explicit schemas."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

SPEC_SCHEMA = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("db_id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("evidence", T.StringType()),
    T.StructField("SQL", T.StringType()),
    T.StructField("difficulty", T.StringType()),
])

RUN_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("experiment", T.StringType()),
    T.StructField("llm", T.StringType()),
    T.StructField("execution_status", T.StringType()),
    T.StructField("total_time", T.DoubleType()),
    T.StructField("spark_time", T.DoubleType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("accuracy", T.DoubleType()),
])

DEFAULT_DIFFICULTY = "unknown"


def dates_as_string(df: DataFrame) -> DataFrame:
    """S3: date and timestamp columns as text (the loader's override of date-like types)."""
    date_types = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return df.select(*[F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, date_types)
                       else F.col(f.name) for f in df.schema.fields])


def date_like(declared: str | None) -> bool:
    """S3 rule on a declared SQL type: upper-case, cut at '(', member of DATE / DATETIME / TIMESTAMP."""
    t = (declared or "TEXT").upper().split("(")[0]
    return t in {"DATE", "DATETIME", "TIMESTAMP"}


def write_spec(items: DataFrame, path: str) -> None:
    """Benchmark items as JSON lines (overwrite: idempotent)."""
    items.select(*[F.col(f.name).cast(f.dataType) for f in SPEC_SCHEMA.fields]).write.mode("overwrite").json(path)


def read_spec(spark: SparkSession, path: str, db_id: str | None = None, multi_line: bool = False) -> DataFrame:
    """Scan benchmark JSON with the explicit schema; keep one database.

    ``multi_line``: the file is one JSON array, as benchmarks are published; else one object per line.  Text
    that is neither raises: a wrong choice must not read as an empty table.
    """
    df = spark.read.schema(SPEC_SCHEMA).option("multiLine", multi_line).option("mode", "FAILFAST").json(path)
    df = df.withColumn("difficulty", F.coalesce("difficulty", F.lit(DEFAULT_DIFFICULTY)))
    return df.where(F.col("db_id") == db_id) if db_id is not None else df


def lookup(spec: DataFrame, keys: DataFrame, with_db: bool = False) -> DataFrame:
    """S6 / S6b as a batch join: question + " " + evidence, gold SQL, difficulty per key.

    ``keys``: question_id (and db_id when ``with_db``).  Absent ids simply have no row.
    """
    on = ["question_id", "db_id"] if with_db else ["question_id"]
    return (keys.join(spec, on).select(
        "question_id", F.concat_ws(" ", "question", F.coalesce("evidence", F.lit(""))).alias("text"),
        F.col("SQL").alias("sql"), "difficulty"))


def write_name(query_id=None, iteration: int = 1) -> str:
    """The default name of a write: time, query id, iteration and eight random characters."""
    return f"{datetime.datetime.now():%Y%m%d_%H%M%S}_ID_{query_id}_ITER_{iteration}_{uuid.uuid4().hex[:8]}"


def as_variant(c: Column, kind: T.DataType) -> Column:
    """A column of any type as VARIANT: nested ones field by field, others as they are."""
    return F.call_function("to_variant_object", c) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else c.cast("variant")


def merged_json(df: DataFrame, extra: str | None = None) -> Column:
    """Each row as one JSON object; ``extra`` (a column map<string, variant>) adds fields of any kind, and replaces those of its names."""
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name != extra}
    known = F.map_from_arrays(F.array(*[F.lit(c) for c in kinds]), F.array(*[as_variant(df[f"`{c}`"], k) for c, k in kinds.items()]))
    if extra is None:
        return F.to_json(known)
    more = F.coalesce(extra, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
    return F.to_json(F.map_concat(F.map_filter(known, lambda k, v: ~F.map_contains_key(more, k)), more))


def write_runs(runs: DataFrame, path: str, write: str | None = None, extra: str | None = None) -> bool:
    """Records as JSON lines, all fields and those of ``extra``, one folder per write and experiment; whether this call added it.

    A write is a folder that appears under its name by one rename, when all of it is
    written: a failed task that runs again, or a job that is given up, leaves no rows.  A write whose name is
    there already adds nothing, so a caller that does not know whether its write succeeded may
    repeat it under the same name.  Without a name each call is a write of its own.
    """
    spark = runs.sparkSession
    name = write or write_name()
    if files.exists(spark, f"{path}/write={name}"):
        return False
    staged = f"{path}/_staged/{uuid.uuid4().hex}"
    by = ["experiment"] if "experiment" in runs.columns else []
    runs.select(merged_json(runs, extra).alias("value"), *by).write.partitionBy(*by).text(staged)
    if files.rename(spark, staged, f"{path}/write={name}"):
        return True
    files.delete(spark, staged)
    return False


def read_runs(spark: SparkSession, path: str, schema: T.StructType = RUN_SCHEMA) -> DataFrame:
    """What ``write_runs`` committed: the schema's columns, write, and the whole record as VARIANT, unknown fields included."""
    rows = spark.read.option("basePath", path).schema("value string, write string").text(f"{path}/write=*")
    return _records(rows.select("write", F.col("value").alias("text")), schema)


def _records(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``text`` (one JSON object each) as the schema's columns and ``record``; text that is no JSON raises."""
    typed = F.from_json("text", schema, {"mode": "FAILFAST"})
    rows = rows.select("*", typed.alias("typed"), F.parse_json("text").alias("record"))
    return rows.select(*[F.col(f"typed.`{f.name}`").alias(f.name) for f in schema.fields], *[c for c in rows.columns if c not in ("text", "typed", "record")], "record")


def read_run_logs(spark: SparkSession, path: str | list[str], multi_line: bool = True, schema: T.StructType = RUN_SCHEMA) -> DataFrame:
    """Run logs in either shape: ``{summary_metrics, detailed_queries[]}`` or a bare list (or a bare object).

    Columns: the schema's, and ``record``, the whole run as VARIANT, so that fields of no schema stay.
    ``multi_line``: a file is one JSON value; else each line is one.  The wrong choice raises, as does text that is
    no JSON; blank lines and files are no runs.
    """
    text = F.col("value")
    rows = spark.read.text(path, wholetext=multi_line).where(text.rlike(r"\S"))
    if multi_line:
        first = F.regexp_extract(text, r"^\s*([\[{][^\n]*)\n\s*\S", 1)
        several = (first != "") & F.try_parse_json(first).isNotNull()
        rows = rows.select(F.when(several, F.raise_error(F.lit("the file holds one JSON value a line: read it with multi_line=False"))).otherwise(text).alias("value"))
    fail = {"mode": "FAILFAST"}
    runs_of = F.when(text.rlike(r"^\s*\["), F.from_json(text, "array<string>", fail)).otherwise(
        F.coalesce(F.from_json(text, "detailed_queries array<string>", fail)["detailed_queries"], F.array(text)))
    return _records(rows.select(F.explode(runs_of).alias("text")), schema)


def graph_node_link(nodes: DataFrame, columns: DataFrame, operations: DataFrame,
                    aggregations: DataFrame, predicates: DataFrame, samples: DataFrame,
                    edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node-link export: one JSON object per node and per edge (maps only at the sink)."""
    def as_map(df, k, v, name):
        return df.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, v)))).alias(name))
    s = samples.groupBy("id", "column").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))),
                                                        lambda x: x["value"]).alias("vals"))
    n = (nodes.join(as_map(columns, "column", "freq", "columns_freq"), "id", "left")
         .join(as_map(operations, "key", "freq", "operations_freq"), "id", "left")
         .join(as_map(aggregations, "key", "freq", "aggregations_freq"), "id", "left")
         .join(as_map(predicates, "column", "freq", "predicates_freq"), "id", "left")
         .join(as_map(s, "column", "vals", "sample_values"), "id", "left"))
    node_json = n.select("id", F.to_json(F.struct(*n.columns)).alias("json"))
    conds = edges.groupBy("source", "target").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("condition", "freq")))).alias("conditions"),
        F.max("weight").alias("weight"), F.max(F.when(F.col("is_main"), F.col("condition"))).alias("condition"))
    edge_json = conds.select("source", "target", F.to_json(F.struct(*conds.columns)).alias("json"))
    return node_json, edge_json


NODE_SCHEMA = ("id string, columns_freq map<string,bigint>, operations_freq map<string,bigint>, aggregations_freq map<string,bigint>, "
               "predicates_freq map<string,bigint>, sample_values map<string,array<string>>")
EDGE_SCHEMA = "source string, target string, conditions map<string,bigint>, weight bigint, condition string"


def write_node_link(node_json: DataFrame, edge_json: DataFrame, path: str) -> None:
    """The export of ``graph_node_link`` as JSON lines, nodes and edges in folders of their own."""
    node_json.select("json").write.text(f"{path}/nodes")
    edge_json.select("json").write.text(f"{path}/links")


def read_node_link(spark: SparkSession, path: str | None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a stored graph; an empty graph where none was stored (``path`` is None)."""
    if path is None:
        return spark.createDataFrame([], NODE_SCHEMA), spark.createDataFrame([], EDGE_SCHEMA)
    return tuple(spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/{part}")
                 for part, schema in (("nodes", NODE_SCHEMA), ("links", EDGE_SCHEMA)))
