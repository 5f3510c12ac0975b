"""Property graph of the workload (G1-G11) as long DataFrames.

nodes:   (id, metric, key, freq)    metric in columns / operations / aggregations / predicates
edges:   (source, target, condition, freq, weight, is_main)
samples: (id, column, value, rn)

All rollups are algebraic (count / sum): statements are counted per template, and a
template's facts count that often.  Only join conditions that hold literals are read per
statement.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import mining as W


def normalize_condition(c: Column) -> Column:
    """Sort the sides of every equality, then sort the equalities."""
    eqs = F.split(c, " AND ")
    sides = F.transform(eqs, lambda e: F.array_join(
        F.array_sort(F.transform(F.split(e, "="), lambda x: F.trim(x))), " = "))
    return F.array_join(F.array_sort(sides), " AND ")


@dataclass
class Graph:
    nodes: DataFrame      # id
    columns: DataFrame    # id, column, freq
    operations: DataFrame  # id, key, freq (zero-filled)
    aggregations: DataFrame  # id, key, freq (zero-filled)
    predicates: DataFrame  # id, column, freq
    edges: DataFrame      # source, target, condition, freq, weight, is_main


def _is_node(table: Column) -> Column:
    return (table != "") & (F.lower(table) != "subquery")


def _node_ids(m: W.MinedLog) -> DataFrame:
    return m.templates.select(F.inline("tables")).where(_is_node(F.col("table"))).select(F.col("table").alias("id")).distinct()


def _facts_of_nodes(m: W.MinedLog, name: str) -> DataFrame:
    """Once per template, what its statements with an id say of their own tables; ``known`` is the number of these statements."""
    own = F.filter(name, lambda x: _is_node(x["table"]) & F.exists("tables", lambda t: t["table"] == x["table"]))
    return m.templates.where("known > 0").select("known", F.inline(own))


def column_freq(m: W.MinedLog) -> DataFrame:
    """Number of queries naming (table, column); unqualified only in one-table queries."""
    return (_facts_of_nodes(m, "columns").groupBy(F.col("table").alias("id"), "column")
            .agg(F.sum("known").alias("freq")))


def _zero_filled(spark: SparkSession, ids: DataFrame, facts: DataFrame, domain: list[str]) -> DataFrame:
    """Every node x every key of the fixed domain (a narrow explode), counts filled with 0."""
    full = ids.select("id", F.explode(F.array(*[F.lit(k) for k in domain])).alias("key"))
    return (full.join(facts, ["id", "key"], "left")
            .select("id", "key", F.coalesce("freq", F.lit(0)).cast("long").alias("freq")))


def operation_freq(m: W.MinedLog) -> DataFrame:
    """Operation counts summed per table (zero-filled)."""
    ops = (_facts_of_nodes(m, "operations").groupBy(F.col("table").alias("id"), F.col("op").alias("key"))
           .agg(F.sum(F.col("n") * F.col("known")).alias("freq")))
    return _zero_filled(m.facts.sparkSession, _node_ids(m), ops, W.OPERATIONS)


def aggregation_freq(m: W.MinedLog) -> DataFrame:
    """Aggregation counts summed per table (zero-filled)."""
    aggs = (_facts_of_nodes(m, "aggregations").groupBy(F.col("table").alias("id"), F.col("agg").alias("key"))
            .agg(F.sum(F.col("n") * F.col("known")).alias("freq")))
    return _zero_filled(m.facts.sparkSession, _node_ids(m), aggs, W.AGGREGATIONS)


def predicate_freq(m: W.MinedLog, columns: DataFrame | None = None) -> DataFrame:
    """G5 (D1): predicate frequency per table column, case-insensitive, column must be known."""
    columns = columns if columns is not None else column_freq(m)
    known = columns.select("id", F.lower("column").alias("column")).distinct()
    p = (_facts_of_nodes(m, "predicates").groupBy(F.col("table").alias("id"), "column")
         .agg(F.sum(F.col("n") * F.col("known")).alias("freq")))
    return p.join(known, ["id", "column"], "left_semi")


def edge_conditions(m: W.MinedLog) -> DataFrame:
    """Canonical edges with the histogram of normalised conditions."""
    sides = ("join_edges", "implicit_edges")
    own = lambda c, wanted: F.filter(c, lambda e: F.coalesce(e["condition"].contains(W.LITERAL), F.lit(False)) == wanted)
    # A condition without literals is the template's; only others are read per statement.
    alike = [m.templates.select(F.col("rows").alias("freq"), F.inline(own(c, False))) for c in sides]
    apart = m.templates.withColumns({c: own(c, True) for c in sides}).where(" OR ".join(f"size({c}) > 0" for c in sides))
    apart = W.MinedLog(m.statements, apart)
    each = W.join_edges(apart).unionByName(W.implicit_edges(apart)).withColumn("freq", F.lit(1).cast("long"))
    cols = ["source", "target", "condition", "freq"]
    e = alike[0].select(cols).unionByName(alike[1].select(cols)).unionByName(each.select(cols))
    e = e.where(F.col("source").isNotNull() & F.col("target").isNotNull()
                & (F.col("source") != "") & (F.col("target") != "")
                & (F.col("source") != F.col("target")))
    e = e.select(F.least("source", "target").alias("source"),
                 F.greatest("source", "target").alias("target"),
                 normalize_condition(F.col("condition")).alias("condition"), "freq")
    return e.groupBy("source", "target", "condition").agg(F.sum("freq").alias("freq"))


def edges(m: W.MinedLog) -> DataFrame:
    """weight = total frequency; main condition = most frequent, then name."""
    c = edge_conditions(m)
    pair = Window.partitionBy("source", "target")
    ranked = Window.partitionBy("source", "target").orderBy(F.desc("freq"), F.asc("condition"))
    return c.select("source", "target", "condition", "freq",
                    F.sum("freq").over(pair).alias("weight"),
                    (F.row_number().over(ranked) == 1).alias("is_main"))


def build(m: W.MinedLog) -> Graph:
    cols = column_freq(m)
    return Graph(nodes=_node_ids(m), columns=cols, operations=operation_freq(m),
                 aggregations=aggregation_freq(m), predicates=predicate_freq(m, cols),
                 edges=edges(m))


def nodes_long(g: Graph) -> DataFrame:
    """G1: every node with its zero-filled counters, long form (id, metric, key, freq)."""
    return (g.operations.select("id", F.lit("operations").alias("metric"), "key", "freq")
            .unionByName(g.aggregations.select("id", F.lit("aggregations").alias("metric"),
                                               "key", "freq")))


def _least(k: int):
    """Of each column of a task's batches the ``k`` smallest distinct values, as rows (no, value)."""
    def run(batches):
        best = None
        for b in batches:
            best = best or [pa.array([], pa.string())] * b.num_columns
            for i, col in enumerate(b.columns):
                near = col.drop_null() if len(best[i]) < k else col.filter(pc.less(col, best[i][-1]))
                if len(near):
                    best[i] = pa.concat_arrays([best[i], near]).unique().sort()[:k]
        for i, values in enumerate(best or []):
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(values), pa.int32()), values], names=["no", "value"])

    return run


def entity_samples(spark: SparkSession, columns: DataFrame, tables: dict[str, DataFrame],
                   k: int = 3) -> DataFrame:
    """Up to ``k`` distinct non-null values per (table, column), smallest first.

    Names are matched as the engine resolves them, whatever their case.  Of the graph's names only those
    that the catalog has come to the driver, to prune the scans.  A table is read once: a task keeps the ``k`` smallest
    values of each named column, and only these meet.
    """
    has = [(t, c.lower(), t, c) for t, df in tables.items() for c in df.columns]
    catalog = spark.createDataFrame(has, "table_key string, column_key string, table_name string, column_name string")
    wanted = columns.select("id", "column").distinct().join(
        catalog, (F.col("id") == F.col("table_key")) & (F.lower("column") == F.col("column_key"))).collect()  # at most the catalog's columns per spelling
    named: dict[str, dict[str, list[str]]] = {}
    for r in wanted:
        named.setdefault(r["table_name"], {}).setdefault(r["column_name"], []).append(r["column"])
    parts = []
    for name in sorted(named):
        cols = sorted(named[name])
        text = tables[name].select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
        values = F.slice(F.array_sort(F.collect_set("value")), 1, k)  # k values per task
        least = text.mapInArrow(_least(k), "no int, value string").groupBy("no").agg(values.alias("least"))
        spelled = F.array(*[F.array(*[F.lit(s) for s in sorted(named[name][c])]) for c in cols])
        each = least.select("least", F.explode(F.get(spelled, F.col("no"))).alias("column")).select("column", F.posexplode("least").alias("at", "value"))
        parts.append(each.select(F.lit(name).alias("id"), "column", "value", (F.col("at") + 1).alias("rn")))
    if not parts:
        return spark.createDataFrame([], "id string, column string, value string, rn int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stats(g: Graph) -> DataFrame:
    """Node count, edge count and sorted listings (the graph is one node per table)."""
    n = g.nodes.agg(F.count(F.lit(1)).alias("n_nodes"),
                    F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("node_list"))
    e = (g.edges.where("is_main")
         .agg(F.count(F.lit(1)).alias("n_edges"),
              F.array_join(F.array_sort(F.collect_list(
                  F.concat_ws(" -> ", "source", "target"))), ", ").alias("edge_list")))
    return n.crossJoin(e)
