"""Schema linking (L1-L5) and context assembly (K1-K6).

Schema metadata (tables, columns, samples) is joined to the questions without
hints.  Text is assembled with format_string
and ordered array_join over bounded groups (k hits, a question's tables).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts as TX
from . import navigate as N

# Router texts and context templates.
FENCE_RE = r"```json|```"
LINK_TOKEN_RE = r"[a-z0-9]+"


def schema_metadata(columns: DataFrame, samples: DataFrame) -> DataFrame:
    """L1: per table, its columns (by name), the columns that have samples, and their sample values as a map of lists."""
    vals = samples.groupBy("id", "column").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda x: x["value"]).alias("vals"))
    c = columns.select("id", "column").join(vals, ["id", "column"], "left")
    sampled = F.array_sort(F.collect_list(F.when(F.col("vals").isNotNull(), F.struct("column", "vals"))))
    out = c.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("column")), ",").alias("columns"), sampled.alias("sampled"))
    return out.select("id", "columns", F.array_join(F.transform("sampled", lambda x: x["column"]), ",").alias("sample_columns"),
                      F.map_from_entries("sampled").alias("samples"))


def router_context(columns: DataFrame, samples: DataFrame, available: DataFrame) -> DataFrame:
    """L2: per available table, JSON of column -> "Examples: [...]" or the no-example text."""
    vals = samples.groupBy("id", "column").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rn", "value"))),
        lambda x: F.concat(F.lit("'"), x["value"], F.lit("'"))), ", ").alias("vals"))
    c = (columns.select("id", "column").join(available.select(F.col("table").alias("id")), "id", "left_semi")
         .join(vals, ["id", "column"], "left")
         .withColumn("text", F.when(F.col("vals").isNotNull(), F.format_string(TX.ROUTER_EXAMPLES, "vals"))
                     .otherwise(F.lit(TX.NO_EXAMPLES))))
    return c.groupBy("id").agg(F.to_json(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("column", "text"))))).alias("router_json"))


def _quoted(c: Column) -> Column:
    """A text as a JSON string."""
    listed = F.to_json(F.array(c))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def router_schema(columns: DataFrame, samples: DataFrame, available: DataFrame) -> DataFrame:
    """L2: one row, the schema text that the router is given: indented JSON of the available tables, their columns and examples.

    Where the graph has none of the available tables, their list instead.  One text by definition, as long as the catalog.
    """
    known = columns.select("id", "column").join(available.select(F.col("table").alias("id")), "id", "left_semi")
    vals = samples.groupBy("id", "column").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda x: F.concat(F.lit("'"), x["value"], F.lit("'"))), ", ").alias("vals"))
    text = F.when(F.col("vals").isNotNull(), F.format_string(TX.ROUTER_EXAMPLES, "vals")).otherwise(F.lit(TX.NO_EXAMPLES))
    line = known.join(vals, ["id", "column"], "left").select("id", "column", F.concat(F.lit("    "), _quoted(F.col("column")), F.lit(": "), _quoted(text)).alias("line"))
    joined = lambda c, key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, c))), lambda x: x[c]), ",\n")
    tables = line.groupBy("id").agg(joined("line", "column").alias("lines"))
    tables = tables.select("id", F.concat(F.lit("  "), _quoted(F.col("id")), F.lit(": {\n"), F.col("lines"), F.lit("\n  }")).alias("block"))
    whole = tables.agg(F.count(F.lit(1)).alias("n"), joined("block", "id").alias("blocks"))
    names = available.agg(F.array_join(F.transform(F.array_sort(F.collect_list("table")), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", ").alias("names"))
    return whole.join(names).select(F.when(F.col("n") > 0, F.concat(F.lit("{\n"), "blocks", F.lit("\n}"))).otherwise(
        F.concat(F.lit("["), "names", F.lit("]"))).alias("schema_context"))


def parse_table_list(response: Column, available: list[str]) -> Column:
    """L3: strip code fences, parse a JSON array, keep available tables; bad JSON -> []."""
    txt = F.trim(F.regexp_replace(F.trim(response), FENCE_RE, ""))
    arr = F.from_json(txt, "array<string>")
    avail = F.array(*[F.lit(t) for t in available])
    return F.coalesce(F.filter(arr, lambda t: F.array_contains(avail, t)), F.array().cast("array<string>"))


def linked_samples(linked: DataFrame, samples: DataFrame) -> DataFrame:
    """L4: sample values of the selected tables only (qid, id, column, value, rn)."""
    return linked.select("qid", F.col("table").alias("id")).join(samples, "id")


def metadata_tokens(columns: DataFrame, samples: DataFrame) -> DataFrame:
    """Tokens naming each table: its name, its column names, its sample values, of any length."""
    def toks(c: Column) -> Column:
        return F.explode(F.regexp_extract_all(F.lower(c), F.lit(LINK_TOKEN_RE), F.lit(0)))
    t = (columns.select("id", toks(F.col("id")).alias("token"))
         .unionByName(columns.select("id", toks(F.col("column")).alias("token")))
         .unionByName(samples.select("id", toks(F.col("value")).alias("token"))))
    return t.distinct()


def lexical_link(questions: DataFrame, meta_tokens: DataFrame) -> DataFrame:
    """Tables whose metadata tokens appear in the question, ranked by distinct hits.

    No hint: Spark broadcasts the token list only where it is small.
    """
    qt = questions.select("qid", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("question"), F.lit(LINK_TOKEN_RE), F.lit(0)))).alias("token"))
    hits = qt.join(meta_tokens, "token")
    per = hits.groupBy("qid", F.col("id").alias("table")).agg(F.count(F.lit(1)).alias("hits"))
    from pyspark.sql import Window
    w = Window.partitionBy("qid").orderBy(F.desc("hits"), "table")
    return per.withColumn("rank", F.row_number().over(w))


def v1_node_blocks(columns: DataFrame) -> DataFrame:
    """v1 metadata block per table: top columns with frequency, fixed filter line."""
    top = N.top_columns(columns).groupBy("id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "column", "freq"))),
        lambda x: F.format_string(TX.V1_TOP_COLUMN, x["column"], x["freq"])), ", ").alias("top"))
    return top.select("id", F.concat(
        F.format_string(TX.TABLE_LINE, "id"),
        F.when(F.col("top").isNotNull(), F.format_string(TX.V1_TOP_COLUMNS, "top"))
        .otherwise(F.lit(TX.V1_NO_COLUMNS)),
        F.lit(TX.V1_NO_FILTERS)).alias("block"))


def v1_graph_context(valid: DataFrame, best: DataFrame, rules: DataFrame, blocks: DataFrame,
                     all_ids: DataFrame) -> DataFrame:
    """K3 graph part (v1 navigator): join section + metadata of the relevant tables.

    ``valid``: qid, table_pos, table.  Relevant tables: nodes of the chosen
    paths; all valid tables when no rule was found; the table itself when single.
    ``all_ids``: every question id (questions without valid tables get the fixed text).
    """
    chosen = N.v1_paths(valid, best)
    qrules = N.join_rules(chosen, rules)
    n = valid.groupBy("qid").agg(F.count(F.lit(1)).alias("n_valid"))
    path_nodes = chosen.select("qid", F.explode("path").alias("table"))
    with_rules = qrules.select("qid")
    fallback = (valid.join(n.where("n_valid = 1"), "qid", "left_semi")
                .unionByName(valid.join(n.where("n_valid > 1"), "qid", "left_semi")
                             .join(with_rules, "qid", "left_anti"))
                .select("qid", "table"))
    relevant = path_nodes.join(with_rules, "qid", "left_semi").unionByName(fallback).distinct()
    meta = (relevant.join(blocks.withColumnRenamed("id", "table"), "table")
            .groupBy("qid").agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("table", "block"))), lambda x: x["block"]), "")
                .alias("meta")))
    join_text = (F.when(F.col("n_valid") == 1, F.lit(TX.SINGLE_TABLE))
                 .otherwise(F.concat(F.lit(TX.JOIN_HEADER),
                                     F.coalesce(F.concat("rules", F.lit("\n")), F.lit(TX.NO_PATHS)))))
    body = F.concat(join_text, F.lit(TX.METADATA_HEADER), F.coalesce("meta", F.lit("")))
    return (all_ids.select("qid").join(n, "qid", "left").join(qrules, "qid", "left").join(meta, "qid", "left")
            .select("qid", F.when(F.col("n_valid").isNull(), F.lit(TX.NO_VALID_TABLES)).otherwise(body)
                    .alias("graph_ctx")))


def hybrid1_text(vector_text: Column, graph_text: Column, question: Column) -> Column:
    """K4: vector and graph parts in one block, then the question."""
    return F.concat(F.lit(TX.HYBRID1_SEMANTIC), vector_text, F.lit(TX.HYBRID1_STRUCTURAL), graph_text,
                    F.lit(TX.HYBRID1_END), F.lit(TX.QUESTION_TAIL), question)


def entity_section(samples: DataFrame) -> DataFrame:
    """K5: per question, the entity-resolution lines of its linked tables (only if any)."""
    per_col = samples.groupBy("qid", "id", "column").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rn", "value"))),
        lambda x: F.concat(F.lit("'"), x["value"], F.lit("'"))), ", ").alias("vals"))
    per_tab = per_col.groupBy("qid", "id").agg(F.array_join(F.array_sort(F.collect_list(F.struct(
        "column", F.format_string(TX.HYBRID2_ENTITY_COLUMN, "column", "vals")
        .alias("l")))).getField("l"), "").alias("lines"))
    return per_tab.groupBy("qid").agg(F.concat(
        F.lit(TX.HYBRID2_ENTITIES),
        F.array_join(F.array_sort(F.collect_list(F.struct(
            "id", F.concat(F.format_string(TX.HYBRID2_ENTITY_TABLE, "id"), "lines").alias("t")))).getField("t"), ""),
        F.lit("\n")).alias("entities"))


def hybrid2_text(instructions: str, vector_text: Column, entities: Column, graph_text: Column,
                 question: Column) -> Column:
    """K5: instructions, examples, entity samples (only if any), graph rules, question."""
    return F.concat(F.lit(instructions), F.lit(TX.HYBRID2_SEMANTIC), vector_text,
                    F.lit("\n\n"), F.coalesce(entities, F.lit("")),
                    F.lit(TX.HYBRID2_STRUCTURAL), graph_text, F.lit("\n\n"),
                    F.lit(TX.HYBRID2_QUESTION), question, F.lit("\n\n"))
