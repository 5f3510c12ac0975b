"""Context assembly on literal fixtures (K3 fallback, K5 layout, S8 export)."""

import json
import random

from pyspark.sql import functions as F

from quarry.functions import texts as TX
from quarry.operators import linking as L
from quarry.operators import mining as W
from quarry.operators import navigate as N
from quarry.plans import context as CX
from quarry.plans import vectors as VQ
from quarry.plans import workload
from quarry.sources import adapters as A
from quarry.sources import artefacts as S


def _edges(spark):
    return spark.createDataFrame(
        [("a", "b", "a.k = b.k", 5, 5, True)],
        "source string, target string, condition string, freq long, weight long, is_main boolean")


def test_v1_graph_context_single_pair_and_fallback(spark):
    edges = _edges(spark)
    cols = spark.createDataFrame([("a", "k", 4), ("b", "k", 2), ("c", "x", 1)], "id string, column string, freq long")
    valid = spark.createDataFrame([(1, 1, "a"), (2, 1, "a"), (2, 2, "b"), (3, 1, "a"), (3, 2, "c")],
                                  "qid long, table_pos int, table string")
    ids = spark.createDataFrame([(1,), (2,), (3,), (4,)], "qid long")
    best = N.best_paths(N.paths(edges))
    ctx = {r["qid"]: r["graph_ctx"] for r in
           L.v1_graph_context(valid, best, N.edge_rules(edges), L.v1_node_blocks(cols), ids).collect()}
    assert ctx[1].startswith(TX.SINGLE_TABLE) and "Table: [a]" in ctx[1] and "Table: [b]" not in ctx[1]
    assert "- For joining a and b use: a.k = b.k" in ctx[2] and "k (freq: 4)" in ctx[2]
    # a and c are not connected: no rule, every valid table is listed (v1 fallback)
    assert TX.NO_PATHS in ctx[3] and "Table: [a]" in ctx[3] and "Table: [c]" in ctx[3]
    assert ctx[4] == TX.NO_VALID_TABLES


def test_entity_section_and_hybrid2_layout(spark):
    samples = spark.createDataFrame([(7, "a", "k", "1", 1), (7, "a", "k", "2", 2), (7, "b", "z", "x", 1)],
                                    "qid long, id string, column string, value string, rn int")
    ent = L.entity_section(samples).first()["entities"]
    assert ent == (TX.HYBRID2_ENTITIES + "Table [a]:\n  - Column 'k' matches categorical values: ['1', '2']\n"
                   "Table [b]:\n  - Column 'z' matches categorical values: ['x']\n\n")
    df = spark.createDataFrame([("V", "G", "Q?")], "v string, g string, q string")
    with_ent = df.select(L.hybrid2_text("I", F.col("v"), F.lit("E\n"), F.col("g"), F.col("q"))).first()[0]
    without = df.select(L.hybrid2_text("I", F.col("v"), F.lit(None).cast("string"), F.col("g"), F.col("q"))).first()[0]
    assert with_ent.startswith("I" + TX.HYBRID2_SEMANTIC + "V\n\nE\n" + TX.HYBRID2_STRUCTURAL + "G")
    assert "ENTITY" not in without and without.endswith(TX.HYBRID2_QUESTION + "Q?\n\n")


def test_graph_node_link_json(spark):
    edges = _edges(spark)
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    cols = spark.createDataFrame([("a", "k", 4)], "id string, column string, freq long")
    ops = spark.createDataFrame([("a", "WHERE", 2)], "id string, key string, freq long")
    preds = spark.createDataFrame([("a", "k", 1)], "id string, column string, freq long")
    samples = spark.createDataFrame([("a", "k", "1", 1)], "id string, column string, value string, rn int")
    n, e = S.graph_node_link(nodes, cols, ops, ops.limit(0), preds, samples, edges)
    node = {r["id"]: json.loads(r["json"]) for r in n.collect()}
    assert node["a"]["columns_freq"] == {"k": 4} and node["a"]["sample_values"] == {"k": ["1"]}
    edge = json.loads(e.first()["json"])
    assert edge["weight"] == 5 and edge["condition"] == "a.k = b.k" and edge["conditions"] == {"a.k = b.k": 5}


def test_contexts_read_only_the_items_statements(spark, tmpdir_run):
    """The log is larger than the benchmark: only the items' statements are joined, and what the strategies share is made once."""
    spark.range(500).select(F.col("id").alias("o_orderkey")).unionByName(spark.sql("SELECT 3L AS o_orderkey UNION ALL SELECT NULL")).write.parquet(f"{tmpdir_run}/orders.parquet")
    spark.createDataFrame([(3, "three"), (4, "four"), (900, "none"), (None, "null")], "item_id long, text string").write.parquet(f"{tmpdir_run}/benchmark.parquet")
    log = A.qlog(spark, tmpdir_run)
    asked = [r.query_id for r in A.qlog(spark, tmpdir_run, CX._item_ids(spark, tmpdir_run)).collect()]
    assert sorted(asked) == [3, 3, 4] and log.count() == 501
    m = workload.mined(spark, tmpdir_run)
    assert sorted(r.query_id for r in m.of(CX._item_ids(spark, tmpdir_run)).statements.collect()) == [3, 3, 4]
    assert m.templates.agg(F.sum("rows"), F.sum("known")).first() == (501, 501)
    docs = VQ.benchmark_docs(spark, tmpdir_run)
    assert sorted((str(r.cid), r.sql != "") for r in docs.collect()) == [("3", True), ("3", True), ("4", True), ("900", False), ("None", False)]
    assert VQ.vector_context(spark, tmpdir_run) is VQ.vector_context(spark, tmpdir_run)
    assert CX._item_valid(spark, tmpdir_run) is CX._item_valid(spark, tmpdir_run)


def test_chunks_of_words_and_signs(spark):
    """Statements are cut as by the plain pattern: a word or a run of signs at a time."""
    plain = f"{W.COMMENT_RE}|{W.LITERAL_RE}|{W.QUOTED_RE}|{W.NUMBER_RE}|{W.WORD_RE}|[^'\"`0-9/A-Za-z_-]++|(?s:.)"
    rng = random.Random(5)
    signs = ["'", '"', "`", "-", "--", "/", "/*", "*/", "a1", "_x$", "9", "1.5e-3", ".", " ", "  ", "\n", "\t", "$", "(", "=", "é", "\xa0", "٣", "''"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [" a" * 500 + "'x'" + "  b-" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "sql string")
    chunks = df.select("sql", *[F.regexp_extract_all("sql", F.lit(p), F.lit(0)).alias(n) for n, p in (("new", W.CHUNK_RE), ("old", plain))]).collect()
    kept = lambda cs: [c for c in cs if c[0] in "'0123456789\"`" or c[:2] in ("--", "/*")]
    assert all("".join(r.new) == r.sql and kept(r.new) == kept(r.old) for r in chunks)
