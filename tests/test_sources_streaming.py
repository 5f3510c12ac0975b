"""Sources and sinks: SQLite data source, benchmark JSON, run logs in two shapes, streaming summary."""

import json
import os
import sqlite3
import time

from pyspark.sql import functions as F

from quarry.sources import artefacts as S
from quarry.sources.jdbc import load_sqlite_tables
from quarry.streaming import runs as RS


def test_sqlite_source_partitions_and_date_override(spark, tmpdir_run):
    path = os.path.join(tmpdir_run, "db.sqlite")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE molecule (id INTEGER, label TEXT, weight REAL, made DATETIME)")
    con.executemany("INSERT INTO molecule VALUES (?, ?, ?, ?)",
                    [(i, f"m{i}", i * 1.5, f"2024-01-{(i % 28) + 1:02d}") for i in range(100)])
    con.commit()
    con.close()
    names = load_sqlite_tables(spark, path)
    assert names == ["molecule"]
    df = spark.table("molecule")
    assert dict(df.dtypes) == {"id": "bigint", "label": "string", "weight": "double", "made": "string"}
    assert df.rdd.getNumPartitions() >= 2
    r = spark.sql("SELECT count(*) AS n, sum(id) AS s FROM molecule WHERE weight > 30").first()
    assert (r["n"], r["s"]) == (79, sum(range(21, 100)))


def test_spec_roundtrip_and_lookup(spark, tmpdir_run):
    items = spark.createDataFrame(
        [(195, "chemistry", "How many atoms?", "atoms are rows", "SELECT 1", None),
         (196, "chemistry", "Which bond?", None, "SELECT 2", "simple"),
         (197, "other", "x", None, "SELECT 3", "simple")],
        "question_id long, db_id string, question string, evidence string, SQL string, difficulty string")
    S.write_spec(items, os.path.join(tmpdir_run, "spec"))
    spec = S.read_spec(spark, os.path.join(tmpdir_run, "spec"), "chemistry")
    assert sorted(r["question_id"] for r in spec.collect()) == [195, 196]
    keys = spark.createDataFrame([(195,), (196,), (999,)], "question_id long")
    got = {r["question_id"]: (r["text"], r["difficulty"]) for r in S.lookup(spec, keys).collect()}
    assert got == {195: ("How many atoms? atoms are rows", "unknown"), 196: ("Which bond? ", "simple")}


def test_run_logs_in_both_shapes(spark, tmpdir_run):
    a = {"summary_metrics": {"experiment": "e"}, "detailed_queries": [
        {"query_id": 1, "experiment": "vector", "execution_status": "VALID", "accuracy": 1.0},
        {"query_id": 2, "experiment": "vector", "execution_status": "ERROR", "accuracy": 0.0}]}
    b = [{"query_id": 3, "experiment": "graph", "execution_status": "VALID", "accuracy": 0.0}]
    os.makedirs(os.path.join(tmpdir_run, "logs"))
    with open(os.path.join(tmpdir_run, "logs", "a.json"), "w") as f:
        json.dump(a, f)
    with open(os.path.join(tmpdir_run, "logs", "b.json"), "w") as f:
        json.dump(b, f)
    got = sorted(r["query_id"] for r in S.read_run_logs(spark, os.path.join(tmpdir_run, "logs")).collect())
    assert got == [1, 2, 3]


def test_streaming_summary(spark, tmpdir_run):
    src = os.path.join(tmpdir_run, "runs")
    rows = [(i, "vector" if i % 2 else "graph", "VALID" if i % 3 else "ERROR", 1.0, 10, 5) for i in range(30)]
    df = spark.createDataFrame(rows, "query_id long, experiment string, execution_status string, "
                                     "accuracy double, input_tokens long, output_tokens long")
    df.write.mode("overwrite").json(src)
    q = RS.start_summary(spark, src, os.path.join(tmpdir_run, "ckpt"), query_name="summary_test")
    try:
        q.processAllAvailable()
        got = {r["experiment"]: r["evaluated_queries"] for r in spark.sql("SELECT * FROM summary_test").collect()}
        assert got == {"vector": 15, "graph": 15}
    finally:
        q.stop()
