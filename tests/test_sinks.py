"""Sinks and collections: what a failed, repeated or concurrent write leaves behind."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quarry.sources import artefacts as S
from quarry.sources import collections as VC
from quarry.sources import files

RUN = "query_id long, experiment string, llm string, total_time double"


def runs(spark, n=6):
    return spark.range(n).select(F.col("id").alias("query_id"), F.concat(F.lit("e"), F.col("id") % 2).alias("experiment"), F.lit("google").alias("llm"),
                                 (F.col("id") / 2).alias("total_time"))


def test_repeated_write_adds_nothing(spark, tmpdir_run):
    path = os.path.join(tmpdir_run, "runs")
    assert S.write_runs(runs(spark), path, "w1") and not S.write_runs(runs(spark), path, "w1")
    assert S.write_runs(runs(spark, 2), path) and S.write_runs(runs(spark, 2), path)
    got = S.read_runs(spark, path)
    assert sorted(r.query_id for r in got.collect()) == sorted([*range(6), 0, 1, 0, 1])
    assert got.where("write = 'w1'").count() == 6 and got.select("write").distinct().count() == 3


def test_failed_task_and_failed_job_leave_one_copy(spark, tmpdir_run):
    path, once = os.path.join(tmpdir_run, "runs"), os.path.join(tmpdir_run, "tried")

    def fail(batches):
        for b in batches:
            yield b
        if not os.path.exists(once):
            open(once, "w").close()
            raise RuntimeError("lost after its rows were written")

    broken = runs(spark, 400).repartition(4).mapInArrow(fail, RUN)
    with pytest.raises(Exception, match="lost after"):
        S.write_runs(broken, path, "w1")
    assert not files.exists(spark, f"{path}/write=w1")
    assert S.write_runs(broken, path, "w1")
    assert sorted(r.query_id for r in S.read_runs(spark, path).collect()) == list(range(400))


def test_unknown_fields_survive(spark, tmpdir_run):
    extra = F.expr("map('note', cast('n' AS variant), 'llm', cast('other' AS variant), 'deep', to_variant_object(named_struct('a', array(1, 2))))")
    rows = runs(spark, 3).withColumn("more", F.when(F.col("query_id") > 0, extra)).withColumn("a.b", F.lit(5))
    path = os.path.join(tmpdir_run, "runs")
    S.write_runs(rows, path, "w", extra="more")
    got = {r.query_id: r for r in S.read_runs(spark, path).select(
        "query_id", "llm", F.variant_get("record", "$.note", "string").alias("note"), F.variant_get("record", "$.deep.a[1]", "int").alias("deep"),
        F.variant_get("record", "$['a.b']", "int").alias("ab")).collect()}
    assert tuple(got[0]) == (0, "google", None, None, 5) and tuple(got[2]) == (2, "other", "n", 2, 5)


def test_run_logs_keep_every_field_and_wrong_choices_raise(spark, tmpdir_run):
    whole, lines = os.path.join(tmpdir_run, "whole"), os.path.join(tmpdir_run, "lines")
    os.makedirs(whole), os.makedirs(lines)
    made = {"a.json": {"summary_metrics": {}, "detailed_queries": [{"query_id": 1, "accuracy": 1.0, "own": {"x": [3]}}]}, "b.json": [{"query_id": 2, "own": 4}],
            "c.json": {"query_id": 3}, "d.json": {"detailed_queries": []}}
    for name, value in made.items():
        with open(os.path.join(whole, name), "w") as f:
            json.dump(value, f, indent=2)
    with open(os.path.join(lines, "x.json"), "w") as f:
        f.write("\n".join(map(json.dumps, made.values())) + "\n\n")
    for path, multi in ((whole, True), (lines, False)):
        got = {r.query_id: r.own for r in S.read_run_logs(spark, path, multi).select("query_id", F.to_json(F.variant_get("record", "$.own", "variant")).alias("own")).collect()}
        assert got == {1: '{"x":[3]}', 2: "4", 3: None}
        with pytest.raises(Exception):
            S.read_run_logs(spark, path, not multi).collect()


def test_collection_inserts_by_id(spark, tmpdir_run):
    path, schema = os.path.join(tmpdir_run, "vectors"), "cid long, text string"
    rows = lambda *pairs: spark.createDataFrame(list(pairs), schema)
    assert VC.get_or_create(spark, path, schema).count() == 0
    assert VC.insert(spark, path, rows((1, "a"), (2, "b"), (2, "a"), (None, "x")), "cid") == 1
    assert VC.insert(spark, path, rows((1, "new"), (2, "b")), "cid") == 1
    assert VC.insert(spark, path, rows((2, "new"), (3, "c")), "cid") == 2
    assert {tuple(r) for r in VC.get_or_create(spark, path, schema).collect()} == {(1, "a"), (2, "a"), (3, "c")}
    assert {r.cid for r in VC.current(spark, path, 1).collect()} == {1, 2}
    assert len(files.names(spark, f"{path}/segments")) == 2


def test_late_writer_starts_over_and_a_lost_one_leaves_no_rows(spark, tmpdir_run, monkeypatch):
    path, schema = os.path.join(tmpdir_run, "vectors"), "cid long, text string"
    VC.get_or_create(spark, path, schema)
    plain, other = files.create, []

    def raced(session, at, text):
        if not other:  # another writer commits between this one's segment and its version
            other.append(1)
            VC.insert(spark, path, spark.createDataFrame([(1, "first"), (5, "five")], schema), "cid")
        return plain(session, at, text)

    monkeypatch.setattr(VC.files, "create", raced)
    assert VC.insert(spark, path, spark.createDataFrame([(1, "late"), (2, "two")], schema), "cid") == 2
    assert {tuple(r) for r in VC.current(spark, path).collect()} == {(1, "first"), (5, "five"), (2, "two")}

    def lost(*_):
        raise RuntimeError("writer lost")

    monkeypatch.setattr(VC.files, "create", lost)
    with pytest.raises(RuntimeError):
        VC.insert(spark, path, spark.createDataFrame([(9, "nine")], schema), "cid")
    assert VC.current(spark, path).count() == 3
