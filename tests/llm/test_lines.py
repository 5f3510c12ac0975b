import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import line_dedup, line_quality, queries
from quarry.sources.tables import table

from .brute import base_counts, dedup_lines
from .fixtures import docs, odd_texts, with_clashes

SF = "/root/testdata/sf0.001"


def prose(rng, n):
    words = [f"word{k}" for k in range(400)]
    return " ".join(rng.choice(words) + ("." if k % 9 == 8 else "") for k in range(n)) + "."


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = odd_texts(1, 60) + ["a b c " * 30, "x y z q " * 9 + prose(rng, 80), prose(rng, 200), "same line here.\n" * 12]
    rows = {r.id: r for r in line_quality.judged(with_clashes(docs(spark, texts))).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        assert {c: rows[k][c] for c in base_counts(t)} == base_counts(t), t


def test_line_rules(spark):
    good = ["It ends here.", "Is it so?", "He said: \"yes.\"", "A first sentence. and no last mark", "Ends with a colon:"]
    bad = ["no mark at the end", "Home | News | Sport | More.", "BUY!! NOW!! IT!! IS!! CHEAP!!.", "All rights reserved.", "De%%% la### et*** un$$$.", "Click here."]
    df = spark.createDataFrame([(x, x in good) for x in good + bad], "line string, want boolean")
    assert [r.line for r in df.where(line_quality.line_passes(F.col("line")) != F.col("want")).collect()] == []


def test_boilerplate_phrase_in_a_clean_line(spark):
    rng = random.Random(5)
    good = ["Find it in the catalog in the hall.", "An analog input fails.", "They spread more seeds.", "We design up to ten.", "Relog in.",
            "© 2020 the committee wrote a report on the river and its banks.", prose(rng, 90) + " Our privacy policy is long. " + prose(rng, 90)]
    bad = ["Read more.", "Log in, sign up.", "© All rights reserved.", "Click here: terms of use.", "Copyright (c) Ann.", "Privacy policy | Cookie policy."]
    df = spark.createDataFrame([(x, x in good) for x in good + bad], "line string, want boolean")
    assert [r.line for r in df.where(line_quality.line_passes(F.col("line")) != F.col("want")).collect()] == []
    rows = line_quality.judged(docs(spark, [good[-1]])).collect()
    assert rows[0].kept and rows[0].cleaned == good[-1]


def test_sentences_of_many_scripts(spark):
    good = ["यह एक साफ़ वाक्य है।", "هل هذا سؤال؟", "یہ ایک جملہ ہے۔", "これは文です。次の文です", "「これは文です。」", "ይህ ዓረፍተ ነገር ነው።", "Սա նախադասություն է։", "C# is nice.",
            "割合は50%で増加率は20%である。", "A 10% rise & more was seen last year in the north of it."]
    bad = ["यह वाक्य नहीं", "これは題名", "###%%%。", "Home ›› News ›› Sport। Last", "50% 20% $5 #1."]
    df = spark.createDataFrame([(x, x in good) for x in good + bad], "line string, want boolean")
    assert [r.line for r in df.where(line_quality.line_passes(F.col("line")) != F.col("want")).collect()] == []
    rng = random.Random(4)
    words = ["".join(rng.choice("कखगचजटडतदनपबमयरलवसह") for _ in range(4)) for _ in range(300)]
    prose = "\n".join(" ".join(rng.choice(words) for _ in range(9)) + "।" for _ in range(12))
    assert line_quality.judged(docs(spark, [prose])).first().kept


def test_twin_states_the_rules(spark):
    """The DuckDB twin and the operator on lines that the given tables do not have."""
    import duckdb

    from quarry.llm.oracle import OP2
    lines = ["Read more.", "Log in, sign up.", "© All rights reserved.", "Copyright (c) Ann.", "Find it in the catalog in the hall.", "यह साफ़ है।", "C# is nice.", "De%%% la### et***.",
             "これは文です。次", "no mark", "a | b | c | d.", "Privacy policy | Cookie policy.", "Relog in."]
    texts = ["\n".join(lines[k:] + lines[:k]) + "\n" + prose(random.Random(k), 60 * (k % 3)) for k in range(len(lines))]
    rows = [(k, t) for k, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = ["doc_id", "n_bad_lines", "kept_chars", "kept"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({OP2})").fetchall()
    got = line_quality.judged(docs(spark, texts)).select(F.col("id").alias("doc_id"), *names[1:]).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_verdict_on_lost_text(spark):
    rng = random.Random(3)
    clean = prose(rng, 100)
    texts = [clean, clean + "\nHome | News | Sport | More", clean + "\n" + " ".join(["buy"] + [f"thing{k}" for k in range(150)]), prose(rng, 20), None]
    rows = {r.id: r for r in line_quality.judged(docs(spark, texts)).collect()}
    assert [rows[k].kept for k in range(5)] == [True, True, False, False, False]
    assert rows[1].cleaned == clean and rows[1].n_bad_lines == 1
    assert line_quality.judged(docs(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = ["Shared line number %d" % k for k in range(6)] + ["short", "", "  Shared LINE number 1\t", "ÉÀ shared line", "éà shared line", "123456789", "1234567890"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9))) for _ in range(40)] + odd_texts(seed, 20)
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[5] = None
    rows = list(zip(ids, texts))
    rows += [rows[0], rows[7], (ids[8], "Shared line number 1\nother text of the same id")]
    got = line_dedup.dedup_lines(with_clashes(docs(spark, [t for _, t in rows], [i for i, _ in rows]))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(dedup_lines(rows), key=str)


def test_dedup_threshold(spark):
    texts = ["a shared line", "a shared line", "a shared line", "another shared line", "another shared line"]
    got = line_dedup.dedup_lines(docs(spark, texts), max_docs=2).collect()
    assert sorted((r.id, r.n_dropped) for r in got) == [(0, 0), (1, 1), (2, 1), (3, 0), (4, 0)]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_carried_columns(spark):
    df = with_clashes(docs(spark, ["one line of text", "one line of text"]))
    out = line_dedup.dedup_lines(df, carry=True)
    assert set(out.select("row.*").columns) == set(df.columns) - {"doc_id", "text"}


def test_queries_on_documents(spark):
    texts = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    rows = {r.doc_id: r for r in queries.op2_line_quality(spark, SF).collect()}
    assert all({c: rows[i][c] for c in base_counts(t)} == base_counts(t) for i, t in texts)
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert all(rows[i].kept for i, q in labels.items() if q == 1 and not rows[i].base_failed)
    want = {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in dedup_lines(texts)}
    assert {tuple(r) for r in queries.op3_line_dedup(spark, SF).collect()} == want
