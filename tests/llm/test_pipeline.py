import random

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import line_quality

from .brute import base_counts, dedup_lines, near_duplicates, overlaps
from .fixtures import DOCS, docs, odd_texts

SF = "/root/testdata/sf0.001"


def cleaned(spark, rows):
    """Texts after the first stage: the lines' verdicts come from the rule, all else is plain."""
    lines = sorted({x for _, t in rows for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")})
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    good = {r.x for r in df.where(line_quality.line_passes(F.col("x"))).collect()}
    out = []
    for i, t in rows:
        kept = "\n".join(x for x in (t or "").split("\n") if not x.strip(" \t\n\x0b\x0c\r") or x in good)
        b, left = base_counts(t), base_counts(kept)["word_chars"]
        if not b["base_failed"] and 100 * (b["word_chars"] - left) <= 50 * b["word_chars"]:
            out.append((i, kept))
    return out


def plain(spark, rows, items):
    rows = cleaned(spark, rows)
    rows = [(i, t) for i, _, _, t in dedup_lines(rows)]
    groups = near_duplicates(rows)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    bad = {i for i, _ in overlaps(rows, items)}
    return {i: t for i, t in rows if i not in bad}


def test_equals_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = plain(spark, rows, items)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert set(got) == set(want)
    for i, t in want.items():
        assert got[i].ids == library.encode(t) and got[i].n_chars == len(t) and got[i].round_trip


def test_stages_keep_columns_and_take_odd_rows(spark):
    rng = random.Random(1)
    prose = " ".join(f"word{rng.randrange(300)}" + ("." if k % 8 == 7 else "") for k in range(90)) + "."
    texts = odd_texts(1, 5) + [prose, prose, prose]
    ids = list(range(len(texts)))
    ids[-1] = None
    df = docs(spark, texts, ids).withColumn("id", F.lit(1)).withColumn("row", F.lit("x")).withColumn("a.b", F.lit(2))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.columns == df.columns and [t for _, t in out.dtypes] == [t for _, t in df.dtypes]
        assert stage(spark, df.limit(0), SF).count() == 0
        left = {(r.doc_id, r.text) for r in out.collect()}
        assert (None, prose) in left and (ids[-3], prose) in left
    out = corpus_pipeline.STAGES[-1][1](spark, df, SF)
    assert out.count() == len(texts)


def test_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "sentence_pieces"]
    assert DOCS.names == ["doc_id", "text", "lang", "source", "n_chars"]
