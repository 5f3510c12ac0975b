import random

import pytest

from quarry.llm import jaccard_join, queries
from quarry.llm.components import components
from quarry.sources.tables import table

from .brute import near_duplicates
from .fixtures import docs, odd_texts, with_clashes


def copies(rng, n_groups=6, vocabulary=40):
    """Groups of texts with a few words changed, some of them close to the limit; many share passages."""
    words = [f"w{k}" for k in range(vocabulary)]
    passage = [rng.choice(words) for _ in range(30)]
    out = []
    for _ in range(n_groups):
        base = [rng.choice(words) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                w += passage
            if rng.random() < 0.3:
                w = w[:rng.randint(1, len(w))]
            out.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in w))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = copies(random.Random(seed)) + odd_texts(seed, 10)
    want = near_duplicates(list(enumerate(texts)))
    got = {r.id: (r.n_shingles, r.component) for r in jaccard_join.near_duplicates(with_clashes(docs(spark, texts))).collect()}
    assert got == want


def test_null_ids_and_repeated_rows(spark):
    texts = ["a b c d e f g h", "a b c d e f g h", "a b c d e f g h", None, "z"]
    rows = jaccard_join.near_duplicates(docs(spark, texts, ids=[7, 7, None, 4, None])).collect()
    assert sorted(((r.id, r.n_shingles, r.component) for r in rows), key=str) == sorted(
        [(7, 4, 7), (7, 4, 7), (None, 4, None), (4, 0, 4), (None, 1, None)], key=str)
    assert jaccard_join.near_duplicates(docs(spark, [])).count() == 0


def test_long_paths_of_links(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (200, 200)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}


def test_op8_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    want = near_duplicates([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_jaccard_join(spark, sf).collect()}
    assert got == want
