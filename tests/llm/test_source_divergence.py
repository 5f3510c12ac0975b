import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import queries
from quarry.llm import source_divergence as sd
from quarry.sources.tables import table

from .brute import LOW
from .fixtures import odd_texts, with_clashes

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def divergences(rows, min_docs=10, top=10):
    rows = [((lang or ""), (source or ""), TERM.findall((text or "").translate(LOW))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(s, w) for x, s, w in rows if x == lang]
        held = Counter(t for _, w in mine for t in set(w))
        kept = sorted(t for t in held if held[t] >= min_docs)
        groups = {s: Counter() for s, _ in mine} | {None: Counter()}
        for s, w in mine:
            for t in w:
                if held[t] >= min_docs:
                    groups[s][t] += 1
                    groups[None][t] += 1
        v = len(kept)
        p = {s: {t: 1 + 1000000000 * (c[t] + 2) // (sum(c.values()) + 2 * v) for t in kept} for s, c in groups.items()}
        f = lambda a, b: (a - b) * (a - b) // (a + b)
        for s in (g for g in groups if g is not None):
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o not in (None, s)]
            terms = [(t, f(p[s][t], p[None][t])) for t in kept if groups[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, n, k) for k, (i, n) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "The", "x_y", "été", "漢字", "a1b", "İst", "zz top"] + [f"{a}{b}" for a in "abcdefgh" for b in "klmnopé"]
    texts = odd_texts(seed, 20) + [" ".join(rng.choice(words[:rng.randint(5, len(words))]) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "s10", None, "é"]), t) for t in texts] + \
        [("xx", "only", "a word"), ("yy", "p", "no"), ("yy", "q", None), ("en", "mute", "1 2 3")]


def frame(spark, rows):
    return with_clashes(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string"))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    assert sorted(map(tuple, sd.audit(frame(spark, rows)).collect())) == divergences(rows)


def test_shards_blocks_and_flushes_change_nothing(spark, monkeypatch):
    rows = corpus(3)
    df = frame(spark, rows)
    monkeypatch.setattr(sd, "SHARD_ROWS", 20)
    got = sd.audit(df, min_docs=2, top=3).collect()
    assert sorted(map(tuple, got)) == divergences(rows, 2, 3)
    at, term, n = np.array([0, 1, 0, 2, 2]), np.array([0, 0, 2, 1, 4]), np.array([5, 7, 1, 9, 2])
    whole = sd._pair_sums(at, term, n, np.array([6, 7, 11]), 5, 5)
    monkeypatch.setattr(sd, "BLOCK_CELLS", 6)
    assert (sd._pair_sums(at, term, n, np.array([6, 7, 11]), 5, 5) == whole).all() and whole.any()


def test_partial_counts_are_flushed_in_parts(monkeypatch):
    import pyarrow as pa
    rows = [(lang or "", s or "", t or "") for lang, s, t in corpus(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "source", "text"])

    def total():
        n, held = Counter(), Counter()
        for part in sd._partial_counts([batch.slice(0, 70), batch.slice(70)]):
            for r in part.to_pylist():
                n[r["lang"], r["source"], r["term"]] += r["n"]
                held[r["lang"], r["source"], r["term"]] += r["docs"]
        return n, held

    whole = total()
    monkeypatch.setattr(sd, "HELD_ROWS", 50)
    monkeypatch.setattr(sd, "SLICE_BYTES", 100)  # longer texts are read in pieces now
    assert total() == whole
    want = Counter((lang, s, w) for lang, s, t in rows for w in TERM.findall(t.translate(LOW)))
    assert whole[0] == want


def test_share_is_exact():
    rng = random.Random(8)
    for _ in range(300):
        total, terms = rng.randint(0, 8 * 10 ** 15), rng.randint(1, 10 ** 9)
        count = rng.randint(0, total)
        assert sd.share(np.array([count]), np.array([total]), terms)[0] == 1 + 1000000000 * (count + 2) // (total + 2 * terms)


def test_empty_table_and_single_source(spark):
    assert sd.audit(frame(spark, [])).count() == 0
    one = sd.audit(frame(spark, [("en", "s", "a b c")] * 12)).collect()
    assert one == []  # one source: no pairs, and no term has a greater share than in the language


def test_long_text(spark):
    rows = [("en", "s", "word and " * 700_000), ("en", "t", "é" * 5_000_000 + " word")]
    got = sd.term_counts(frame(spark, rows)).collect()
    assert {(r.source, r.term[:5], r.n, r.docs) for r in got} == {("s", "word", 700_000, 1), ("s", "and", 700_000, 1), ("t", "ééééé", 1, 1), ("t", "word", 1, 1)}


def test_query_on_documents(spark):
    rows = [(r.lang, r.source, r.text) for r in table(spark, SF, "documents").collect()]
    assert sorted(map(tuple, queries.op13_source_divergence(spark, SF).collect())) == divergences(rows)
