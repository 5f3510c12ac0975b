import hashlib
import random

import pytest

from quarry.llm import queries, repeated_bytes
from quarry.sources.tables import table

from .brute import repeated_bytes as brute
from .fixtures import docs, odd_texts, with_clashes


def texts_with_passages(rng):
    alphabet = "abcdefgh é\n"
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randint(40, 160))) for _ in range(8)]
    out = []
    for _ in range(50):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
                p = p[a:b]
            parts += [p, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))]
        out.append("".join(parts))
    return out + ["a" * 49, "a" * 50, "a" * 51, "a" * 300, "ab" * 100, "b" + "ab" * 60, "=" * 120, "x" + "=" * 49, out[3], out[3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    texts = texts_with_passages(rng) + odd_texts(seed, 10)
    ids = list(range(0, 3 * len(texts), 3))
    rng.shuffle(ids)
    monkeypatch.setattr(repeated_bytes, "GROUP_BYTES", 700)  # many groups
    want = brute(list(zip(ids, texts)))
    got = {r.id: r for r in repeated_bytes.cut_repeats(with_clashes(docs(spark, texts, ids))).collect()}
    for i, t in zip(ids, texts):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == want[i]
        raw = (t or "").encode()
        assert sum(b - a for a, b in zip(r.starts, r.ends)) == r.n_removed and len(r.starts) == r.n_spans
        for a, b in reversed(list(zip(r.starts, r.ends))):
            raw = raw[:a] + raw[b:]
        assert raw == bytes(r.kept)


@pytest.mark.parametrize("piece", [1, 64, 100])
def test_pieces_hold_every_string_once(monkeypatch, piece):
    monkeypatch.setattr(repeated_bytes, "PIECE_BYTES", piece)
    for n in (0, 1, 49, 50, 51, 149, 150, 400):
        b = bytes(k % 251 for k in range(n))
        parts = list(repeated_bytes._pieces(b))
        assert [a + k for a, p in parts for k in range(len(p) - 49)] == list(range(max(0, n - 49)))
        assert all(b[a:a + len(p)] == p for a, p in parts)


def test_runs_depend_on_the_string_alone():
    """Cut anywhere, a string's pointer is the same, and its runs cover each string once."""
    rng = random.Random(4)
    text = bytes(rng.choice(b"abcd ") for _ in range(3000))
    pointer = {}
    for a, b in [(0, 3000), (17, 2900), (1000, 1500), (1400, 1449)]:
        block = repeated_bytes.Block([b"x" * 60, text[a:b], b"y" * 10])
        lo, n, h = block.runs()
        seen = [(p, x) for s, k, x in zip(lo.tolist(), n.tolist(), h.tolist()) for p in range(s, s + k) if s >= 60]
        assert [p for p, _ in seen] == list(range(60, 60 + max(0, b - a - 49)))
        for p, x in seen:
            assert pointer.setdefault(p - 60 + a, x) == x


def test_null_ids_and_rows_of_one_id(spark):
    p, q = "the passage that is repeated here has more than fifty bytes.", "another passage with more than fifty bytes, as the first has."
    rows = [(5, p), (5, p), (5, "x" + q), (None, p), (7, q + p), (9, "short"), (4, None)]
    got = repeated_bytes.cut_repeats(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert sorted(((r.id, r.n_bytes, r.n_removed) for r in got), key=str) == sorted(
        [(5, len(p), 0), (5, len(p), 0), (5, len(q) + 1, 0), (None, len(p), 0), (7, len(p + q), len(p + q)), (9, 5, 0), (4, 0, 0)], key=str)
    assert repeated_bytes.cut_repeats(docs(spark, [])).count() == 0


def test_op10_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    want = brute([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10_repeated_bytes(spark, sf).collect()} == want


def test_a_third_without_ids_is_not_dealt(spark):
    """Rows without id keep their text, take no part, and reach no group."""
    shared = "a passage of well over fifty bytes that several documents hold, word for word"
    texts = [shared + f" and {k}" for k in range(30)]
    df = docs(spark, texts, [None if k % 3 == 0 else k for k in range(30)])
    got = repeated_bytes.cut_repeats(df).collect()
    nulls = [r for r in got if r.id is None]
    assert len(got) == 30 and sorted(bytes(r.kept) for r in nulls) == sorted(t.encode() for t in texts[::3])
    assert all((r.n_removed, r.n_spans, r.starts, r.ends) == (0, 0, [], []) for r in nulls)
    assert {r.id for r in got if r.id is not None and not r.n_removed} == {1}
    only = repeated_bytes.cut_repeats(docs(spark, ["x" * 90, None, ""], [None, None, None])).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in only) == [(0, 0), (0, 0), (90, 0)]


def test_long_text_in_many_pieces(spark):
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(2_500_000))
    rows = [(1, long), (2, long[1_000_000:1_700_000] + "Z" * 60), (3, "q" * 40)]
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeated_bytes.cut_repeats(docs(spark, [t for _, t in rows], [i for i, _ in rows])).collect()}
    assert got == {1: (2_500_000, 0, 0), 2: (700_060, 700_000, 1), 3: (40, 0, 0)}
