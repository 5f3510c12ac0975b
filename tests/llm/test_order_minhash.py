import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import order_minhash as om
from quarry.llm import queries
from quarry.sources.tables import table

from .fixtures import docs, odd_texts, with_clashes

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain_fingerprint(text):
    """Every function's two least numbered k-mers, in text order."""
    if not text:
        return "0" * 512
    odd, width = 0x9E3779B97F4A7C15, min(8, len(text))
    kmers = []
    for p in range(len(text) - width + 1):
        h = width
        for c in text[p:p + width]:
            h = (h * odd + ord(c) + 1) & M
        kmers.append(mixed(h))
    seen, numbered = {}, []
    for h in kmers:
        numbered.append(mixed((h + seen.get(h, 0) * odd) & M) >> 32)
        seen[h] = seen.get(h, 0) + 1
    out = ""
    for i in range(1, 65):
        seed = mixed(i * odd & M)
        mask, factor = seed % (1 << 32), mixed(seed) | 1
        picked = heapq.nsmallest(2, [((v ^ mask) * factor % (1 << 32), p) for p, v in enumerate(numbered)])
        e = 0
        for p in sorted(p for _, p in picked):
            e = mixed((e * odd + kmers[p] + 1) & M)
        out += f"{e >> 32:08x}"
    return out


def same(a, b):
    return sum(a[k:k + 8] == b[k:k + 8] for k in range(0, 512, 8)) / 64


def compared(rows):
    """(id, n_chars, hash of the edited text, fingerprint, edited, likenesses) of rows (id, text) with distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), reverse=True)
    prints = {t: plain_fingerprint(t) for _, t in rows}
    out = []
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        cut = len(t) // 3
        edited = t[:len(t) - cut] + after[:cut]
        other = plain_fingerprint(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[t], other, same(prints[t], other), same(prints[t], prints[after])))
    return out


def test_fingerprint_equals_plain_version():
    for t in odd_texts(3, 30) + ["ab" * 700, "abcdefgh", "abcdefghi"]:
        assert om.fingerprint_of(t or "") == plain_fingerprint(t)


def test_passes_and_blocks_agree_with_plain_version(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abé \n") for _ in range(n)) for n in (999, 1000, 1007, 1008, 3500)]
    monkeypatch.setattr(om, "BLOCK", 64)
    monkeypatch.setattr(om, "PASS_SIZE", 1000)
    assert [om.fingerprint_of(t) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_next_documents_equal_plain_version(spark, partitions):
    rng = random.Random(6)
    rows = list(zip(rng.sample(range(-500, 10 ** 12), 70), odd_texts(6, 60)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = om.compare_with_next(with_clashes(docs(spark, [t for _, t in rows], [i for i, _ in rows]))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, got)) == sorted(compared(rows))


def test_order_of_null_and_repeated_ids(spark):
    """Null ids come last, rows of one id follow by hash: the edited texts say which text came next."""
    texts = [f"{chr(97 + k)}" * 9 for k in range(24)]
    ids = [5, 5, 5, 5, 5, 5, 9, None, None, None, None, 2] + [5] * 12
    df = docs(spark, texts, ids)
    ties = {r.text: r.h for r in df.select("text", F.shiftrightunsigned(F.xxhash64("text"), 2).alias("h")).collect()}
    order = sorted(zip(ids, texts), key=lambda r: (r[0] is None, -(r[0] or 0), ties[r[1]]))
    want = {(i, hashlib.sha256((t[:6] + u[:3]).encode()).hexdigest()) for (i, t), (_, u) in zip(order, order[1:] + order[:1])}
    assert {(r.id, r.edited_sha256) for r in om.compare_with_next(df).collect()} == want


def test_odd_tables(spark):
    assert om.compare_with_next(docs(spark, [])).count() == 0 and om.fingerprints(docs(spark, [])).count() == 0
    one = om.compare_with_next(docs(spark, ["abcdefghij"], [3])).collect()
    assert [tuple(r) for r in one] == compared([(3, "abcdefghij")])
    alike = om.compare_with_next(docs(spark, ["same text here"] * 5 + [None, ""], [1, 1, 1, None, None, None, 0])).collect()
    assert len(alike) == 7 and len({r.fingerprint for r in alike}) == 2
    assert [r.fingerprint for r in om.fingerprints(docs(spark, [None, ""])).collect()] == ["0" * 512] * 2


def test_runs_split_a_hot_id(spark):
    df = docs(spark, [f"text number {k}" for k in range(600)], [7] * 200 + [None] * 200 + list(range(1000, 1200)))
    runs = om._runs(om._texts(df, "doc_id", "text")).groupBy("run").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")).collect()
    assert sum(r.n for r in runs) == 600 and max(r.n for r in runs) < 120


def test_likeness_follows_edits(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = [rng.choice(words) for _ in range(900)]
    swapped = text[450:] + text[:450]
    touched = [w if k % 150 else "new" for k, w in enumerate(text)]
    other = [rng.choice(words) for _ in range(900)]
    prints = {r.id: r.fingerprint for r in om.fingerprints(docs(spark, [" ".join(w) for w in (text, text, touched, swapped, other)])).collect()}
    df = spark.createDataFrame([(k, prints[0], prints[k]) for k in range(1, 5)], "k int, a string, b string")
    near = {r.k: r.near for r in df.select("k", om.likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    assert near[1] == 1 and near == {k: same(prints[0], prints[k]) for k in near}
    assert near[2] > 0.75 and 0.25 < near[3] < 0.75 < near[2] and near[4] < 0.15  # moved halves keep their k-mers, but half of the orders break


def test_long_text():
    text = " ".join(f"w{k % 70_001}" for k in range(400_000))
    assert len(text) > 2 * om.PASS_SIZE and len(om.fingerprint_of(text)) == 512


def test_query_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert sorted(map(tuple, queries.op12_order_minhash(spark, SF).collect())) == sorted(compared(rows))
