import itertools
import random

from quarry.llm import decontamination, queries
from quarry.llm.decontamination import MASKS, MIN_ITEM_WORDS, WINDOW
from quarry.sources.tables import table

from .brute import overlaps
from .fixtures import docs, odd_texts, with_clashes


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string, words int, h long")


def test_masks_meet_every_window():
    """Wherever the allowed substitutions stand, one mask at one place reads none of them."""
    for n in range(MIN_ITEM_WORDS, WINDOW + 1):
        allowed = 2 if n == WINDOW else n // 6
        placed = [{p + k for k in m} for m in MASKS for p in range(n - 7)]
        assert all(any(not m & set(c) for m in placed) for c in itertools.combinations(range(n), allowed)), n


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(5, 45))), 1, 2) for k in range(12)] + [(20, None, 1, 2), (21, "", 1, 2), (None, "w1 " * 30, 1, 2)]
    items.append(items[3])
    texts = odd_texts(2, 10)
    for _, it, *_ in items[:12]:
        for subs in (0, 2, 4, 6):
            w = it.split()
            for p in rng.sample(range(len(w)), min(subs, len(w))):
                w[p] = "other"
            if rng.random() < 0.4:
                w = w[rng.randrange(len(w)):]
            around = [rng.choice(words) for _ in range(20)]
            texts.append(", ".join(around + w + around).title())
    ids = [None if k == 30 else k for k in range(len(texts))]
    got = decontamination.overlaps(with_clashes(docs(spark, texts, ids)), bench(spark, items)).collect()
    want = overlaps(list(zip(ids, texts)), [(k, t) for k, t, *_ in items])
    assert {(r.id, r.item): (r.n_matched, r.n_window) for r in got} == want and len(got) == len(want) > 10


def test_blocks_and_empty_tables(spark, monkeypatch):
    items = [(k, f"a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k} i{k} j{k}", 1, 2) for k in range(9)]
    texts = [t for _, t, *_ in items]
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 64)
    got = decontamination.overlaps(docs(spark, texts), bench(spark, items)).collect()
    assert {(r.id, r.item) for r in got} == {(k, k) for k in range(9)}
    assert decontamination.overlaps(docs(spark, []), bench(spark, items)).count() == 0
    assert decontamination.overlaps(docs(spark, texts), bench(spark, [])).count() == 0


def test_short_items_are_found_whole(spark, monkeypatch):
    items = [(0, "Who wrote Hamlet?", 1, 2), (1, "What is the capital of the old kingdom", 1, 2), (2, "Zugzwang", 1, 2), (3, "第一点很短。排序两次不会改变顺序", 1, 2), (4, "天空是蓝色", 1, 2),
             (5, "a1 b1 c1 d1 e1 f1 g1 h1 i1 j1", 1, 2), (6, "", 1, 2), (7, None, 1, 2), (None, "and who", 1, 2), (0, "Who wrote Hamlet?", 1, 2)]
    texts = ["So, who wrote Hamlet", "who wrote a Hamlet", "Tell me: what is the capital of the old kingdom? And who wrote hamlet.", "a zugzwang!", "zugzwangs", None, "",
             "他说第一点很短。排序两次不会改变顺序。", "今天天空是蓝色的", "天空蓝色", "x a1 b1 c1 d1 e1 f1 g1 h1 i1 j1 y", "who wrote"]
    want = {(0, 0): (3, 3), (2, 0): (3, 3), (2, 1): (8, 8), (3, 2): (1, 1), (7, 3): (13, 13), (8, 4): (5, 5), (10, 5): (10, 10)}
    for size in (1 << 20, 16):
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        got = decontamination.all_overlaps(with_clashes(docs(spark, texts + texts[:1], [*range(len(texts)), 0])), bench(spark, items)).collect()
        assert {(r.id, r.item): (r.n_matched, r.n_window) for r in got} == want and len(got) == len(want)
    assert decontamination.all_overlaps(docs(spark, []), bench(spark, items)).count() == 0
    assert decontamination.all_overlaps(docs(spark, texts), bench(spark, [])).count() == 0


def test_op4_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    exact = {(i, k) for i, t in texts for k, x in items if x in t}
    got = {(r.doc_id, r.item_id) for r in queries.op4_decontamination(spark, sf).collect()}
    assert exact <= got and all(any(w in dict(texts)[i] for w in dict(items)[k].split()[3:6]) for i, k in got)


def test_a_benchmark_of_several_mb_takes_one_pass_and_no_broadcast(spark):
    rng = random.Random(7)
    items = [(k, " ".join(f"{rng.randrange(1 << 20):x}" for _ in range(2000)), 1, 2) for k in range(220)]
    items.append((900, items[7][1], 1, 2))  # the same text under another id
    words = items[7][1].split()
    texts = ["before " + " ".join(words[50:70]) + " after", " ".join(words[1990:2000] + ["x"] * 3), " ".join(words[100:105] + ["x", "y"] + words[107:113]), None]
    assert sum(len(t) for _, t, *_ in items) > 2 << 20
    found = decontamination.overlaps(docs(spark, texts), bench(spark, items))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD [doc_id") == 1 and "strategy=broadcast" not in plan
    assert {tuple(r) for r in found.collect()} == {(k, i, n, 13) for k, n in ((0, 13), (2, 11)) for i in (7, 900)}
