import random
import re
from itertools import permutations

import pytest

from quarry.llm import filter_audit, queries
from quarry.sources.tables import table

from .brute import WORD
from .fixtures import docs, odd_texts, with_clashes

SF = "/root/testdata/sf0.001"


def failures(rows):
    """(part, set of letters, id) of each row (id, text, lang)."""
    out = []
    for i, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        hit = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)),
               "E": i is not None and any(o is not None and o < i and (u or "") == t for o, u, _ in rows)}
        out.append((lang or "", {c for c in hit if hit[c]}, i))
    return out


def audited(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    found, out = failures(rows), []
    for part in {p for p, _, _ in found}:
        mine = [(f, i) for p, f, i in found if p == part]
        lines = []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, c in enumerate(order, 1):
                gone, stay = [x for x in left if c in x[0]], [x for x in left if c not in x[0]]
                failing = sum(c in f for f, _ in mine)
                lines.append([part, order, k, len(stay), len(gone), failing - len(gone), sum(f == {c} for f, _ in mine),
                              sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)])
                left = stay
        total = {c: sum(x[4] for x in lines if x[1][x[2] - 1] == c) for c in "ABCDE"}
        out += [(*x, total[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


def corpus(spark, seed):
    rng = random.Random(seed)
    base = odd_texts(seed, 20) + [" ".join(rng.choice(words) for _ in range(rng.randint(80, 200))) for words in
                                  ([f"w{k}" for k in range(900)], ["a", "b", "c"], ["Ab", "CDE", "x"], ["a#", "b"]) for _ in range(6)]
    rows = [(i, rng.choice(base), rng.choice(["en", "de", None, ""])) for i in rng.sample(range(200), 120)]
    rows += rows[:4] + [(None, rows[0][1], "en"), (None, rows[0][1], "en"), (rows[5][0], rows[5][1], "xx"), (rows[6][0], "one more", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, _, _ in rows[:60]] + [(None, 1, 1), (10 ** 6, 1, 1)]
    df = spark.createDataFrame([(i, t, lang, 7, "x") for i, t, lang in rows], "doc_id long, text string, lang string, n long, mask string")
    return rows, labels, with_clashes(df), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows, labels, df, marks = corpus(spark, seed)
    assert sorted(map(tuple, filter_audit.audit(df, marks).collect())) == audited(rows, labels)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6])
def test_swaps_visit_every_order_once(size):
    order, seen = list(range(size)), {tuple(range(size))}
    moves = list(filter_audit.swaps(size))
    for i in moves:
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.add(tuple(order))
    assert len(seen) == len(moves) + 1 == len(list(permutations(range(size))))


def test_diagram_shares_equal_nodes_and_keeps_weights():
    diagram = filter_audit.Diagram({0: (5,), 31: (2,)}, 5)
    assert len(diagram.leaves) == 3 and sum(map(len, diagram.levels)) < 31
    rng = random.Random(4)
    weights = {m: (rng.randint(0, 9), 1) for m in range(32)}
    moved, before = filter_audit.Diagram(weights, 5), filter_audit.Diagram(weights, 5).steps()
    for i in (0, 3, 1, 2, 2, 1, 3, 0):
        moved.swap(i)
        assert moved.steps()[-1][2] == weights[0]
    assert moved.steps() == before


def test_empty_and_unlabelled(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs(spark, []), none).count() == 0
    out = filter_audit.audit(docs(spark, [None, ""]), none).where("filter_order = 'EABCD'").orderBy("step").collect()
    assert [(r.kept, r.removed, r.redundant, r.good_lost) for r in out] == [(1, 1, 0, 0), (0, 1, 1, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_long_text(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = filter_audit.failure_counts(docs(spark, [" ".join(f"w{k}" for k in range(400_000)), "Xy " * 900_000]), none).collect()
    assert sorted((r["mask"], r.n) for r in out) == [(0, 1), (0b0110, 1)]


def test_query_on_documents(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in table(spark, SF, "documents").collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in table(spark, SF, "labels").collect()]
    assert sorted(map(tuple, queries.op11_filter_audit(spark, SF).collect())) == audited(rows, labels)
