import random

from quarry.llm import queries, quotations
from quarry.sources.tables import table

SCHEMA = "conv_id long, turn long, role string, text string, thread long, conv long, h1 long, `a.b` long"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA)
    return {(r.conv, r.turn): r for r in quotations.reply_ordered(df).collect()}


def test_nested_quotes(spark):
    rows = [
        (1, 0, "user", "How do I sort a list?\nIt has numbers."),
        (1, 1, "assistant", "Use sorted.\nIt returns a new list."),
        (1, 2, "user", "And what about tuples?"),
        (1, 3, "user", "On Monday A wrote:\n> Use sorted.\n> It returns a new list.\n>> how do I SORT a list\n\nDoes it change the old one?"),
        (1, 4, "assistant", "> Does it change the old one?\nNo.\n> never said by anyone\n"),
        (1, 5, "user", "> And what about tuples?\n> Use sorted.\nThe later one counts."),
        (2, 0, "user", "> Use sorted.\nAnother conversation has its own messages."),
        (2, 1, "user", None), (2, 2, "user", ""), (2, 3, None, "> \n>\n"),
        (None, 0, "user", "> Use sorted."), (3, None, "user", "x\n> y"),
    ]
    got = run(spark, rows)
    at = lambda c, t: (got[c, t].thread, got[c, t].parent, got[c, t].depth, got[c, t].n_quotes, got[c, t].n_linked, got[c, t].text)
    assert at(1, 0) == (0, None, 0, 0, 0, rows[0][3])
    assert at(1, 3) == (1, 1, 1, 2, 2, "Does it change the old one?")
    assert at(1, 4) == (1, 3, 2, 2, 1, "No.")
    assert at(1, 5) == (2, 2, 1, 1, 1, "The later one counts.")
    assert at(2, 0) == (0, None, 0, 1, 0, "Another conversation has its own messages.")
    assert at(2, 1) == (1, None, 0, 0, 0, None) and at(2, 2) == (2, None, 0, 0, 0, "")
    assert at(2, 3) == (3, None, 0, 1, 0, "")
    assert at(None, 0)[1:] == (None, 0, 1, 0, "") and at(3, None) == (None, None, 0, 1, 0, "x")


def test_parts_and_rewrapped_passages(spark):
    paragraph = "The first point is short. Sorting a list twice does not change the order at all! Yes. The third point comes last"
    lines = "One line about the river bank,\nanother about the old mill,\na third about the road,\na fourth on the bridge,\nand a fifth."
    rows = [
        (1, 0, "user", paragraph), (1, 1, "assistant", lines),
        (1, 2, "user", "> Sorting a list twice does not change the order at all!\nWhy?"),
        (1, 3, "user", "> another about the\n> old mill, a third\n> about the road,\nGo on."),
        (1, 4, "user", "> Yes.\nFine."), (1, 5, "user", "> a list twice does not change the order\nPart of a sentence."),
        (1, 6, "user", "> a list twice does not change her order\nNo one said this."), (1, 7, "user", "第一点很短。排序两次不会改变顺序。还有别的"),
        (1, 8, "user", "> 排序两次不会改变顺序。\n对"), (1, 9, "user", "> another about the mill\nNot in one piece."),
    ]
    got = run(spark, rows)
    assert [got[1, t].parent for t in range(2, 10)] == [0, 1, 0, 0, None, None, 7, None]


def test_most_words_decide_not_the_latest_part(spark):
    rows = [(1, 0, "user", "Alpha beta gamma delta epsilon zeta. Please check the log."), (1, 1, "assistant", "Thanks."), (1, 2, "user", "Yes."),
            (1, 3, "user", "> Alpha beta gamma delta epsilon zeta.\n> [...]\n> Thanks.\nAgreed."), (1, 4, "user", "> Alpha beta gamma delta epsilon zeta. Yes.\nSo be it."),
            (1, 5, "user", "> Thanks.\n> Yes.\nA tie goes to the later one.")]
    got = run(spark, rows)
    assert [got[1, t].parent for t in range(3, 6)] == [0, 0, 2]


def test_latest_earlier_speaker(spark):
    rows = [(1, 1, "user", "Use sorted."), (1, 9, "user", "Use sorted."), (1, 10, "user", "> Use sorted.\nWhy?"), (1, 5, "user", "> Use sorted.\nAnd then?"),
            (1, 1, "user", "Use sorted."), (1, 5000, "user", "> Use sorted.\nMuch later"), (1, 5001, "user", "> Use sorted.\nUse sorted."),
            (2, 0, "user", "I did this and that.\nThanks."), (2, 1, "user", "Thanks."), (2, 2, "user", "> I did this and that.\n> Thanks.\nThe whole passage counts first.")]
    got = run(spark, rows)
    assert [got[1, t].parent for t in (1, 9, 10, 5, 5000, 5001)] == [None, None, 9, 1, 9, 9] and got[2, 2].parent == 0


def test_replies_follow_what_they_answer(spark):
    """Random trees of quotations: threads and depths as plain pointer walking gives them."""
    rng = random.Random(3)
    rows, parent = [], {}
    for conv in range(4):
        for turn in range(30):
            quoted = rng.randrange(turn) if turn and rng.random() < 0.7 else None
            parent[conv, turn] = quoted
            rows.append((conv, turn, "user", (f"> Message {quoted} of {conv} speaks\n" if quoted is not None else "") + f"Message {turn} of {conv} speaks"))
    got = run(spark, rows)
    for (conv, turn), r in got.items():
        t, depth = turn, 0
        while parent[conv, t] is not None:
            t, depth = parent[conv, t], depth + 1
        assert (r.parent, r.thread, r.depth) == (parent[conv, turn], t, depth)
        assert r.text == f"Message {turn} of {conv} speaks"


def test_long_chain_hot_line_and_repeated_rows(spark):
    rows = [(1, t, "user", (f"> say {t - 1} here\n" if t else "") + f"say {t} here\nthanks a lot") for t in range(70)]
    got = run(spark, rows + rows[5:8])
    assert all((r.thread, r.depth, r.parent) == (0, t, t - 1 if t else None) for (_, t), r in got.items())
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows + rows[5:8]], SCHEMA)
    assert quotations.reply_ordered(df).count() == 73 and quotations.reply_ordered(df.limit(0)).count() == 0


def test_op7_on_conversations(spark):
    sf = "/root/testdata/sf0.001"
    want = {(r.conv_id, r.turn): r for r in table(spark, sf, "conversations").collect()}
    got = queries.op7_quotations(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        m = want[r.conv_id, r.turn]
        assert r.role == m.role and (r.n_quotes > 0 or r.text == m.text) and r.thread <= r.turn
