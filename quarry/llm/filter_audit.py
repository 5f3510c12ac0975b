"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

A document's failures are one bit mask.  Only the masks' counts per part leave the
documents: at most 2^filters rows a part, whatever the corpus.  Each part's counts
become a count-weighted decision diagram, a level per filter, whose nodes know
how many documents are below them.  Two neighbouring filters change places by a swap
of two levels, so all orders are visited one swap apart, and in each order the path
on which every filter passes tells the steps: what is kept, and what the failing side of
each node on it takes away.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col_of, words_of

MIN_WORDS = 100
MIN_DISTINCT_PERCENT = 80
MAX_CAPITALS_PERCENT = 10
SIGNS = r"[#$%&*|]"

STEPS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def too_short(text: Column, words: Column) -> Column:
    return F.size(words) < MIN_WORDS


def too_repetitive(text: Column, words: Column) -> Column:
    return 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words)


def too_loud(text: Column, words: Column) -> Column:
    return 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MAX_CAPITALS_PERCENT * F.length(text)


def has_signs(text: Column, words: Column) -> Column:
    return text.rlike(SIGNS)


#: Letter and failure condition (text, its words) of the filters that look at one text; the duplicate filter comes after them.
CONDITIONS = (("A", too_short), ("B", too_repetitive), ("C", too_loud), ("D", has_signs))
DUPLICATE = "E"


def failure_counts(docs: DataFrame, labels: DataFrame, conditions=CONDITIONS, id_col: str = "doc_id", text_col: str = "text",
                   part_col: str = "lang") -> DataFrame:
    """Documents per part and failure mask: part, mask (bit k: filter k fails; the last bit: duplicate), n, good, toxic.

    A duplicate has the text of a row with a smaller id, anywhere in the table.  Copies of
    a text are counted per part and label before they meet, so a text that a third of the corpus
    holds is a few rows.  A null text is empty, a null part is ''.  A row without id has no label and is
    neither a duplicate nor the first of others; rows of one id and one text are no duplicates of
    each other.  good and toxic count documents with a label row of quality 1 and toxic 1;
    repeated label rows count once.  Other columns are ignored.  Empty table: no rows.
    """
    rows = docs.select(col_of(docs, id_col).alias("id"), F.coalesce(col_of(docs, part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(col_of(docs, text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "part", "text", words_of(F.col("text")).alias("words"))
    bits = [F.when(fails(F.col("text"), F.col("words")), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, fails) in enumerate(conditions)]
    rows = rows.select("id", "part", F.unhex(F.md5("text")).alias("h"), sum(bits, F.lit(0)).alias("mask"))
    rows = rows.groupBy("id", "h", "part", "mask").agg(F.count(F.lit(1)).alias("n"))

    marks = labels.select(col_of(labels, id_col).alias("id"), (col_of(labels, "quality") == 1).alias("good"), (col_of(labels, "toxic") == 1).alias("toxic"))
    marks = marks.where("id IS NOT NULL").groupBy("id").agg(*[F.coalesce(F.max(c), F.lit(False)).alias(c) for c in ("good", "toxic")])
    rows = rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})

    # Of a cell's ids all differ, so the least one carries the number of its rows; whether it is the least of all cells of the text comes next.
    cells = rows.groupBy("h", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"))
    least = cells.groupBy("h").agg(F.min("least.id").alias("first"))
    cells = cells.join(least, "h")
    firsts = F.col("n_null") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    again = F.lit(1 << len(conditions))
    cells = cells.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask").alias("mask"), firsts.alias("n")), F.struct((F.col("mask") + again).alias("mask"), (F.col("n") - firsts).alias("n")))))
    counted = cells.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])
    return counted.select("part", F.col("mask").cast("int").alias("mask"), "n", "good", "toxic")


class Diagram:
    """A decision diagram over failure masks, with weights summed upwards.

    ``levels[i]`` holds the nodes that test filter ``order[i]``: a pair of the node below on the passing
    and on the failing side.  Equal nodes of a level are one.  The last layer holds the masks' weights.
    """

    def __init__(self, weights: dict[int, tuple], size: int):
        self.order = list(range(size))
        none = tuple(0 for _ in next(iter(weights.values()), (0,)))
        leaves, below = {}, []
        for code in range(1 << size):  # the first filter is the highest digit, so that neighbours differ in the last
            mask = sum(1 << k for k in range(size) if code >> (size - 1 - k) & 1)
            below.append(leaves.setdefault(weights.get(mask, none), len(leaves)))
        self.leaves, self.levels = list(leaves), []
        for _ in range(size):
            nodes: dict[tuple, int] = {}
            below = [nodes.setdefault(pair, len(nodes)) for pair in zip(below[::2], below[1::2])]
            self.levels.insert(0, list(nodes))
        self.root = below[0]

    def swap(self, i: int) -> None:
        """The filters at levels i and i + 1 change places; nodes of other levels stay."""
        low, nodes = self.levels[i + 1], {}
        node = lambda *pair: nodes.setdefault(pair, len(nodes))
        self.levels[i] = [(node(low[ok][0], low[bad][0]), node(low[ok][1], low[bad][1])) for ok, bad in self.levels[i]]
        self.levels[i + 1] = list(nodes)
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]

    def steps(self) -> list[tuple[int, tuple, tuple]]:
        """Along the path on which every filter passes: filter, weight that fails there, weight that is left."""
        weights = [self.leaves]
        for nodes in reversed(self.levels):
            weights.insert(0, [tuple(map(sum, zip(weights[0][ok], weights[0][bad]))) for ok, bad in nodes])
        out, at = [], self.root
        for i, nodes in enumerate(self.levels):
            ok, bad = nodes[at]
            out.append((self.order[i], weights[i + 1][bad], weights[i + 1][ok]))
            at = ok
        return out


def swaps(size: int):
    """Levels to swap, one after the other, so that all orders of ``size`` filters are visited once."""
    if size < 2:
        return
    inner, right = list(swaps(size - 1)), True
    for k in range(len(inner) + 1):
        yield from range(size - 2, -1, -1) if right else range(size - 1)
        if k < len(inner):  # the travelling filter is at an end now: the first place moves the others by one
            yield inner[k] + right
            right = not right


def part_steps(weights: dict[int, tuple], names: str) -> list[tuple]:
    """Rows (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part."""
    diagram = Diagram(weights, len(names))
    found = {tuple(diagram.order): diagram.steps()}
    for i in swaps(len(names)):
        diagram.swap(i)
        found[tuple(diagram.order)] = diagram.steps()
    shapley, fails, alone = ([0] * len(names) for _ in range(3))
    for steps in found.values():
        for f, gone, _ in steps:
            shapley[f] += gone[0]
        fails[steps[0][0]] = steps[0][1][0]  # first in the order: all that fail it
        alone[steps[-1][0]] = steps[-1][1][0]  # last: those that fail nothing else
    return [("".join(names[f] for f in order), k, left[0], gone[0], fails[f] - gone[0], alone[f], gone[1], gone[2], shapley[f])
            for order, steps in found.items() for k, (f, gone, left) in enumerate(steps, 1)]


def audit_orders(counts: DataFrame, names: str) -> DataFrame:
    """All steps of all orders of the filters ``names`` (a letter each), per part of ``failure_counts``' rows.

    A row is one part, filter_order and step (from 1).  kept: documents left after the step; removed: those it takes; redundant: those that fail its
    filter but left earlier; unique_fails: those that fail its filter only; good_lost and toxic_lost:
    labelled ones among removed; shapley: its filter's removed, summed over all orders.
    A part is one group of at most 2^filters rows.  No rows in, no rows out.
    """
    def steps(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        mask, *weight = (table.column(c).to_pylist() for c in ("mask", "n", "good", "toxic"))
        found = part_steps(dict(zip(mask, zip(*weight))), names)
        columns = zip(*[(key[0].as_py(), *row) for row in found])
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=fields)

    fields = [f.split()[0] for f in STEPS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    return counts.groupBy("part").applyInArrow(steps, STEPS)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of ``CONDITIONS`` and the duplicate filter; rows as of ``audit_orders``, odd input as of ``failure_counts``."""
    counts = failure_counts(docs, labels, CONDITIONS, id_col, text_col, part_col)
    return audit_orders(counts, "".join(name for name, _ in CONDITIONS) + DUPLICATE)
