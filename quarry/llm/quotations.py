"""Quotation linking: who answers whom, read from quoted passages, and conversations without the quotes.

Lines are parsed for nested quote marks.  Neighbouring quoted lines of one level
form a passage; a passage, its lines and its sentences are normalised and hashed, and
joined to the messages that said them last before: as a text, line or sentence of their own, or
from ``RUN`` words on anywhere in their text, however the lines are wrapped.  A message's parent is the latest earlier message of its conversation that
one of its outermost passages comes from; the reply order is by thread (the
first message that the parents lead to) and turn.

Everything is a map-side combined aggregation, a join on hashes or a scan in two levels
(inside blocks of turns, over the blocks): messages that share a line are never paired, so neither a
hot line nor a hot conversation makes pairs or lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col_of, discard, let, stored

#: A line's quote marks, and the line that mail programs put before a quotation.
MARKS = r"^[ \t]*(?:>[ \t]?)+"
ATTRIBUTION = r"(?i)^[^>]{1,200}\b(wrote|writes|said|schrieb|escribió|a écrit) ?:[ \t]*$"

#: Where a sentence ends, scripts without blanks, words from which on a run is found inside a text, turns of a block.
SENTENCE_END = r"(?<=[.!?…])[\s\x{A0}]+|(?<=[。！？])\s*"
NO_BLANKS = r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}])"
RUN = 4
TURNS = 1024


def quote_level(line: Column) -> Column:
    """How many quote marks a line begins with."""
    marks = F.regexp_extract(line, MARKS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def normalised(text: Column) -> Column:
    """Lower case, words only, one blank between them; in scripts without blanks every character is a word."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), NO_BLANKS, " $1 "), r"[^\p{L}\p{N}]+", " "))


def pieces_of(text: Column) -> Column:
    """Normalised lines and sentences of a text, sentences inside lines and over them; empty ones go."""
    lines = F.split(text, "\n", -1)
    found = F.concat(lines, F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE_END, -1))), F.split(F.translate(text, "\n", " "), SENTENCE_END, -1))
    return F.filter(F.array_distinct(F.transform(found, normalised)), lambda x: x != "")


def _key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))


def own_text(text: Column) -> Column:
    """The text without quoted lines, and without a line of attribution right before them; blank lines at both ends go."""
    def unquoted(lines: Column) -> Column:
        own = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (quote_level(F.get(lines, i)) == 0) & ~(
            F.get(lines, i).rlike(ATTRIBUTION) & F.coalesce(quote_level(F.get(lines, i + 1)) > 0, F.lit(False))))
        return F.array_join(F.transform(own, lambda i: F.get(lines, i)), "\n")

    return F.when(text.rlike("(?m)" + MARKS), F.btrim(let(F.split(text, "\n", -1), unquoted), F.lit(" \t\r\n"))).otherwise(text)


def passages(messages: DataFrame) -> DataFrame:
    """conv, turn, level, first (line number), text: maximal runs of quoted lines of one level, with their text without marks."""
    lines = messages.where(F.col("text").rlike("(?m)" + MARKS)).select("conv", "turn", F.split("text", "\n", -1).alias("lines"))

    def starts(ls: Column) -> Column:
        levels = F.transform(ls, quote_level)
        return let(levels, lambda v: F.transform(
            F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (F.get(v, i) > 0) & F.coalesce(F.get(v, i) != F.get(v, i - 1), F.lit(True))),
            lambda i: F.struct(F.get(v, i).alias("level"), i.alias("first"))))

    def body(ls: Column, p: Column) -> Column:
        # lines from the first on while the level stays
        rest = F.slice(ls, p["first"] + 1, F.size(ls))
        stop = F.array_position(F.transform(rest, lambda x: quote_level(x) == p["level"]), False)
        run = F.when(stop == 0, rest).otherwise(F.slice(rest, 1, (F.greatest(stop, F.lit(1)) - 1).cast("int")))
        return F.array_join(F.transform(run, lambda x: F.regexp_replace(x, MARKS, "")), "\n")

    found = let(F.col("lines"), lambda ls: F.transform(starts(ls), lambda p: F.struct(p["level"].alias("level"), p["first"].alias("first"), body(ls, p).alias("text"))))
    return lines.select("conv", "turn", F.explode(found).alias("p")).select("conv", "turn", "p.level", "p.first", "p.text")


def said(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """conv, h1, h2, at: the turns whose own text is, has as a line or sentence, or holds a quoted piece.

    ``quoted`` has a row per piece: conv, piece.  Long pieces are looked up by their first words; at the
    places found the run of as many words is hashed like the piece, so only equal runs are left.
    """
    own = messages.select("conv", "turn", own_text(F.col("text")).alias("own")).where("conv IS NOT NULL AND turn IS NOT NULL AND own <> ''")
    own = stored(own.select("conv", "turn", normalised(F.col("own")).alias("flat"), pieces_of(F.col("own")).alias("pieces")).distinct(), "said")
    whole = own.select("conv", F.col("turn").alias("at"), F.explode(F.array_append("pieces", F.col("flat"))).alias("piece"))
    whole = whole.where("piece <> ''").select("conv", "at", _key(F.col("piece")).alias("k"))

    def begin(words: str, i: Column) -> Column:
        return F.xxhash64(*[F.get(F.col(words), i + k) for k in range(RUN)])

    runs = quoted.select("conv", F.split("piece", " ").alias("w")).where(F.size("w") >= RUN)
    runs = runs.select("conv", begin("w", F.lit(0)).alias("begin"), F.size("w").alias("n")).distinct()
    words = own.select("conv", "turn", F.xxhash64("flat").alias("version"), F.split("flat", " ").alias("w")).where(F.size("w") >= RUN)
    places = words.select("conv", "turn", "version", F.size("w").alias("size"), "w", F.explode(F.sequence(F.lit(0), F.size("w") - RUN)).alias("i"))
    places = places.select("conv", "turn", "version", "size", "i", begin("w", F.col("i")).alias("begin"))
    hits = places.join(runs, ["conv", "begin"]).where("i + n <= size").select("conv", "turn", "version", "i", "n").distinct()
    inside = hits.join(words, ["conv", "turn", "version"])
    inside = inside.select("conv", F.col("turn").alias("at"), _key(F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ")).alias("k"))
    return whole.unionByName(inside).select("conv", "k.h1", "k.h2", "at").distinct()


def last_said(asked: DataFrame, said: DataFrame) -> DataFrame:
    """The rows of ``asked`` (conv, h1, h2, turn) with the last earlier turn of ``said`` (conv, h1, h2, at), as quoted; those without one go."""
    key = ["conv", "h1", "h2"]
    numbers = dict(asked.dtypes)["turn"] in ("tinyint", "smallint", "int", "bigint")
    block = F.floor(F.col("turn") / TURNS) if numbers else F.lit(0)
    both = asked.select(*key, "turn", F.lit(None).cast(dict(said.dtypes)["at"]).alias("at")).distinct().unionByName(
        said.select(*key, F.col("at").alias("turn"), "at")).withColumn("block", block)
    # At one turn the question stands before what is said: only earlier turns count.
    inside = Window.partitionBy(*key, "block").orderBy("turn", F.col("at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.groupBy(*key, "block").agg(F.max("at").alias("last")).select(*key, "block", F.max("last").over(before).alias("earlier"))
    found = both.withColumn("near", F.max("at").over(inside)).where("at IS NULL").join(blocks, [*key, "block"])
    return found.select(*key, "turn", F.coalesce("near", "earlier").alias("quoted")).where("quoted IS NOT NULL")


def linked_passages(messages: DataFrame) -> DataFrame:
    """Per passage the turn that it quotes: conv, turn, level, first, quoted.

    A passage is looked up whole, then by its lines and sentences; a piece belongs to the latest turn that said it and is
    earlier than the quoting message.  Of several turns the one that said the passage whole counts, then the one
    with most words of it, so that a short common answer among the pieces does not decide; then the latest.
    """
    quoted = passages(messages).where("conv IS NOT NULL AND turn IS NOT NULL")
    flat = normalised(F.col("text"))
    pieces = F.array_append(F.transform(pieces_of(F.col("text")), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("piece"))),
                            F.struct(F.lit(True).alias("whole"), flat.alias("piece")))
    asked = quoted.select("conv", "turn", "level", "first", F.explode(pieces).alias("p")).where("p.piece <> ''")
    asked = asked.select("conv", "turn", "level", "first", "p.whole", "p.piece", _key(F.col("p.piece")).alias("k")).select("*", "k.h1", "k.h2").drop("k").distinct()
    asked = stored(asked, "quoted")
    # Only conversations with a quotation need an index.
    found = last_said(asked, said(messages.join(asked.select("conv").distinct(), "conv", "left_semi"), asked))
    passage = ["conv", "turn", "level", "first"]
    by_turn = asked.join(found, ["conv", "h1", "h2", "turn"]).groupBy(*passage, "quoted").agg(
        F.max("whole").alias("whole"), F.sum(F.size(F.split("piece", " "))).alias("words"))
    return by_turn.groupBy(*passage).agg(F.max(F.struct("whole", "words", "quoted"))["quoted"].alias("quoted"))


def threads(parents: DataFrame) -> DataFrame:
    """conv, turn, parent, thread, depth of messages with a parent: pointers are doubled until all lead to a message without one."""
    state = stored(parents.select("conv", "turn", "parent", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        above = state.select("conv", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = state.join(above, ["conv", "up"], "left")
        moved = stored(moved.select("conv", "turn", "parent", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                                    F.col("next").isNotNull().alias("went")), "threads")
        discard(state)
        state = moved.drop("went")
        if moved.where("went").isEmpty():
            return state.withColumnRenamed("up", "thread")


def reply_ordered(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """One row per message: conv, thread, turn, depth, parent, role, text (without quotes), n_quotes, n_linked.

    The reply order of a conversation is by thread and turn: a thread begins with a message without parent,
    and every reply comes after the message that it answers.  depth counts the parents above a
    message, n_quotes its passages, n_linked those whose origin is known.  A message
    without linked outermost passage has no parent and is its own thread.  Null text: no
    text, no quotes.  Null conversation or turn: no links.  Repeated rows of one turn count as one
    message when linked and are all returned.  Other input columns are ignored.  Empty table: no rows.
    """
    rows = messages.select(*[col_of(messages, c).alias(n) for n, c in (("conv", conv_col), ("turn", turn_col), ("role", role_col), ("text", text_col))])
    links = stored(linked_passages(rows), "quotations")
    parents = links.where("level = 1").groupBy("conv", "turn").agg(F.max("quoted").alias("parent"))
    placed = threads(parents)
    linked = links.groupBy("conv", "turn").agg(F.count("*").alias("n_linked"))
    levels = let(F.transform(F.split("text", "\n", -1), quote_level), lambda v: F.size(F.filter(
        F.sequence(F.lit(0), F.size(v) - 1), lambda i: (F.get(v, i) > 0) & F.coalesce(F.get(v, i) != F.get(v, i - 1), F.lit(True)))))
    n_quotes = F.when(F.col("text").rlike("(?m)" + MARKS), levels).otherwise(0).cast("long")
    rows = rows.select("conv", "turn", "role", own_text(F.col("text")).alias("text"), n_quotes.alias("n_quotes"))
    out = rows.join(placed, ["conv", "turn"], "left").join(linked, ["conv", "turn"], "left")
    return out.select("conv", F.coalesce("thread", "turn").alias("thread"), "turn", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "parent", "role",
                      "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))
