"""Model calls, the tools that they run in, and spans as a forest.

``innermost`` finds, for points in time, the span that was opened last and is still open: an
as-of join over intervals that need not be nested.  It is done in two levels.  Rows are
dealt to buckets of time fitted to the data (``intervals.bucketed``).  A span that
covers whole buckets is noted on the dyadic ranges of buckets that make up its middle, where
only the last opened one is kept; inside a bucket there are the bucket's own rows, the
spans that end in it and one span for all that cover it.  A run with a third of all spans is
as many groups as it has buckets.

``span_tree`` rolls a forest of parent ids up and down by pointer doubling: a chain of n
spans takes log2(n) rounds.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import intervals as I

POINT, OPEN, CLOSE = 2, 0, 1  # order of rows at one time: opened spans are open, closed ones are not
LAST = (1 << 63) - 1
LEVELS = 40


def _cells(lo: Column, hi: Column) -> Column:
    """The dyadic ranges (level, cell) that make up lo..hi, at most two a level; none if hi < lo."""
    def at(k: Column) -> Column:
        a = F.call_function("shiftright", lo + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
        b = F.call_function("shiftright", hi + 1, k)
        cell = lambda c, odd: F.struct(k.alias("level"), c.alias("cell"), ((a < b) & (odd % 2 == 1)).alias("held"))
        return F.filter(F.array(cell(a, a), cell(b - 1, b)), lambda c: c["held"])

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Buckets of each key, numbered from 0 in order of time: keys, bucket, no."""
    buckets = rows.select(*keys, "bucket").distinct()
    return buckets.withColumn("no", F.row_number().over(Window.partitionBy(*keys).orderBy("bucket")).cast("long") - 1)


def _scan(key_schema: list[T.StructField]):
    """One bucket: walks its rows in order of time with a heap of open spans, the last opened on top."""
    names = [f.name for f in key_schema]

    def run(table: pa.Table) -> pa.Table:
        kind, t, at, start, end, span = (table[c].to_pylist() for c in ("kind", "t", "point_id", "start", "end", "cover_id"))
        found_at, found, heap = [], [], []
        for k in sorted(range(len(kind)), key=lambda k: (t[k], kind[k])):
            if kind[k] == OPEN:
                heapq.heappush(heap, (-start[k], -span[k], end[k]))
                continue
            while heap and heap[0][2] <= t[k]:  # it ended, and later points are later still
                heapq.heappop(heap)
            found_at.append(at[k])
            found.append(-heap[0][1] if heap else None)
        keys = [pa.array([table[n][0].as_py()] * len(found), table.schema.field(n).type) for n in names]
        return pa.table([*keys, pa.array(found_at, pa.int64()), pa.array(found, pa.int64())], names=[*names, "point_id", "cover_id"])

    return run


def innermost(spans: DataFrame, keys: list[str], point: Column, cover: Column, id_col: str = "span_id", start: str = "start", end: str = "end",
              bucket_us: int | None = I.DEFAULT_BUCKET_US) -> DataFrame:
    """For each row of ``point``, at its start, the row of ``cover`` that was opened last and is open: keys, point_id, cover_id.

    A span is open from its start up to before its end; one without end stays open.  Of spans opened at one time
    the one with the greatest id counts.  A point under no open span has cover_id null, and a row that is a point and a cover
    may be its own.  Points without start or id are left out, and so are covers without; reversed spans are never open.
    Ids are whole numbers.
    """
    span_end = F.coalesce(F.col(end), F.lit(LAST))
    empty = F.lit(None).cast("long")
    row = lambda kind, t, p, s, e, c: F.struct(F.lit(kind).alias("kind"), t.alias("t"), p.alias("point_id"), s.alias("start"), e.alias("end"), c.alias("cover_id"))
    own = F.col(id_col).cast("long")
    as_point = F.when(point, row(POINT, F.col(start), own, empty, empty, empty))
    opened = F.when(cover & (span_end > F.col(start)), row(OPEN, F.col(start), empty, F.col(start), span_end, own))
    closed = F.when(cover & (F.col(end) > F.col(start)), row(CLOSE, F.col(end), empty, F.col(start), span_end, own))
    rows = spans.where(F.col(start).isNotNull() & F.col(id_col).isNotNull()).select(*keys, F.inline(F.array_compact(F.array(as_point, opened, closed))))
    rows = I.bucketed(rows, keys, "t", bucket_us)
    numbers = _numbered(rows, keys).checkpoint(eager=True)
    rows = rows.join(numbers, [*keys, "bucket"]).drop("bucket").checkpoint(eager=True)

    # Spans that end in another bucket than they start in.
    edges = rows.where(F.col("kind") != POINT).groupBy(*keys, "cover_id", "start", "end").agg(
        F.min(F.when(F.col("kind") == OPEN, F.col("no"))).alias("a"), F.max(F.when(F.col("kind") == CLOSE, F.col("no"))).alias("b"))
    n_buckets = numbers.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    edges = edges.join(n_buckets, keys).withColumn("b", F.coalesce("b", "n")).where("b > a").checkpoint(eager=True)
    ends = edges.where("b < n").select(*keys, F.col("b").alias("no"), "start", "end", "cover_id")
    last = F.max(F.struct("start", "cover_id", "end"))
    middles = edges.where("b > a + 1").select(*keys, "start", "end", "cover_id", F.inline(_cells(F.col("a") + 1, F.col("b") - 1)))
    middles = middles.groupBy(*keys, "level", "cell").agg(last.alias("last"))
    levels = F.sequence(F.lit(0), F.lit(LEVELS))
    at = numbers.select(*keys, "no", F.explode(levels).alias("level")).withColumn("cell", F.expr("shiftright(no, level)"))
    middles = at.join(middles, [*keys, "level", "cell"]).groupBy(*keys, "no").agg(F.max("last").alias("last"))
    middles = middles.select(*keys, "no", F.col("last.start").alias("start"), F.lit(LAST).alias("end"), F.col("last.cover_id").alias("cover_id"))

    entering = ends.unionByName(middles).select(
        *keys, F.lit(OPEN).alias("kind"), F.lit(-LAST).cast("long").alias("t"), empty.alias("point_id"), "start", "end", "cover_id", "no")
    groups = rows.where(F.col("kind") != CLOSE).unionByName(entering)
    fields = [f for f in rows.schema.fields if f.name in keys]
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], T.StructField("point_id", T.LongType()), T.StructField("cover_id", T.LongType())])
    return groups.groupBy(*keys, "no").applyInArrow(_scan(fields), schema)


def llm_calls(spans: DataFrame, bucket_us: int | None = I.DEFAULT_BUCKET_US) -> DataFrame:
    """One row per model call with its details, and the tool span it was made in (null: outside any tool).

    Missing tokens count 0.  Further columns of the spans (prompt, parent, details) stay.
    """
    inside = innermost(spans, ["run_id"], F.col("type") == "llm", F.col("type") == "tool", bucket_us=bucket_us)
    names = spans.where(F.col("type") == "tool").select("run_id", F.col("span_id").alias("tool_span_id"), F.col("name").alias("tool"))
    inside = inside.select("run_id", F.col("point_id").alias("span_id"), F.col("cover_id").alias("tool_span_id"))
    inside = inside.join(names, ["run_id", "tool_span_id"], "left")
    calls = spans.where(F.col("type") == "llm").drop("type", "name")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("input_tokens", "output_tokens")}
    calls = calls.withColumns(zero).withColumns({"duration": F.col("end") - F.col("start"), "total_tokens": F.col("input_tokens") + F.col("output_tokens")})
    return calls.join(inside, ["run_id", "span_id"], "left")


def tool_tokens(calls: DataFrame) -> DataFrame:
    """Per run and tool, the model calls made inside it and their tokens; tool null: calls outside any tool."""
    return calls.groupBy("run_id", "tool").agg(F.count(F.lit(1)).alias("llm_calls"), *[
        F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "total_tokens")])


def span_tree(spans: DataFrame, keys: list[str], sums: list[str] = (), id_col: str = "span_id", parent_col: str = "parent_id") -> DataFrame:
    """The forest of parent ids: keys, id, parent, root, depth, n_below, <sum>_below for each column of ``sums``, in_cycle.

    depth counts from 0 at a root; n_below are a span's descendants, <sum>_below the column's total over the
    span and them.  A parent that is not among the key's spans is none (its child is a root).  Spans on a cycle, or below
    one, have in_cycle true and nulls for all else.  Ids are unique within the keys.

    Round k knows each span's 2^k-th ancestor and the sums over descendants nearer than
    2^k; it adds those of the spans whose 2^k-th ancestor it is.  Rounds: log2 of the greatest depth.  Spans that know
    their root are asked and added to, but ask no more.
    """
    rows = spans.select(*keys, F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), *[F.coalesce(c, F.lit(0)).alias(c) for c in sums])
    known = rows.select(*keys, F.col("id").alias("parent"), F.lit(True).alias("known"))
    rows = rows.join(known, [*keys, "parent"], "left").withColumn("parent", F.when(F.col("known"), F.col("parent")))
    rows = rows.select(*keys, "id", "parent", F.col("parent").alias("jump"), F.col("parent").isNotNull().cast("long").alias("depth"),
                       F.coalesce("parent", "id").alias("root"), F.lit(0).cast("long").alias("n_below"), *sums).checkpoint(eager=True)
    left, n = rows.where("jump IS NOT NULL").count(), rows.count()
    rounds = 0
    while left and 1 << rounds <= n:
        moving = rows.where("jump IS NOT NULL")
        below = moving.groupBy(*keys, F.col("jump").alias("id")).agg(
            F.sum(F.col("n_below") + 1).alias("add_n"), *[F.sum(c).alias(f"add_{c}") for c in sums])
        target = rows.select(*keys, F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("depth").alias("far_depth"), F.col("root").alias("far_root"))
        # Without null keys, of which each of few runs would have one group.
        rows = moving.join(target, [*keys, "jump"], "left").unionByName(rows.where("jump IS NULL"), allowMissingColumns=True).join(below, [*keys, "id"], "left")
        rows = rows.select(
            *keys, "id", "parent", F.col("far").alias("jump"), (F.col("depth") + F.coalesce("far_depth", F.lit(0))).alias("depth"),
            F.coalesce("far_root", "root").alias("root"), (F.col("n_below") + F.coalesce("add_n", F.lit(0))).alias("n_below"),
            *[(F.col(c) + F.coalesce(f"add_{c}", F.lit(0))).alias(c) for c in sums]).checkpoint(eager=True)
        left, rounds = rows.where("jump IS NOT NULL").count(), rounds + 1
    cycle = F.col("jump").isNotNull()
    return rows.select(*keys, F.col("id").alias(id_col), F.col("parent").alias(parent_col), F.when(~cycle, F.col("root")).alias("root"),
                       F.when(~cycle, F.col("depth")).alias("depth"), *[F.when(~cycle, F.col(c)).alias(n) for c, n in (("n_below", "n_below"), *((c, f"{c}_below") for c in sums))], cycle.alias("in_cycle"))


def self_times(spans: DataFrame, keys: list[str], id_col: str = "span_id", parent_col: str = "parent_id", start: str = "start", end: str = "end",
               bucket_us: int | None = I.DEFAULT_BUCKET_US) -> DataFrame:
    """Each span's own time: its duration without the parts in which a child is open.  Keys, id, duration, self_time.

    One shuffle by parent, in which its children's boundaries are walked: a hot parent is split into buckets of time like a hot run.
    A span without end, or reversed, has neither duration nor time of its own, and covers nothing of its parent.
    """
    whole = spans.where(F.col(end) >= F.col(start)).select(*keys, F.col(id_col).alias("of"), F.lit(True).alias("is_base"), F.col(start).alias("start"), F.col(end).alias("end"))
    inner = spans.where(F.col(parent_col).isNotNull()).select(*keys, F.col(parent_col).alias("of"), F.lit(False).alias("is_base"), F.col(start).alias("start"), F.col(end).alias("end"))
    own = I.subtract_total(whole.unionByName(inner), [*keys, "of"], F.col("is_base"), ~F.col("is_base"), "self_time", bucket_us).withColumnRenamed("of", id_col)
    duration = F.when(F.col(end) >= F.col(start), F.col(end) - F.col(start))
    out = spans.select(*keys, F.col(id_col), duration.alias("duration")).join(own, [*keys, id_col], "left")
    return out.withColumn("self_time", F.when(F.col("duration").isNotNull(), F.coalesce("self_time", F.lit(0).cast("long"))))
