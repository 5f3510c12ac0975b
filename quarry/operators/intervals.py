"""Interval algebra on DataFrames.

Intervals are rows ``(keys..., start, end)`` in integer microseconds.  All operators
are one sweep over the intervals' boundaries: a span row becomes a start and an end
row by one ``inline``, each with a vector of deltas (one entry per side that the span
belongs to), and running sums of the vector tell at each point which sides are open
before it and after it.  Unions and differences are the points where that state changes.

Ordered scans are done in two levels: inside a (key, bucket) window, plus a
per-bucket offset from a window over the buckets of the key.  Buckets are fitted to the
data: rows are range-partitioned by key and time, so a run with a third of all spans,
or a burst within a second, is spread over many tasks.  Only rows of one key and one microsecond stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET_US = None  # buckets are fitted to the data; a number is a fixed width in time
ROWS_PER_BUCKET = 1_000_000
KEY_ROWS = 1_000_000  # rows of a key that are ordered by one task
KEY_CELLS = 1 << 16  # hash cells in which large keys are looked for first


def bucketed(df: DataFrame, keys: list[str], order: str, bucket_us: int | None = DEFAULT_BUCKET_US) -> DataFrame:
    """``df`` checkpointed, with ``bucket``: monotone in ``order`` within ``keys``, of about ``ROWS_PER_BUCKET`` rows.

    The input is evaluated once; sizes and bounds of the buckets are taken from its checkpoint.
    """
    if bucket_us is not None:
        return df.withColumn("bucket", F.floor(F.col(order) / F.lit(bucket_us)).cast("long")).checkpoint(eager=True)
    df = df.checkpoint(eager=True)
    n = -(-df.count() // ROWS_PER_BUCKET)
    if n <= 1:
        return df.withColumn("bucket", F.lit(0).cast("long"))
    return df.repartitionByRange(n, *keys, order).withColumn("bucket", F.spark_partition_id().cast("long")).checkpoint(eager=True)


def running(df: DataFrame, keys: list[str], order: list, values: dict[str, str],
            how: str = "sum", bucket: str = "bucket", exclusive: bool = False) -> DataFrame:
    """Add running aggregates ``{out: value_col}`` over ``order`` within ``keys``.

    ``how`` is ``sum`` or ``max``; ``exclusive`` leaves out the current row.
    ``bucket`` must be monotone in ``order`` (a time bucket of the order key).
    """
    agg = F.sum if how == "sum" else F.max
    per_b = df.groupBy(*keys, bucket).agg(*[agg(v).alias(f"_b_{o}") for o, v in values.items()])
    wb = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offs = per_b.select(*keys, bucket, *[agg(f"_b_{o}").over(wb).alias(f"_off_{o}") for o in values])
    wr = (Window.partitionBy(*keys, bucket).orderBy(*order)
          .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0))
    d = df.select("*", *[agg(v).over(wr).alias(f"_in_{o}") for o, v in values.items()])
    d = d.join(offs, [*keys, bucket], "left")
    outs = {}
    for o in values:
        if how == "sum":
            outs[o] = F.coalesce(F.col(f"_in_{o}"), F.lit(0)) + F.coalesce(F.col(f"_off_{o}"), F.lit(0))
        else:
            outs[o] = F.greatest(F.col(f"_in_{o}"), F.col(f"_off_{o}"))
    d = d.withColumns(outs)
    return d.drop(*[f"_in_{o}" for o in values], *[f"_off_{o}" for o in values])


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with ``no``, the row's number from 1 in ``order`` within ``keys``, and ``n``, the rows of its key.

    One shuffle by key.  Keys of more than ``KEY_ROWS`` rows, of which there are few, are numbered in two levels.
    """
    w = Window.partitionBy(*keys)
    alone = lambda rows: rows.withColumn("no", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("n", F.count(F.lit(1)).over(w))
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > KEY_ROWS).dropna(subset=keys).checkpoint(eager=True)
    if large.isEmpty():
        return alone(df)
    large = F.broadcast(large)
    parted = bucketed(df.join(large, keys).withColumn("_one", F.lit(1)), keys, order[0])
    parted = running(parted, keys, order, {"no": "_one"}).select(*df.columns, F.col("no").cast("long").alias("no"), "n")
    return alone(df.join(large, keys, "left_anti")).unionByName(parted)


def next_value(df: DataFrame, keys: list[str], order: str, out: str = "next",
               bucket: str = "bucket") -> DataFrame:
    """``lead(order)`` within ``keys``, two-level: in the bucket, else the next bucket's first."""
    first = df.groupBy(*keys, bucket).agg(F.min(order).alias("_first"))
    wb = Window.partitionBy(*keys).orderBy(bucket)
    nxt = first.select(*keys, bucket, F.lead("_first").over(wb).alias("_next_first"))
    w = Window.partitionBy(*keys, bucket).orderBy(order)
    return (df.withColumn("_lead", F.lead(order).over(w))
            .join(nxt, [*keys, bucket], "left")
            .withColumn(out, F.coalesce("_lead", "_next_first"))
            .drop("_lead", "_next_first"))


def points(spans: DataFrame, keys: list[str], sides: dict[str, Column], start: str = "start", end: str = "end",
           open_ends: bool = False) -> DataFrame:
    """Boundary points: keys, t, and per side d_<side> (opened minus closed at t) and s_<side> (opened at t).

    ``sides`` maps a name to a condition on a span.  Null or reversed intervals count on
    no side; with ``open_ends`` an interval without end only opens.  ``lo`` and ``hi``: the least start and the greatest end (or
    start) of all rows at t, whatever their side.
    """
    whole = F.col(start).isNotNull() & (F.col(end) >= F.col(start))
    counts = F.coalesce(whole | (F.col(end).isNull() & F.col(start).isNotNull() if open_ends else F.lit(False)), F.lit(False))
    flags = [F.when(counts & cond, F.lit(1)).otherwise(F.lit(0)).alias(f"f_{n}") for n, cond in sides.items()]
    hi = F.coalesce(F.col(end), F.col(start))
    both = F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("sign"), F.col(start).alias("lo"), hi.alias("hi")),
                   F.struct(F.col(end).alias("t"), F.lit(-1).alias("sign"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi")))
    rows = spans.select(*keys, *flags, F.inline(both)).where(F.col("t").isNotNull())
    return rows.groupBy(*keys, "t").agg(
        *[F.sum(F.col("sign") * F.col(f"f_{n}")).alias(f"d_{n}") for n in sides],
        *[F.sum(F.when(F.col("sign") > 0, F.col(f"f_{n}")).otherwise(0)).alias(f"s_{n}") for n in sides],
        F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def sweep(spans: DataFrame, keys: list[str], sides: dict[str, Column], start: str = "start", end: str = "end",
          bucket_us: int | None = DEFAULT_BUCKET_US, open_ends: bool = False) -> DataFrame:
    """``points`` in order, with b_<side> and c_<side>: intervals of a side open before t and from t on."""
    pts = bucketed(points(spans, keys, sides, start, end, open_ends), keys, "t", bucket_us)
    pts = running(pts, keys, ["t"], {f"c_{n}": f"d_{n}" for n in sides}, how="sum")
    return pts.withColumns({f"b_{n}": F.col(f"c_{n}") - F.col(f"d_{n}") for n in sides})


def _stretches(swept: DataFrame, keys: list[str], opens: Column, closes: Column, start: str, end: str, to_last: bool = False) -> DataFrame:
    """From each opening point to the next closing one (which may be the same point).

    ``to_last``: what never closes ends at the key's last point.
    """
    flags = [opens.alias("opens"), closes.alias("closes")]
    edges = swept.select(*keys, "bucket", "t", *flags).where("opens OR closes").checkpoint(eager=True)
    edges = next_value(edges, keys, "t").where("opens")
    stop = F.when(F.col("closes"), F.col("t")).otherwise(F.col("next"))
    if to_last:
        last = swept.groupBy(*keys).agg(F.max("t").alias("last"))
        edges = edges.join(last, keys)
        stop = F.coalesce(stop, F.col("last"))
    return edges.select(*keys, F.col("t").alias(start), stop.alias(end))


def union(df: DataFrame, keys: list[str], start: str = "start", end: str = "end",
          bucket_us: int | None = DEFAULT_BUCKET_US) -> DataFrame:
    """Merged union per key.  Null or reversed intervals are dropped; touching ones merge; one of no length stays where it stands alone."""
    swept = sweep(df, keys, {"u": F.lit(True)}, start, end, bucket_us)
    opens = (F.col("b_u") == 0) & (F.col("s_u") > 0)
    closes = (F.col("c_u") == 0) & (F.col("b_u") + F.col("s_u") > 0)
    return _stretches(swept, keys, opens, closes, start, end)


def total(df: DataFrame, keys: list[str], start: str = "start", end: str = "end",
          out: str = "total") -> DataFrame:
    """T4: total length of (already merged) intervals per key."""
    return df.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias(out))


def subtract_sides(spans: DataFrame, keys: list[str], base: Column, other: Column, bucket_us: int | None = DEFAULT_BUCKET_US,
                   open_ends: bool = False) -> DataFrame:
    """T5 on one table of spans: those of ``base`` minus those of ``other``, merged.  One scan of the spans, one sweep.

    With ``open_ends`` spans without end run to the key's last point.  Pieces of no length are left out.
    """
    swept = sweep(spans, keys, {"b": base, "o": other}, bucket_us=bucket_us, open_ends=open_ends)
    inside = lambda at: (F.col(f"{at}_b") > 0) & (F.col(f"{at}_o") == 0)
    found = _stretches(swept, keys, inside("c") & ~inside("b"), inside("b") & ~inside("c"), "start", "end", to_last=open_ends)
    return found.where("end > start")


def _large_keys(df: DataFrame, keys: list[str]) -> DataFrame | None:
    """Keys of more than ``KEY_ROWS`` rows, of which there are few; None if there are none.  Only keys of a hash cell with that many rows are counted."""
    celled = df.select(*keys, F.pmod(F.xxhash64(*keys), F.lit(KEY_CELLS)).alias("_cell"))
    full = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > KEY_ROWS).select("_cell").checkpoint(eager=True)
    if full.isEmpty():
        return None
    counted = celled.join(F.broadcast(full), "_cell", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    large = counted.where(F.col("n") > KEY_ROWS).select(*keys).checkpoint(eager=True)
    return None if large.isEmpty() else F.broadcast(large)


def subtract_total(spans: DataFrame, keys: list[str], base: Column, other: Column, out: str = "total", bucket_us: int | None = DEFAULT_BUCKET_US) -> DataFrame:
    """``total`` of ``subtract_sides``: keys, out; a key of which nothing is left may be missing, and null keys are left out.

    One shuffle by key, in which a key's boundaries are walked in order of time: only the last of those at one time has a
    length to the next.  Keys of more than ``KEY_ROWS`` rows are swept in buckets of time.
    """
    spans = spans.where(F.col("end") >= F.col("start")).dropna(subset=keys)

    def alone(rows: DataFrame) -> DataFrame:
        sides = rows.select(*keys, base.cast("int").alias("b"), other.cast("int").alias("o"), "start", "end").repartition(*keys)
        ends = F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("sign")))
        w = Window.partitionBy(*keys).orderBy("t")
        to_here = w.rowsBetween(Window.unboundedPreceding, 0)
        walked = sides.select(*keys, "b", "o", F.inline(ends)).select(
            *keys, "t", F.lead("t").over(w).alias("next"), *[F.sum(F.col("sign") * F.col(c)).over(to_here).alias(c) for c in ("b", "o")])
        return walked.where("b > 0 AND o = 0").groupBy(*keys).agg(F.sum(F.col("next") - F.col("t")).alias(out))

    swept = lambda rows: total(subtract_sides(rows, keys, base, other, bucket_us), keys, out=out)
    if bucket_us is not None:
        return swept(spans)
    large = _large_keys(spans, keys)
    if large is None:
        return alone(spans)
    return alone(spans.join(large, keys, "left_anti")).unionByName(swept(spans.join(large, keys, "left_semi")))


def subtract(base: DataFrame, other: DataFrame, keys: list[str],
             bucket_us: int | None = DEFAULT_BUCKET_US) -> DataFrame:
    """T5: base minus other, merged.  No range join: one sweep over both boundary sets."""
    both = (base.select(*keys, "start", "end", F.lit(True).alias("is_base"))
            .unionByName(other.select(*keys, "start", "end", F.lit(False).alias("is_base"))))
    return subtract_sides(both, keys, F.col("is_base"), ~F.col("is_base"), bucket_us)


def breakdown(spans: DataFrame, bounds: DataFrame | None, keys: list[str],
              bucket_us: int | None = DEFAULT_BUCKET_US) -> DataFrame:
    """Per key total, llm, spark, tool overhead and orchestration time (microseconds).

    ``spans``: keys, type in (llm, tool, spark), start, end; a span without end runs to the run's end (T2).
    ``bounds``: keys, run_start, run_end; None: from the first start to the last known end, in the same scan.
    Tool overhead = tool union minus the union of llm and spark; orchestration = max(0, total - llm - spark - tool).
    ``llm_spark_overlap`` is the time where llm and spark spans overlap (D14).

    A state's length is the sum of the points that close it minus the sum of those that
    open it, so no point needs to know the next one.
    """
    sides = ("llm", "spark", "tool")
    swept = sweep(spans, keys, {t: F.col("type") == t for t in sides}, bucket_us=bucket_us, open_ends=True)

    def states(at):
        llm, spark, tool = (at(t) > 0 for t in sides)
        return {"llm_us": llm, "spark_us": spark, "tool_overhead_us": tool & ~llm & ~spark, "llm_spark_overlap_us": llm & spark}

    before, after = states(lambda t: F.col(f"b_{t}")), states(lambda t: F.col(f"c_{t}"))
    exact = lambda c: c.cast("decimal(38,0)")  # noqa: E731  many points of one kind may lie in one partial sum
    change = {n: F.sum(exact(F.col("t") * (before[n].cast("int") - after[n].cast("int")))).alias(n) for n in before}
    parts = swept.groupBy(*keys).agg(*change.values(), *[F.sum(f"d_{t}").alias(f"left_{t}") for t in sides],
                                     F.min("lo").alias("run_lo"), F.max("hi").alias("run_hi"))
    if bounds is None:
        parts = parts.withColumns({"run_start": F.col("run_lo"), "run_end": F.col("run_hi")})
    else:
        parts = bounds.select(*keys, "run_start", "run_end").join(parts, keys, "left")
    still = states(lambda t: F.col(f"left_{t}"))  # what never closed ends with the run
    out = parts.select(*keys, (F.col("run_end") - F.col("run_start")).alias("total_us"), *[
        F.coalesce((F.col(n) + F.when(still[n], F.col("run_end")).otherwise(0)).cast("long"), F.lit(0)).alias(n) for n in before])
    return out.withColumn("orchestration_us", F.greatest(
        F.lit(0), F.col("total_us") - F.col("llm_us") - F.col("spark_us") - F.col("tool_overhead_us")))
