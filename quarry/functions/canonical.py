"""Canonical cell values for result-set comparison (E1, E2) as Column expressions.

Rules, in order: null -> token; text is trimmed; integer text -> digits without
sign '+' or leading zeros; numeric text or number whose value is whole ->
integer text; null words -> token; anything else -> the trimmed text.
Everything is a built-in expression (codegen, no Python per row).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values
NULL_TOKEN = "__NULL__"
NULL_WORDS = ["none", "null", "nan", "na", "n/a"]
INT_RE = r"^[+-]?[0-9]+$"
NUM_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
#: White space as text libraries strip it: blanks, separators, the no-break and the wide spaces.
SPACES = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
TRIM_RE = "^" + SPACES + "|" + SPACES + "$"
#: Most cells are one of these, told by one look: texts that stay as they are (digits, or words without blanks that are no null word) ...
AS_IS_RE = r"^(?:0|-?[1-9][0-9]*|(?!(?i:none|null|nan|na|n/a)\z)[A-Za-z_][!-~]*)\z"
#: ... and whole numbers with zeros behind the point, of so few digits that a double holds them.
POINT_ZERO_RE = r"^(?:0|-?[1-9][0-9]{0,14})\.0+\z"
LONG_LIMIT = 2.0 ** 62  # doubles below it are whole longs; above, digits are worked out in limbs
LIMB = 1_000_000_000


def _large_text(d: Column) -> Column:
    """All digits of a double of 2^62 or more: a long times a power of two, multiplied out in limbs of nine digits, lowest first."""
    power = F.greatest(F.lit(0), F.floor(F.log2(d)).cast("int") - 53)
    first = (d / F.pow(F.lit(2.0), power)).cast("long")  # exact: a division by a power of two

    def times(acc: Column, factor: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            total = x * factor + s["carry"]
            return F.struct(F.array_append(s["out"], total % LIMB).alias("out"), F.call_function("div", total, F.lit(LIMB)).alias("carry"))

        start = F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("long").alias("carry"))
        return F.aggregate(acc, start, step, lambda s: F.when(s["carry"] > 0, F.array_append(s["out"], s["carry"])).otherwise(s["out"]))

    split = F.array(first % LIMB, F.call_function("div", first, F.lit(LIMB)))
    # 20 doublings at a time: a limb times 2^20 stays far below a long
    steps = F.when(power == 0, F.array().cast("array<int>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.floor((power - 1) / 20).cast("int")), lambda k: F.least(F.lit(20), power - 20 * k)))
    done = F.aggregate(steps, split, lambda acc, n: times(acc, F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))))
    text = F.array_join(F.transform(F.reverse(done), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.regexp_replace(text, "^0+", "")


def _whole_text(d: Column) -> Column:
    """Integer text of a whole double, every digit exact."""
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))) & ((d % F.lit(1.0)) == 0)
    sign = F.when(d < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(ok, F.when(F.abs(d) < F.lit(LONG_LIMIT), d.cast("long").cast("string"))
                  .otherwise(F.concat(sign, _large_text(F.abs(d)))))


def canonical_text(c: Column) -> Column:
    """E1 for text values."""
    s = F.regexp_replace(c, TRIM_RE, "")
    digits = F.regexp_replace(s, r"^[+-]?0*", "")
    int_txt = (F.when(digits == "", F.lit("0"))
               .when(s.startswith("-"), F.concat(F.lit("-"), digits)).otherwise(digits))
    d = F.when(s.rlike(NUM_RE), s.try_cast("double"))
    whole = _whole_text(d)
    return (F.when(c.isNull(), F.lit(NULL_TOKEN))
            .when(s.rlike(INT_RE), int_txt)
            .when(whole.isNotNull(), whole)
            .when(F.lower(s).isin(*NULL_WORDS), F.lit(NULL_TOKEN))
            .otherwise(s))


def canonical(c: Column, dtype: T.DataType) -> Column:
    """E1 for a column of type ``dtype`` (typed values stay typed, D9)."""
    if isinstance(dtype, T.StringType):
        return canonical_text(c)
    if isinstance(dtype, T.BooleanType):
        return F.when(c.isNull(), F.lit(NULL_TOKEN)).otherwise(c.cast("int").cast("string"))
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.when(c.isNull(), F.lit(NULL_TOKEN)).otherwise(c.cast("string"))
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = c.cast("double")
        return (F.when(c.isNull() | F.isnan(d), F.lit(NULL_TOKEN))
                .otherwise(F.coalesce(_whole_text(d), d.cast("string"))))
    return canonical_text(c.cast("string"))


def canonicalize(df, specs: list[tuple[str, Column, T.DataType]], relaxed_mode: bool = False):
    """Add one canonical column per ``(out, column, type)`` in four small projections.

    Same result as ``canonical`` but texts that are canonical already, or nearly, are told first, and the trimmed
    text and the parsed number of all others are computed once as helper columns, so each generated method stays
    small and whole-stage codegen is kept.
    """
    text = [(o, c) for o, c, t in specs if not _typed(t)]
    typed = [(o, c, t) for o, c, t in specs if _typed(t)]
    quick = lambda c: F.when(c.rlike(AS_IS_RE), c).when(c.rlike(POINT_ZERO_RE), F.substring_index(c, ".", 1))
    d0 = df.select("*", *[canonical(c, t).alias(o) for o, c, t in typed], *[c.cast("string").alias(f"_t_{o}") for o, c in text])
    d0 = d0.select("*", *[quick(F.col(f"_t_{o}")).alias(f"_q_{o}") for o, _ in text])
    d1 = d0.select("*", *[F.when(F.col(f"_q_{o}").isNull(), F.regexp_replace(f"_t_{o}", TRIM_RE, "")).alias(f"_s_{o}") for o, _ in text])
    d2 = d1.select("*", *[F.when(F.col(f"_s_{o}").rlike(NUM_RE), F.col(f"_s_{o}").try_cast("double"))
                          .alias(f"_d_{o}") for o, _ in text],
                   *[F.when(F.col(f"_s_{o}").rlike(INT_RE), F.regexp_replace(F.col(f"_s_{o}"), r"^[+-]?0*", ""))
                     .alias(f"_i_{o}") for o, _ in text])
    outs = []
    for o, _ in text:
        q, s, i = F.col(f"_q_{o}"), F.col(f"_s_{o}"), F.col(f"_i_{o}")
        int_txt = (F.when(i == "", F.lit("0")).when(s.startswith("-"), F.concat(F.lit("-"), i))
                   .otherwise(i))
        rest = F.coalesce(_whole_text(F.col(f"_d_{o}")),
                          F.when(F.lower(s).isin(*NULL_WORDS), F.lit(NULL_TOKEN)).otherwise(s))
        outs.append(F.when(q.isNotNull(), q).when(s.isNull(), F.lit(NULL_TOKEN)).when(i.isNotNull(), int_txt)
                    .otherwise(rest).alias(o))
    helpers = [f"_{k}_{o}" for o, _ in text for k in ("t", "q", "s", "d", "i")]
    d3 = d2.select("*", *outs).drop(*helpers)
    if relaxed_mode:
        d3 = d3.withColumns({o: F.lower(F.col(o)) for o, _, _ in specs})
    return d3


def _typed(t: T.DataType) -> bool:
    return not isinstance(t, T.StringType) and isinstance(
        t, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
            T.DoubleType, T.DecimalType))
