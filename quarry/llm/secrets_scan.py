"""Secret scan: fixed patterns, and a randomness test battery for strings of unknown form.

Spans are found by pattern; their offsets follow from the lengths of the matches
and of the text between them.  A long string of encoding characters is tested for
randomness under the encoding that its characters suggest: chi-squared
uniformity over the alphabet, runs above and below its middle, and serial
correlation of neighbours.  The three are joined to one p-value, and per encoding
and length the strings that are no random data are told by the
Benjamini-Hochberg step at level ``FDR`` over all documents: at most that share of
the dismissed strings is expected to have been random.

What is not dismissed must also be told from words, which short strings of
letters need: the tests have no power there.  A string is scored by how common its
pairs of neighbouring letters and digits are among all pairs of the documents; its p-value is the share, in the mean of all documents, of
equally long stretches of a document's own words, which are cut into such stretches as a whole, that score as low, and a second
Benjamini-Hochberg step at the same level reports the spans: at most that share of
them is expected to be words.

DataFrame functions only.  Documents are row-local; the corpus enters by three
tables of counts (per encoding, length class and bin; per pair of letters; per
length and score bin), all bounded by construction and counted over every document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col_of, let, stored

#: The base patterns, what a match must have, and the order of kinds.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: The alphabets in the order of their digits, most special first; a string has the first that holds it.
DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = [
    ("decimal", DIGITS, "^[0-9]+$"),
    ("hex", DIGITS + "abcdef", "^[0-9a-f]+$"),
    ("hex upper", DIGITS + "ABCDEF", "^[0-9A-F]+$"),
    ("lower", SMALL, "^[a-z]+$"),
    ("upper", LARGE, "^[A-Z]+$"),
    ("base32", LARGE + "234567", "^[A-Z2-7]+$"),
    ("base62", LARGE + SMALL + DIGITS, "^[A-Za-z0-9]+$"),
    ("base64", LARGE + SMALL + DIGITS + "+/", "^[A-Za-z0-9+/]+$"),
    ("base64 url", LARGE + SMALL + DIGITS + "-_", "^[A-Za-z0-9_-]+$"),
    ("mixed", LARGE + SMALL + DIGITS + "+/-_", "^[A-Za-z0-9+/_-]+$"),
]
FDR = 0.05
BINS = 60  # of -log2 p, the last open
LENGTH_CLASSES = [24, 28, 32, 40, 48, 64, 96, 128, 256]
#: Letters and digits of the word score, the lengths of the stretches that words are cut into (a longer string is
#: compared with the longest), and the score's bins, eight to a bit.
PAIRED = SMALL + DIGITS
SIZES = [8, 12, 16, 20, 24, 28, 32, 40, 48, 64]
SCORE_BINS = 256
#: A step that divides all lengths, and a piece of words that all of them divide: long texts are cut there, and no stretch is.
STEP, PIECE = math.gcd(*SIZES), math.lcm(*SIZES)
#: All documents weigh alike, whatever their length: a document's weight, which its pairs or stretches share.  Whole, so that sums are exact.
WEIGHT = 1 << 34


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, end, found), offsets in code points; found is the group's text."""
    def spans(t: Column) -> Column:
        whole, between = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
        found = whole if group == 0 else F.regexp_extract_all(t, F.lit(pattern), F.lit(group))
        sizes = F.zip_with(F.transform(whole, F.length), F.transform(F.slice(between, 1, F.size(whole)), F.length),
                           lambda w, b: F.struct(w.alias("w"), b.alias("b")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        placed = F.aggregate(sizes, start, lambda a, s: F.struct(
            (a["at"] + s["b"] + s["w"]).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + s["b"]).alias("start"), (a["at"] + s["b"] + s["w"]).alias("end")))).alias("out")),
            lambda a: a["out"])
        return F.zip_with(placed, found, lambda p, f: F.struct(p["start"].alias("start"), p["end"].alias("end"), f.alias("found")))

    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(text.rlike(pattern), let(text, spans)).otherwise(none)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution, by a rational approximation of erfc."""
    def tail(x: Column) -> Column:  # x >= 0
        t = 1 / (1 + 0.3275911 * x / 2 ** 0.5)
        poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        return poly * F.exp(-x * x / 2) / 2

    return let(z, lambda v: F.when(v >= 0, tail(F.abs(v))).otherwise(1 - tail(F.abs(v))))


def encoding_of(token: Column) -> Column:
    """Name and alphabet of the most special encoding that holds a string."""
    out = F.lit(None).cast("struct<name:string,alphabet:string>")
    for name, alphabet, form in reversed(ALPHABETS):
        out = F.when(token.rlike(form), F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("alphabet"))).otherwise(out)
    return out


def _uniformity(token: Column, alphabet: Column) -> Column:
    """Chi-squared test, upper tail, by the Wilson-Hilferty cube root."""
    a, n = F.length(alphabet), F.length(token)
    squares = F.aggregate(F.sequence(F.lit(1), a), F.lit(0.0),
                          lambda s, k: s + F.pow((n - F.length(F.replace(token, F.substring(alphabet, k, F.lit(1)), F.lit("")))).cast("double"), F.lit(2.0)))
    spread = 2 / (9.0 * (a - 1))
    return let((squares * a / n - n) / (a - 1), lambda x: _upper_tail((F.pow(F.greatest(x, F.lit(0.0)), F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread)))


def _runs(values: Column, a: Column) -> Column:
    """Wald-Wolfowitz runs above and below the alphabet's middle, two-sided; 0 if all are on one side."""
    def test(high: Column) -> Column:
        n = F.size(high).cast("double")
        up = F.aggregate(high, F.lit(0.0), lambda s, x: s + x)
        changes = F.aggregate(F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high) - 1), lambda x, y: F.abs(x - y)),
                              F.lit(0.0), lambda s, x: s + x)
        return let(2 * up * (n - up), lambda m: F.when(m == 0, F.lit(0.0)).otherwise(
            F.least(F.lit(1.0), 2 * _upper_tail(F.abs(changes - m / n) / F.sqrt(F.greatest(m * (m - n) / (n * n * (n - 1)), F.lit(1e-9)))))))

    return let(F.transform(values, lambda v: F.when(2 * v >= a, 1.0).otherwise(0.0)), test)


def _serial(values: Column) -> Column:
    """Correlation of neighbours, two-sided; 0 if all values are equal."""
    def test(x: Column) -> Column:
        square = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
        lagged = F.aggregate(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        return F.when(square == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), 2 * _upper_tail(F.abs(lagged / square) * F.sqrt(F.size(x)))))

    def centred(v: Column) -> Column:
        return let(F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean))

    return let(centred(values), test)


def random_p(token: Column) -> Column:
    """(name, size, p): encoding, length without padding, and the joint p-value of the three tests under randomness."""
    def joint(t: Column, e: Column) -> Column:
        def of(values: Column) -> Column:
            least = F.least(_uniformity(t, e["alphabet"]), _runs(values, F.length(e["alphabet"])), _serial(values))
            p = 1 - F.pow(1 - least, F.lit(3.0))  # of three, the smallest
            return F.struct(e["name"].alias("name"), F.length(t).alias("size"), p.alias("p"))

        digits = F.transform(F.sequence(F.lit(1), F.length(t)), lambda k: (F.instr(e["alphabet"], F.substring(t, k, F.lit(1))) - 1).cast("double"))
        return let(digits, of)

    return let(F.rtrim(token, F.lit("=")), lambda t: let(encoding_of(t), lambda e: joint(t, e)))


def length_class(size: Column) -> Column:
    out = F.lit(len(LENGTH_CLASSES))
    for k in reversed(range(len(LENGTH_CLASSES))):
        out = F.when(size < LENGTH_CLASSES[k], F.lit(k)).otherwise(out)
    return out


def p_bin(p: Column) -> Column:
    """-log2 p in whole steps; a bin's p-values are at most 2^-bin."""
    return F.least(F.lit(BINS - 1), F.floor(-F.log2(F.greatest(p, F.lit(1e-300))))).cast("int")


def first_dismissed(n: list[int]) -> int | None:
    """Benjamini-Hochberg over p-values counted by bin: the first bin from which on all are dismissed, the largest set whose
    worst p-value is small enough for its share."""
    return next((b for b in range(len(n)) if 2.0 ** -b <= FDR * sum(n[b:]) / sum(n)), None)


def dismissed_bins(found: DataFrame) -> dict[str, int]:
    """Per class the first bin that is dismissed.

    ``found`` has a row per candidate with its class and bin.  Counts are summed over all documents;
    the table has at most one row per encoding, length class and bin.
    """
    counts: dict[str, list[int]] = {}
    for r in found.groupBy("class", "bin").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["class"], [0] * BINS)[r["bin"]] = r["n"]
    first = {c: first_dismissed(n) for c, n in counts.items()}
    return {c: b for c, b in first.items() if b is not None}


def bare(token: Column) -> Column:
    """Letters and digits of a string, lower case."""
    return F.lower(F.regexp_replace(token, "[^A-Za-z0-9]+", ""))


def pairs_of(token: Column) -> Column:
    """Numbers, from 0 on, of the pairs of neighbours of a string of ``PAIRED``."""
    place = lambda c: F.when(c >= ord("a"), c - ord("a")).otherwise(c - ord("0") + len(SMALL))
    codes = F.transform(F.split(token, ""), lambda c: place(F.ascii(c)))
    return let(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: x * len(PAIRED) + y))


def word_pairs(text: Column) -> Column:
    """All of a text's own words, written without blanks, as pairs of neighbours; candidates are left out.

    The words are a ring, which short texts go round more than once.  It is cut into pieces of ``PIECE`` letters; a piece has the pairs that
    begin at its own letters, then those of the letters after it that the last stretch of each length may need.
    """
    longest = SIZES[-1]

    def cut(glued: Column) -> Column:
        ring = F.substring(F.repeat(glued, F.floor(longest / F.length(glued)).cast("int") + 1), 1, longest)
        after = lambda p, k: F.coalesce(F.substring(F.get(p, k + 1), 1, longest), F.lit(""))
        whole = lambda p: F.transform(p, lambda x, k: F.struct(
            F.length(x).alias("n"), pairs_of(F.concat(x, F.substring(F.concat(after(p, k), ring), 1, longest))).alias("pairs")))
        return F.when(F.length(glued) >= SIZES[0], let(F.regexp_extract_all(glued, F.lit(f".{{1,{PIECE}}}"), F.lit(0)), whole))

    return F.coalesce(let(F.lower(F.regexp_replace(text, CANDIDATE + "|[^A-Za-z0-9]+", "")), cut), F.array().cast("array<struct<n:int,pairs:array<int>>>"))


def shared_weight(parts: Column) -> Column:
    return F.round(F.lit(WEIGHT) / parts).cast("long")


def letters(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda n, w: n + w["n"])


def by_share(weights: dict, n: int) -> dict:
    """``n`` things dealt out in proportion to whole weights."""
    total = sum(weights.values())
    return {k: n * (w / total) for k, w in weights.items()}


def pair_scores(rows: DataFrame) -> list[float]:
    """Per pair of characters the bits by which it is more common in the documents' words than among random characters.

    In steps of 2^-20, so that sums are exact in any order.
    """
    n = len(PAIRED) ** 2
    pieces = rows.select(F.explode("words").alias("w"), shared_weight(letters(F.col("words"))).alias("weight"))
    pairs = pieces.select("weight", F.explode(F.slice("w.pairs", F.lit(1), F.col("w.n"))).alias("pair"))
    found = pairs.groupBy("pair").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).collect()
    seen = sum(r["n"] for r in found)
    counts = by_share({r["pair"]: r["weight"] for r in found}, seen)
    total = seen + n / 2
    return [round(math.log2((counts.get(k, 0) + 0.5) / total * n) * 2 ** 20) / 2 ** 20 for k in range(n)]


def mean_bin(mean: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(SCORE_BINS - 1), F.floor(8 * mean).cast("int") + SCORE_BINS // 2))


def score_bin(scores: Column, size: Column) -> Column:
    """Bin of the mean score of the pairs of the first ``size`` characters."""
    return mean_bin(F.aggregate(F.slice(scores, 1, size - 1), F.lit(0.0), lambda s, x: s + x) / (size - 1))


def word_scores(token: Column, scores: Column) -> Column:
    return F.transform(pairs_of(token), lambda p: F.get(scores, p))


def stretch_bins(piece: Column, scores: Column) -> Column:
    """Of a piece of words, the place in ``SIZES`` and the score bin of each of the stretches that it is cut into, as place * SCORE_BINS + bin.

    Every length cuts the whole piece.  A stretch is as many steps as fit its length, less the pair that leads out of it.
    """
    def cut(s: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / STEP).cast("int") - 1),
                            lambda j: sum((F.get(s, j * STEP + k) for k in range(1, STEP)), F.get(s, j * STEP)))

        def of_size(place: int, size: int, summed: Column) -> Column:
            of = size // STEP
            total = lambda i: sum((F.get(summed, i * of + k) for k in range(1, of)), F.get(summed, i * of)) - F.get(s, i * size + size - 1)
            return F.transform(F.sequence(F.lit(0), F.floor((piece["n"] - 1) / size).cast("int")),
                               lambda i: mean_bin(total(i) / (size - 1)) + place * SCORE_BINS)

        return let(steps, lambda b: F.concat(*[of_size(k, n, b) for k, n in enumerate(SIZES)]))

    return let(F.transform(piece["pairs"], lambda p: F.get(scores, p)), cut)


def size_class(size: Column) -> Column:
    """Place in ``SIZES`` of the longest stretch that is no longer; null for a shorter string."""
    out = F.lit(None).cast("int")
    for k, least in enumerate(SIZES):
        out = F.when(size >= least, F.lit(k)).otherwise(out)
    return out


def least_word_like(n: dict[tuple[int, int], int], of_words: dict[int, list[float]], tested: int) -> set[tuple[int, int]]:
    """Benjamini-Hochberg over strings counted by (length, score bin): those that are no words.

    A string's p-value is the share of the stretches of its length that score as low; ``tested`` counts all strings, also those that cannot be
    spans.  Without stretches nothing can be told.
    """
    def p_value(size: int, b: int) -> float:
        words = of_words.get(size, [0])
        return (1 + sum(words[:b + 1])) / (1 + sum(words))

    passed, best = 0, 0.0
    ranked = sorted((p_value(*key), key) for key in n)
    for k, (p, key) in enumerate(ranked):
        passed += n[key]
        if (k + 1 == len(ranked) or ranked[k + 1][0] > p) and p <= FDR * passed / tested:
            best = p
    return {key for p, key in ranked if p <= best}


def reported(found: DataFrame, words: DataFrame) -> list[tuple[str, int, int]]:
    """(class, length, score bin) of the strings that are reported.

    ``found`` has a row per candidate: class, size, score, and whether it passes for random; ``words`` one per stretch
    and length: size, score, weight.
    """
    weights: dict[int, dict[int, int]] = {}
    n: dict[int, int] = {}
    for r in words.groupBy("size", "score").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).collect():
        weights.setdefault(r["size"], {})[r["score"]] = r["weight"]
        n[r["size"]] = n.get(r["size"], 0) + r["n"]
    of_words = {k: [shares.get(b, 0) for b in range(SCORE_BINS)] for k, shares in ((k, by_share(w, n[k])) for k, w in weights.items())}
    tested: dict[str, int] = {}
    passing: dict[str, dict[tuple[int, int], int]] = {}
    for r in found.groupBy("class", "size", "score", "passes").agg(F.count("*").alias("n")).collect():
        tested[r["class"]] = tested.get(r["class"], 0) + r["n"]
        if r["passes"] and r["size"] is not None:
            passing.setdefault(r["class"], {})[r["size"], r["score"]] = r["n"]
    return sorted((c, *key) for c, n in passing.items() for key in least_word_like(n, of_words, tested[c]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base and spans, each an array of (start, order, end, kind, found) by start and order.

    base has what the three fixed patterns match, per kind leftmost and not
    overlapping, without matches that are too short; spans has these and the random strings that overlap
    none of them and are told from words.  Offsets are code points, ends exclusive.  Null or empty text: no
    spans.  Null ids and repeated rows are scanned like any row (repeated rows count again in the
    thresholds).  Other input columns are ignored.  Empty table: no rows.
    """
    def kept(found: Column, kind: int, least: int) -> Column:
        long = F.filter(found, lambda x: F.length(x["found"]) >= least)
        return F.transform(long, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("order"), x["end"].alias("end"),
                                                    F.lit(KINDS[kind]).alias("kind"), x["found"].alias("found")))

    rows = docs.select(col_of(docs, id_col).alias("id"), F.coalesce(col_of(docs, text_col), F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.select("id", matches(text, ASSIGN, 2).alias("a"), matches(text, ACCESS).alias("k"), matches(text, f"{HEX[:-1]}{{{MIN_HEX},}}").alias("x"),
                       matches(text, CANDIDATE).alias("c"), word_pairs(text).alias("words"))
    rows = rows.select("id", "words", "c", F.array_sort(F.concat(kept(F.col("a"), 0, MIN_ASSIGN), kept(F.col("k"), 1, MIN_ACCESS), kept(F.col("x"), 2, MIN_HEX))).alias("base"))
    fresh = F.filter("c", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rows = rows.select("id", "words", "base", F.transform(fresh, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("order"), c["end"].alias("end"),
                                                                                    F.lit("random").alias("kind"), c["found"].alias("found"))).alias("c"))
    scored = F.transform("c", lambda c: let(random_p(c["found"]), lambda t: F.struct(
        c.alias("span"), F.concat_ws("/", t["name"], length_class(t["size"]).cast("string")).alias("class"), p_bin(t["p"]).alias("bin"))))
    rows = stored(rows.select("id", "words", "base", scored.alias("c")), "secrets")
    found = rows.where(F.size("c") > 0)
    first = dismissed_bins(found.select(F.explode("c").alias("c")).select("c.class", "c.bin"))
    if not first and found.isEmpty():
        return rows.select("id", "base", F.col("base").alias("spans"))
    limit = F.create_map(*[F.lit(v) for kv in sorted(first.items()) for v in kv]) if first else F.create_map().cast("map<string,int>")
    scores = F.lit(pair_scores(rows))

    def judged(c: Column) -> Column:
        def of(token: Column) -> Column:
            k = size_class(F.length(token))
            score = F.when(k.isNotNull(), let(word_scores(token, scores), lambda s: score_bin(s, F.size(s) + 1)))
            passes = c["bin"] < F.coalesce(F.try_element_at(limit, c["class"]), F.lit(BINS))
            return F.struct(c["span"].alias("span"), c["class"].alias("class"), k.alias("size"), score.alias("score"), passes.alias("passes"))

        return let(bare(c["span"]["found"]), of)

    shares = let(letters(F.col("words")), lambda n: F.array(*[shared_weight(F.ceil(n / size)) for size in SIZES]))
    stretch = rows.select(F.explode("words").alias("w"), shares.alias("shares")).select("shares", F.explode(stretch_bins(F.col("w"), scores)).alias("b"))
    words = stretch.select("shares", F.shiftright("b", SCORE_BINS.bit_length() - 1).alias("size"), (F.col("b") % SCORE_BINS).alias("score"))
    words = words.select("size", "score", F.get("shares", F.col("size")).alias("weight"))
    told = reported(found.select(F.explode(F.transform("c", judged)).alias("c")).select("c.class", "c.size", "c.score", "c.passes"), words)
    keys = F.array(*[F.lit(f"{c} {k} {b}") for c, k, b in told]) if told else F.array().cast("array<string>")
    more = F.transform(F.filter(F.transform("c", judged), lambda c: c["passes"] & F.coalesce(
        F.array_contains(keys, F.concat_ws(" ", c["class"], c["size"].cast("string"), c["score"].cast("string"))), F.lit(False))), lambda c: c["span"])
    return rows.select("id", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
