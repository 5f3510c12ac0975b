"""Workload mining (W1-W14): SQL text in a query log -> facts per statement, by flat rules over text.

1. Literals and comments are blanked, so that statements which differ in their values
   are one template.  Templates are few next to statements, and each is read once; a
   statement keeps its template's key and its literals.
2. A template is read by regular expressions only.  Innermost parentheses are peeled off, a layer at a time: those
   that hold a subquery become texts of their own, all others become brackets.  What is left has no nesting
   and is split at set operators and at clause words.
3. Names in a clause's text are taken by one pattern, and told apart by the words next to them: tables with their aliases,
   columns, neither.  Calls of aggregates are one pattern each.
4. The facts of a statement are its template's, by a join on the key; conditions get the statement's literals back.

No grammar is followed: what the rules do not see (more than ``MAX_LAYERS`` layers of parentheses, aggregates around three
layers of brackets) is not in the facts.  Statements that are no queries, and those whose parentheses do not match, are
rejected and stay visible in ``rejects``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let
from ..session import stored

# --------------------------------------------------------------------------
# Fixed values
# --------------------------------------------------------------------------
COMMENT_RE = r"--[^\n]*|/\*(?s:.*?)\*/"
LITERAL_RE = r"'[^']*(?:''[^']*)*'"
QUOTED_RE = r"""\"[^"]*(?:""[^"]*)*"|`[^`]*`"""
WORD_RE = r"[A-Za-z_][A-Za-z0-9_$]*"
NUMBER_RE = r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
NAME_RE = f"(?:{QUOTED_RE}|{WORD_RE})"
# The plain text between literals, quoted names and comments is taken in runs of words, each with the signs after it, and signs.
CHUNK_RE = (f"{COMMENT_RE}|{LITERAL_RE}|{QUOTED_RE}|{NUMBER_RE}"
            r"|(?:[\w&&\D][\w$]*+[^'\"`/\w-]*+|[^'\"`/\w-]++|-(?!-)|/(?!\*)){1,200}+|(?s:.)")

# Marks that stand in a template's text for what was there: a literal (with its number between two of them), the two
# sides of a bracket, a subquery, and the borders of a clause word.
LITERAL, OPEN, CLOSE, SUBQUERY, BORDER, BODY = (chr(0xE000 + k) for k in range(6))
MAX_LAYERS = 16
_FLAT = f"[^{OPEN}{CLOSE}]"
_IN_BRACKETS = f"(?:{_FLAT}++|{OPEN}(?:{_FLAT}++|{OPEN}{_FLAT}*+{CLOSE})*+{CLOSE})*+"
_OTHER_PARENTHESES = r"(?i)\((?!\s*(?:SELECT|WITH)\b)([^()]*)\)"
_SUBQUERY = r"(?i)\(\s*((?:SELECT|WITH)\b[^()]*)\)"
_SET_OPERATORS = r"(?i)\b(?:UNION|INTERSECT|EXCEPT)(?:\s+(?:ALL|DISTINCT))?\b"
_FRAME_END = f"(?:UNBOUNDED|CURRENT|{LITERAL}\\d+{LITERAL})\\s+(?:PRECEDING|FOLLOWING|ROW)"
_FRAMES = f"(?i)\\b(?:ROWS|RANGE)\\s+(?:BETWEEN\\s+)?{_FRAME_END}(?:\\s+AND\\s+{_FRAME_END})?"
_CLAUSES = (rf"(?i)\b(SELECT|FROM(?!{_FLAT}*{CLOSE})|(?:(?:NATURAL|INNER|CROSS|LEFT|RIGHT|FULL|OUTER)\s+)*JOIN|ON|USING|WHERE|GROUP\s+BY|HAVING"
            r"|ORDER\s+BY|LIMIT|OFFSET|WINDOW|FETCH|WITH)\b")
_TOKENS = f"{NAME_RE}(?:\\s*\\.\\s*(?:{NAME_RE}|\\*))*|{LITERAL}\\d+{LITERAL}|<>|!=|<=|>=|==|\\|\\||[=<>,*;+/%{OPEN}{CLOSE}{SUBQUERY}-]"

KEYWORDS = [
    "SELECT", "FROM", "WHERE", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "OUTER",
    "CROSS", "NATURAL", "ON", "USING", "GROUP", "BY", "ORDER", "HAVING", "LIMIT",
    "OFFSET", "UNION", "INTERSECT", "EXCEPT", "ALL", "AS", "AND", "OR", "NOT", "IN",
    "IS", "NULL", "LIKE", "ILIKE", "RLIKE", "ESCAPE", "BETWEEN", "CASE", "WHEN", "THEN", "ELSE", "END",
    "DISTINCT", "ASC", "DESC", "EXISTS", "TRUE", "FALSE", "WITH", "RECURSIVE", "OVER", "PARTITION",
    "FILTER", "WITHIN", "INTERVAL", "LATERAL", "WINDOW", "FETCH", "COLLATE",
]
COLUMN_CLAUSES = ["SELECT", "ON", "WHERE", "GROUP BY", "HAVING", "ORDER BY"]
VALUE_WORDS = ["END", "NULL", "TRUE", "FALSE"]
ARITHMETIC = ["+", "-", "*", "/", "%", "||"]
TRACKED_AGGREGATES = ["COUNT", "MAX", "MIN", "AVG"]
OPERATIONS = ["WHERE", "GROUP BY", "ORDER BY", "LIMIT"]
AGGREGATIONS = ["COUNT", "DISTINCT", "MAX", "MIN", "AVG"]
# Lint rules of the reference's query checker that are visible in the text.
LINT_NOT_IN_SUBQUERY = r"(?i)\bnot\s+in\s*\(\s*select\b"
LINT_UNION = r"(?i)\bunion\b"
LINT_UNION_ALL = r"(?i)\bunion\s+all\b"
LINT_BETWEEN = r"(?i)\bbetween\b"
LINT_DATA_CHANGING = r"(?i)^\s*(insert|update|delete|drop|alter|create|merge|truncate)\b"


def clean_sql(sql: Column) -> Column:
    """Literals blanked and comments dropped: whichever begins first, so a quote inside a comment opens nothing."""
    return F.regexp_replace(F.regexp_replace(sql, "(" + LITERAL_RE + ")|(?:" + COMMENT_RE + ")", "$1 "), LITERAL_RE, "''")


@dataclass
class MinedLog:
    """Which template each statement has, and the templates' facts."""

    statements: DataFrame  # query_id, template, literals
    templates: DataFrame   # template, reason, tables, columns, join_edges, implicit_edges, predicates, operations, aggregations; rows, known

    def of(self, ids: DataFrame) -> MinedLog:
        """The statements of some queries (query_id) only; templates, and how often the log has them, stay."""
        return MinedLog(self.statements.join(ids.select("query_id"), "query_id", "left_semi"), self.templates)

    @property
    def facts(self) -> DataFrame:
        """One row per statement with arrays of structs; conditions with the statement's own literals."""
        def own(edge: Column) -> Column:
            filled = F.aggregate(F.sequence(F.lit(0), F.size("literals") - 1), edge["condition"], lambda text, k: F.replace(
                text, F.concat(F.lit(LITERAL), k.cast("string"), F.lit(LITERAL)), F.get("literals", k)))
            return edge.withField("condition", F.when(edge["condition"].contains(LITERAL), filled).otherwise(edge["condition"]))

        rows = self.statements.join(self.templates, "template")
        edges = {c: F.transform(c, own) for c in ("join_edges", "implicit_edges")}
        return rows.select("query_id", *[edges[c].alias(c) if c in edges else F.col(c) for c in self.templates.columns if c not in ("template", "rows", "known")])


def templated(log: DataFrame) -> DataFrame:
    """query_id, text (comments and literals blanked), literals (as written, in order): one pass over a statement."""
    sql = F.regexp_replace(F.coalesce(F.col("sql"), F.lit("")), f"[{LITERAL}-{BODY}]+", "")
    rows = log.select("query_id", F.regexp_extract_all(sql, F.lit(CHUNK_RE), F.lit(0)).alias("chunks"))
    is_literal = lambda c: c.rlike("^['0-9]")
    is_comment = lambda c: c.startswith("--") | c.startswith("/*")
    is_quoted = lambda c: c.startswith('"') | c.startswith("`")
    blank = lambda c: F.when(is_literal(c), F.lit(LITERAL)).when(is_comment(c), F.lit(" ")).when(is_quoted(c), c).otherwise(F.regexp_replace(c, r"\s+", " "))
    text = F.array_join(F.transform("chunks", blank), "")
    return rows.select("query_id", F.btrim(text).alias("text"), F.filter("chunks", is_literal).alias("literals"))


def _peeled(text: Column) -> Column:
    """``units``: the texts of all subqueries, those of the outer layers first, then ``text``, what is left of the statement."""
    start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("units"))

    def layer(state: Column, _: Column) -> Column:
        return let(F.regexp_replace(state["text"], _OTHER_PARENTHESES, f"{OPEN}$1{CLOSE}"), lambda t: F.struct(
            F.regexp_replace(t, _SUBQUERY, f" {SUBQUERY} ").alias("text"),
            F.concat(F.regexp_extract_all(t, F.lit(_SUBQUERY), F.lit(1)), state["units"]).alias("units")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_LAYERS)), start, layer)


def _pieces(part: Column) -> Column:
    """The clauses of a text without nesting: clause and body.

    What comes after a bracket that the clause did not open, as after ORDER BY in OVER, or after the comma that ends ON, is not
    the clause's any more.
    """
    def cut(piece: Column) -> Column:
        word = F.upper(F.regexp_replace(F.substring_index(piece, BODY, 1), r"\s+", " "))
        return F.struct(F.when(word.endswith("JOIN"), F.lit("JOIN")).otherwise(word).alias("clause"), F.substring_index(piece, BODY, -1).alias("body"))

    def parted(c: Column) -> Column:
        top = lambda char: f"^((?:[^{OPEN}{CLOSE}{char}]++|{OPEN}{_IN_BRACKETS}{CLOSE})*+)"
        own = F.when(c["clause"] == "ON", F.regexp_extract(c["body"], top(","), 1)).otherwise(F.regexp_extract(c["body"], top(""), 1))
        after = F.when(c["clause"].isin("ON", "USING", "FROM", "JOIN"), F.lit("FROM")).otherwise(F.lit("SELECT"))
        return let(own, lambda o: F.array(F.struct(c["clause"].alias("clause"), o.alias("body")),
                                          F.struct(after.alias("clause"), F.substring(c["body"], F.length(o) + 1, F.length(c["body"])).alias("body"))))

    pieces = F.filter(F.split(F.regexp_replace(part, _CLAUSES, f"{BORDER}$1{BODY}"), BORDER), lambda p: p.contains(BODY))
    return F.filter(F.flatten(F.transform(F.transform(pieces, cut), parted)), lambda c: (F.btrim(c["body"]) != "") | (c["clause"] == "LIMIT"))


def _bare(name: Column) -> Column:
    """A name without its quotes."""
    return F.when(name.startswith('"'), F.replace(F.substring(name, F.lit(2), F.length(name) - 2), F.lit('""'), F.lit('"'))
                  ).when(name.startswith("`"), F.substring(name, F.lit(2), F.length(name) - 2)).otherwise(name)


def _is_name(token: Column) -> Column:
    return F.coalesce(token.rlike(rf'(?i)^(?!(?:{"|".join(KEYWORDS)})$)["`A-Z_]'), F.lit(False))


def _mentions(body: Column, clause: Column) -> Column:
    """The words and signs of a clause's text, each with what its neighbours make of it: table (and alias), alias of a subquery, column, or neither."""
    calls = f"""([A-Za-z0-9_$"`])\\s*{OPEN}{_FLAT}*{CLOSE}"""
    sources = clause.isin("FROM", "JOIN")
    read = F.when(sources, F.regexp_replace(F.regexp_replace(body, calls, f"$1{OPEN}"), calls, f"$1{OPEN}")).otherwise(body)

    def told(tk: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            def by_neighbours(s: Column) -> Column:
                u, before, after, second = (F.coalesce(F.upper(s[c]), F.lit("")) for c in ("t", "b", "a", "a2"))
                order_word = (u.isin("FIRST", "LAST") & (before == "NULLS")) | ((u == "NULLS") & after.isin("FIRST", "LAST"))
                is_name = _is_name(s["t"]) & ~order_word
                is_func = is_name & (after == OPEN)
                first = (i == 0) | (before == ",") | (before == "LATERAL") | ((before == OPEN) & ((i == 1) | (F.coalesce(F.get(tk, i - 2), F.lit("")) == ",")))
                is_table = sources & is_name & ~is_func & first & ~((clause == "JOIN") & (before == ","))
                alias = F.when((after == "AS") & _is_name(s["a2"]), s["a2"]).when(_is_name(s["a"]), s["a"])
                follows_value = _is_name(s["b"]) | before.rlike(f"^[{LITERAL}{CLOSE}{SUBQUERY}]") | before.isin(VALUE_WORDS)
                single = ~s["t"].rlike(r"\.")
                no_column = is_func | (before == "AS") | follows_value | (single & after.startswith(LITERAL)) | (after == "FROM") | s["t"].endswith("*")
                return let(F.regexp_extract_all(s["t"], F.lit(NAME_RE + r"|\*"), F.lit(0)), lambda parts: F.struct(
                    i.alias("pos"), s["t"].alias("tok"), u.alias("u"), before.alias("before"), after.alias("after"), is_name.alias("is_name"), is_func.alias("is_func"),
                    is_table.alias("is_table"), F.when(is_table | (sources & (u == SUBQUERY)), _bare(alias)).alias("alias"),
                    (is_name & clause.isin(COLUMN_CLAUSES) & ~no_column).alias("is_col"),
                    _bare(F.get(parts, F.size(parts) - 1)).alias("name"), _bare(F.get(parts, F.size(parts) - 2)).alias("qual")))

            return let(F.struct(t.alias("t"), F.get(tk, i - 1).alias("b"), F.get(tk, i + 1).alias("a"), F.get(tk, i + 2).alias("a2")), by_neighbours)

        return F.transform(tk, one)

    return let(F.regexp_extract_all(read, F.lit(_TOKENS), F.lit(0)), told)


def _called(body: Column, clause: Column) -> Column:
    """The arguments of each call of a tracked aggregate in a text, and of each DISTINCT that opens a call's arguments."""
    rules = {a: rf"(?i)(?<![A-Za-z0-9_$.]){a}\s*{OPEN}({_IN_BRACKETS}){CLOSE}" for a in TRACKED_AGGREGATES}
    rules["DISTINCT"] = rf"(?i){OPEN}\s*DISTINCT\b({_IN_BRACKETS}){CLOSE}"
    inner = F.flatten(F.array(*[F.transform(F.regexp_extract_all(body, F.lit(rule), F.lit(1)), _named(name)) for name, rule in rules.items()]))
    return F.transform(inner, lambda c: F.struct(c["agg"].alias("agg"), F.filter(_mentions(c["text"], clause), lambda m: m["is_col"]).alias("cols")))


def _named(name: str):
    return lambda text: F.struct(F.lit(name).alias("agg"), text.alias("text"))


def _counted(pairs: Column, names: tuple[str, str]) -> Column:
    """(table, key, n) of an array of pairs."""
    a, b = names
    return let(pairs, lambda all_: F.transform(F.array_distinct(all_), lambda d: F.struct(
        d[a].alias(a), d[b].alias(b), F.size(F.filter(all_, lambda x: (x[a] == d[a]) & (x[b] == d[b]))).cast("long").alias("n"))))


def _text(tokens: Column) -> Column:
    """A condition as text: one blank between its words and signs, none inside parentheses, before commas and after function names."""
    def spaced(x: Column, i: Column) -> Column:
        prev = F.get(tokens, i - 1)
        tight = (i == 0) | x["tok"].isin(CLOSE, ",") | (prev["tok"] == OPEN) | ((x["tok"] == OPEN) & prev["is_func"])
        word = (F.when(x["is_col"] & x["table"].isNotNull() & x["qual"].isNotNull(), F.concat_ws(".", x["table"], x["name"]))
                .when(x["tok"] == SUBQUERY, F.lit("(...)")).when(x["is_name"], x["tok"]).when(x["tok"].rlike(r"^[A-Za-z]"), x["u"]).otherwise(x["tok"]))
        return F.concat(F.when(tight, F.lit("")).otherwise(F.lit(" ")), word)

    return F.translate(F.array_join(F.transform(tokens, spaced), ""), OPEN + CLOSE, "()")


def template_facts(templates: DataFrame) -> DataFrame:
    """The facts of every template (template, text), row by row."""
    numbered = F.array_join(F.transform(F.split("text", LITERAL), lambda p, k: F.when(k == 0, p).otherwise(
        F.concat(F.lit(LITERAL), (k - 1).cast("string"), F.lit(LITERAL), p))), "")
    t = templates.select("template", F.regexp_replace(numbered, _FRAMES, " ").alias("text"))
    t = t.select("template", "text", _peeled(F.col("text")).alias("peeled"))
    opener = F.upper(F.regexp_extract("text", rf"^[\s(]*({WORD_RE})", 1))
    reason = (F.when(F.col("text") == "", F.lit("empty")).when(~opener.isin("SELECT", "WITH"), F.lit("not a query"))
              .when(F.col("peeled.text").rlike("[()]"), F.lit("unmatched parentheses")))
    t = t.select("template", "text", reason.alias("reason"), F.when(reason.isNull(), F.concat(F.array("peeled.text"), "peeled.units")).alias("units"))
    parts = F.flatten(F.transform("units", lambda u: F.split(u, _SET_OPERATORS)))
    t = t.select("template", "text", "reason", F.flatten(F.transform(parts, _pieces)).alias("clauses"))
    t = t.select("template", "text", "reason", F.transform("clauses", lambda c, k: F.struct(
        k.alias("seg"), c["clause"].alias("clause"), _mentions(c["body"], c["clause"]).alias("x"), _called(c["body"], c["clause"]).alias("called"))).alias("segs"))

    # Tables in the order of their texts, outer ones first; aliases of subqueries are none, and no alias either.
    x = F.flatten(F.transform("segs", lambda s: s["x"]))
    subs = F.transform(F.filter(x, lambda m: ~m["is_table"] & m["alias"].isNotNull()), lambda m: m["alias"])
    t = t.select("*", subs.alias("subs"), F.filter(x, lambda m: m["is_table"]).alias("tabs"))
    t = t.withColumn("tabs", F.filter("tabs", lambda m: ~F.array_contains("subs", m["name"])))
    t = t.withColumns({"named": F.reverse(F.filter("tabs", lambda m: m["alias"].isNotNull() & ~F.array_contains("subs", m["alias"]))),
                       "dt": F.array_distinct(F.transform("tabs", lambda m: m["name"]))})

    def owned(m: Column) -> Column:
        by_alias = F.get(F.filter("named", lambda a: a["alias"] == m["qual"]), F.lit(0))["name"]
        table = F.when(m["qual"].isNotNull(), F.coalesce(by_alias, m["qual"])).when(F.size("dt") == 1, F.get("dt", F.lit(0)))
        of_sub = m["qual"].isNotNull() & F.coalesce(F.array_contains("subs", m["qual"]), F.lit(False))
        return m.withField("table", F.when(m["is_col"], table)).withField("is_col", m["is_col"] & ~of_sub)

    t = t.select("template", "text", "reason", "tabs", "dt", F.transform("segs", lambda s: F.struct(
        s["seg"].alias("seg"), s["clause"].alias("clause"), F.transform(s["x"], owned).alias("x"), F.transform(s["called"], lambda c: F.struct(
            c["agg"].alias("agg"), F.filter(F.transform(c["cols"], owned), lambda m: m["is_col"] & m["table"].isNotNull()).alias("cols"))).alias("called"))).alias("segs"))
    of = lambda *clauses: F.filter("segs", lambda s: s["clause"].isin(*clauses))
    side = lambda m: F.concat_ws(".", m["table"], m["name"])
    cols = F.flatten(F.transform("segs", lambda s: F.filter(s["x"], lambda m: m["is_col"])))

    def equalities(s: Column) -> Column:
        """In a WHERE, pairs of qualified columns of two tables, as they stand on both sides of an equals sign."""
        both = F.transform(F.filter(s["x"], lambda e: e["tok"].isin("=", "==")), lambda e: F.struct(
            s["seg"].alias("seg"), F.get(s["x"], e["pos"] - 1).alias("l"), F.get(s["x"], e["pos"] + 1).alias("r")))
        return F.filter(both, lambda q: q["l"]["is_col"] & q["r"]["is_col"] & ~q["l"]["before"].isin(ARITHMETIC) & ~q["r"]["after"].isin(*ARITHMETIC, OPEN)
                        & q["l"]["qual"].isNotNull() & q["r"]["qual"].isNotNull() & (q["l"]["table"] != q["r"]["table"]))

    t = t.select("*", cols.alias("cols"), F.flatten(F.transform(of("WHERE"), equalities)).alias("joins"))
    found = lambda tok: F.call_function("regexp_instr", F.col("text"), F.concat(F.lit(r'(?<![A-Za-z0-9_$."`])\Q'), tok, F.lit(r'\E(?![A-Za-z0-9_$"`])')))
    every = F.array_sort(F.transform("cols", lambda m: F.struct(found(m["tok"]).alias("pos"), F.when(m["qual"].isNotNull(), side(m)).otherwise(m["name"]).alias("full_col"),
                                                                m["qual"].isNotNull().alias("qualified"), m["table"].alias("table"), m["name"].alias("column"))))
    columns = let(every, lambda c: F.filter(c, lambda m, k: F.array_position(F.transform(c, lambda o: o["full_col"]), m["full_col"]) == k + 1))
    tables = F.transform("dt", lambda d, k: F.struct((k + 1).alias("table_pos"), d.alias("table"), F.get(F.filter("tabs", lambda m: m["name"] == d), F.lit(0))["alias"].alias("alias")))

    def edge(s: Column) -> Column:
        both = F.array_sort(F.array_distinct(F.transform(F.filter(s["x"], lambda m: m["is_col"] & m["qual"].isNotNull()), lambda m: m["table"])))
        return F.struct(s["seg"].alias("seg"), both.alias("both"), _text(s["x"]).alias("condition"))

    join_edges = F.transform(F.filter(F.transform(of("ON"), edge), lambda e: F.size(e["both"]) == 2), lambda e: F.struct(
        e["seg"].alias("seg"), F.get(e["both"], F.lit(0)).alias("source"), F.get(e["both"], F.lit(1)).alias("target"), e["condition"].alias("condition")))
    implicit = F.transform("joins", lambda q: F.struct(q["seg"].alias("seg"), q["l"]["table"].alias("source"), q["r"]["table"].alias("target"),
                                                       F.concat(side(q["l"]), F.lit(" = "), side(q["r"])).alias("condition")))

    # Filters are the columns of a WHERE that are on no side of such an equality.
    filtered = F.flatten(F.transform(of("WHERE"), lambda s: F.transform(F.filter(s["x"], lambda m: m["is_col"] & m["table"].isNotNull() & ~F.exists(
        "joins", lambda q: (q["seg"] == s["seg"]) & ((q["l"]["pos"] == m["pos"]) | (q["r"]["pos"] == m["pos"])))), lambda m: F.struct(
            m["table"].alias("table"), F.lower(m["name"]).alias("column"), F.lit("WHERE").alias("op"), s["seg"].alias("seg")))))
    t = t.select("*", filtered.alias("filtered"))
    touched = lambda clause: F.flatten(F.transform(of(clause), lambda s: F.array_distinct(F.transform(
        F.filter(s["x"], lambda m: m["is_col"] & m["table"].isNotNull()), lambda m: F.struct(m["table"].alias("table"), F.lit(clause).alias("op"))))))
    where = F.transform(F.array_distinct(F.transform("filtered", lambda m: F.struct(m["table"].alias("table"), m["op"].alias("op"), m["seg"].alias("seg")))),
                        lambda m: F.struct(m["table"].alias("table"), m["op"].alias("op")))
    limited = F.when(F.size(of("LIMIT")) > 0, F.array_distinct(F.transform(F.filter("cols", lambda m: m["table"].isNotNull()), lambda m: F.struct(
        m["table"].alias("table"), F.lit("LIMIT").alias("op"))))).otherwise(F.array().cast("array<struct<table:string,op:string>>"))
    called = F.flatten(F.transform(F.flatten(F.transform("segs", lambda s: s["called"])), lambda c: F.array_distinct(F.transform(
        c["cols"], lambda m: F.struct(m["table"].alias("table"), c["agg"].alias("agg"))))))
    return t.select("template", "reason", tables.alias("tables"), columns.alias("columns"), join_edges.alias("join_edges"), implicit.alias("implicit_edges"),
                    _counted(F.transform("filtered", lambda m: F.struct(m["table"].alias("table"), m["column"].alias("column"))),
                             ("table", "column")).alias("predicates"),
                    _counted(F.concat(where, touched("GROUP BY"), touched("ORDER BY"), limited), ("table", "op")).alias("operations"),
                    _counted(called, ("table", "agg")).alias("aggregations"))


def mine(log: DataFrame, checkpoint: bool = True, rows_per_task: int = 8192) -> MinedLog:
    """Facts of ``log`` (query_id, sql); statements with their templates, and the templates' facts, are written to the shared folder once, unless told otherwise.

    Null or empty text is rejected as empty.  query_id is carried as it is; repeated rows are repeated statements.
    A statement takes longer to read than its bytes suggest, so statements are dealt out by their number, ``rows_per_task`` to a task.
    Templates come with the number of their statements (``rows``) and of those that have an id (``known``).
    """
    keep = stored if checkpoint else lambda df, _: df
    log = log.select("query_id", "sql")
    rows = keep(templated(log.repartition(log.count() // rows_per_task + 1, "query_id")).withColumn("template", F.md5("text")), "statements")
    counted = rows.groupBy("template", "text").agg(F.count(F.lit(1)).alias("rows"), F.count("query_id").alias("known"))
    counted = keep(counted, "texts")
    facts = template_facts(counted).join(counted.select("template", "rows", "known"), "template")
    return MinedLog(rows.select("query_id", "template", "literals"), keep(facts, "templates"))


# --------------------------------------------------------------------------
# Fact tables
# --------------------------------------------------------------------------

def _rows(m: MinedLog, name: str) -> DataFrame:
    return m.facts.select("query_id", F.inline(name))


def query_tables(m: MinedLog) -> DataFrame:
    """Distinct tables per query in first-seen order, with alias."""
    return _rows(m, "tables")


def query_columns(m: MinedLog) -> DataFrame:
    """Distinct column references per query; ``full_col`` is table.col when qualified."""
    return _rows(m, "columns")


def join_edges(m: MinedLog) -> DataFrame:
    """ON clauses whose qualified columns touch exactly two tables, with the whole condition."""
    return _rows(m, "join_edges")


def implicit_edges(m: MinedLog) -> DataFrame:
    """``a.x = b.y`` in WHERE over two different tables."""
    return _rows(m, "implicit_edges")


def predicates(m: MinedLog) -> DataFrame:
    """Predicate column occurrences per (query, table, lower(column)); join columns excluded."""
    return _rows(m, "predicates")


def operations(m: MinedLog) -> DataFrame:
    """W7-W9 plus WHERE: operation counts per (query, table, op)."""
    return _rows(m, "operations")


def aggregations(m: MinedLog) -> DataFrame:
    """COUNT/MAX/MIN/AVG (and DISTINCT inside any call) per (query, table, agg)."""
    return _rows(m, "aggregations")


def rejects(m: MinedLog, log: DataFrame) -> DataFrame:
    """Statements that are no queries, with the reason."""
    return (m.facts.where(F.col("reason").isNotNull()).select("query_id", "reason")
            .join(log.select("query_id", "sql"), "query_id").select("query_id", "reason", "sql"))


def lint(log: DataFrame) -> DataFrame:
    """The text-visible rules of the query checker as boolean columns."""
    s = clean_sql(F.col("sql"))
    n_union = F.size(F.regexp_extract_all(s, F.lit(LINT_UNION), F.lit(0)))
    n_union_all = F.size(F.regexp_extract_all(s, F.lit(LINT_UNION_ALL), F.lit(0)))
    return log.select(
        "query_id",
        s.rlike(LINT_NOT_IN_SUBQUERY).alias("not_in_subquery"),
        (n_union > n_union_all).alias("union_not_all"),
        s.rlike(LINT_BETWEEN).alias("uses_between"),
        s.rlike(LINT_DATA_CHANGING).alias("data_changing"),
    )


def pattern_records(m: MinedLog) -> DataFrame:
    """One nested record per query (nodes, edges, columns, patterns per table), still row by row."""
    entries = lambda name, key, t: F.map_from_entries(F.transform(F.filter(name, lambda o: o["table"] == t), lambda o: F.struct(o[key], o["n"].cast("int"))))
    owners = F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda o: o["table"]) for c in ("operations", "aggregations", "predicates")])))
    edges = F.transform(F.concat("join_edges", "implicit_edges"), lambda e: F.struct(e["source"].alias("source"), e["target"].alias("target"), e["condition"].alias("condition")))
    patterns = F.map_from_entries(F.transform(owners, lambda t: F.struct(t, F.struct(
        entries("operations", "op", t).alias("operations"), entries("aggregations", "agg", t).alias("aggregations"),
        entries("predicates", "column", t).alias("predicates")))))
    return m.facts.where(F.col("reason").isNull()).select(
        "query_id", F.transform("tables", lambda x: x["table"]).alias("nodes"), F.transform("columns", lambda x: x["full_col"]).alias("columns"),
        edges.alias("edges"), patterns.alias("structural_patterns"))
