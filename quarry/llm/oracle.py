"""DuckDB SQL of the operators' queries, written from their contracts; no constant is shared with the operators."""

from __future__ import annotations

WS = r"[\x20\x09-\x0D]"
BLANKS = r"chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

PHRASES = (r"(^|[^\p{L}\p{N}])(?:all rights reserved|cookie policy|privacy policy|terms of use|terms of service|click here|sign up|log in|subscribe now"
           r"|subscribe to our|enable javascript|powered by|lorem ipsum|share this|skip to content|back to top|read more)($|[^\p{L}\p{N}])")

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d),
win AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w),
keyed AS (SELECT doc_id, i, words[i] AS a, words[i+1] AS b, words[i+2] AS c FROM win),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM keyed) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i+1, i+2]) AS p FROM again) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(lines) AS line FROM w),
bare AS (SELECT doc_id, line, trim(line, {BLANKS}) AS b FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
furniture AS (SELECT doc_id, line, b, lower(b) AS low, len(regexp_extract_all(b, '!!|\?\?|[#*$%&|<>]')) AS noise,
    regexp_replace(regexp_replace(regexp_replace(replace(lower(b), '©', ''), '(^|[^\p{{L}}\p{{N}}])copyright \(c\)', '\1', 'g'), '{PHRASES}', '\1\2', 'g'), '{PHRASES}', '\1\2', 'g') AS rest FROM bare),
bad AS (
  SELECT doc_id, b, line,
    NOT (regexp_matches(b, '[.!?…:;։؟۔।॥།༎။።፧፨។៕︒．：；][\x22\x27”’»›)\]」』）】》〉]*([\x20\x09-\x0D]|$)|[。！？｡]')
         AND (noise <= 1 OR 100 * noise <= 20 * CASE WHEN regexp_matches(b, '{WS}') THEN len(regexp_extract_all(b, '{WS}+')) + 1 ELSE length(b) END)
         AND len(regexp_extract_all(b, '[|»›•·]')) < 3
         AND NOT 100 * (length(regexp_replace(low, '{WS}+', '', 'g')) - length(regexp_replace(rest, '{WS}+', '', 'g'))) > 50 * length(regexp_replace(low, '{WS}+', '', 'g'))
    ) AS fails
  FROM furniture),
per AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (fails) AS n_bad_lines,
          coalesce(sum(length(regexp_replace(line, '{WS}+', '', 'g'))) FILTER (NOT fails), 0) AS kept_chars
        FROM bad GROUP BY doc_id),
base AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '{WS}+', '', 'g')) AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
           coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_bad_lines, 0) AS n_bad_lines, coalesce(kept_chars, 0) AS kept_chars
         FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN per ON per.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * (word_chars - kept_chars) <= 50 * word_chars AS kept,
  n_bad_lines::BIGINT AS n_bad_lines, kept_chars::BIGINT AS kept_chars
FROM f
"""

OP3 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, s.keeper IS NOT NULL AND k.doc_id <> s.keeper AS lost FROM k LEFT JOIN s ON s.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

ORACLE = {"op2_line_quality": OP2, "op3_line_dedup": OP3}

OP4 = r"""
WITH d AS (SELECT doc_id, string_split_regex(lower(text), '[^\p{L}\p{N}]+') AS words FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM benchmark),
dw AS (SELECT doc_id, len(words) AS n, unnest(range(len(words))) AS i, unnest(words) AS w FROM d),
bw AS (SELECT item_id, len(words) AS n, unnest(range(len(words))) AS j, unnest(words) AS w FROM b WHERE len(words) >= 9),
lim AS (SELECT item_id, n, least(n, 13) AS win, least(n, 13) - CASE WHEN n >= 13 THEN 2 ELSE n // 6 END AS need FROM (SELECT DISTINCT item_id, n FROM bw)),
same AS (SELECT dw.doc_id, bw.item_id, dw.i - bw.j AS shift, bw.j, dw.n AS dn FROM dw JOIN bw ON dw.w = bw.w),
diag AS (SELECT doc_id, item_id, shift, dn, list(j) AS js FROM same GROUP BY doc_id, item_id, shift, dn),
cand AS (SELECT diag.*, win, need, lim.n FROM diag JOIN lim USING (item_id) WHERE len(js) >= need),
starts AS (SELECT doc_id, item_id, win, need, js, unnest(range(greatest(0, -shift), least(n, dn - shift) - win + 1)) AS s FROM cand),
best AS (SELECT doc_id, item_id, win, need, len(list_filter(js, lambda j: j >= s AND j < s + win)) AS m FROM starts)
SELECT doc_id, item_id, max(m)::BIGINT AS n_matched, max(win)::BIGINT AS n_window FROM best WHERE m >= need GROUP BY doc_id, item_id
"""

OP8 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id
FROM documents JOIN comp ON comp.doc_id = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
"""

ORACLE |= {"op4_decontamination": OP4, "op8_jaccard_join": OP8}

OP11 = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT d.part, coalesce(lab.good, false) AS good, coalesce(lab.toxic, false) AS toxic,
        CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * list_unique(w) < 80 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 10 * length(d.text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > firsts.first THEN 'E' ELSE '' END AS fails
      FROM d JOIN firsts ON firsts.text = d.text LEFT JOIN lab ON lab.doc_id = d.doc_id),
cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
perms AS (SELECT '' AS o UNION ALL SELECT o || x FROM perms JOIN letters ON NOT contains(o, x)),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM perms WHERE length(o) = 5),
s AS (SELECT o, step, substr(o, step, 1) AS x, substr(o, 1, step - 1) AS before FROM steps),
j AS (SELECT part, o, step, x, n, good, toxic, contains(fails, x) AS hit, fails = x AS only_this,
        translate(fails, before, '') <> fails AND before <> '' AS gone FROM s CROSS JOIN cells),
r AS (SELECT part, o AS filter_order, step, x, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed,
        sum(n) FILTER (hit AND gone) AS redundant, sum(n) FILTER (only_this) AS unique_fails,
        sum(good) FILTER (hit AND NOT gone) AS good_lost, sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost
      FROM j GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
  coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost,
  coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, x)::BIGINT AS shapley
FROM r
"""

OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN kept ON kept.lang = o.lang AND kept.term = o.term GROUP BY ALL),
cl AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
tot AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT tot.lang, tot.source, kept.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (tot.total + 2 * v.v) AS p
      FROM tot JOIN v ON v.lang = tot.lang JOIN kept ON kept.lang = tot.lang
      LEFT JOIN c ON c.lang = tot.lang AND c.source = tot.source AND c.term = kept.term),
q AS (SELECT cl.lang, cl.term, 1 + (1000000000::HUGEINT * (cl.n + 2)) // (sum(cl.n) OVER (PARTITION BY cl.lang) + 2 * v.v) AS q FROM cl JOIN v ON v.lang = cl.lang),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
         FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value
          FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
           FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

ORACLE |= {"op11_filter_audit": OP11, "op13_source_divergence": OP13}
