"""DuckDB SQL twins of the vector queries."""

from __future__ import annotations

from ..functions import texts as TX
from .oracle_workload import q, qlog_cte
from .vectors import K, VECTOR_TAIL


DIM, TOKEN = 64, "[a-z0-9]+"


def hash_embed_sql(text: str, dim: int = DIM) -> str:
    buckets = (f"list_transform(regexp_extract_all(lower({text}), {q(TOKEN)}), "
               f"lambda t: CAST(CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % {dim} AS INTEGER))")
    counts = f"list_transform(range(0, {dim}), lambda b: CAST(len(list_filter({buckets}, lambda x: x = b)) AS DOUBLE))"
    return counts


def _norm_sql(counts: str) -> str:
    return (f"(CASE WHEN list_sum(list_transform({counts}, lambda x: x * x)) > 0 "
            f"THEN list_transform({counts}, lambda x: x / sqrt(list_sum(list_transform({counts}, lambda y: y * y)))) "
            f"ELSE {counts} END)")


def sqdist_sql(a: str, b: str) -> str:
    return (f"list_sum(list_transform(range(1, len({a}) + 1), "
            f"lambda i: (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE)) * (CAST({a}[i] AS DOUBLE) - CAST({b}[i] AS DOUBLE))))")


def _knn_sql(src: str, k: int) -> str:
    return f"""
SELECT qid, rank, cid, dist FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, {9}), cid) AS rank
  FROM (SELECT a.id AS qid, b.id AS cid, {sqdist_sql('a.vec', 'b.vec')} AS dist
        FROM {src} a JOIN {src} b ON a.id <> b.id))
WHERE rank <= {k}"""


def oracle() -> dict[str, str]:
    emb = "(SELECT vec_id AS id, embedding AS vec FROM embeddings)"
    docs = ("WITH " + qlog_cte().strip("\n") + f""",
cnt AS (SELECT item_id, text, {hash_embed_sql('text')} AS c FROM benchmark),
docs AS (SELECT b.item_id AS id, b.text, coalesce(l.sql, '') AS sql, {_norm_sql('b.c')} AS vec
         FROM cnt b LEFT JOIN qlog l ON l.query_id = b.item_id),
hits AS ({_knn_sql('docs', K)}),
blocks AS (SELECT h.qid, string_agg(printf('- Example Question: ''%s''\n  Expected SQL: %s\n\n', d.text, d.sql), ''
                  ORDER BY h.rank) AS blocks
           FROM hits h JOIN docs d ON d.id = h.cid GROUP BY h.qid)""")
    return {
        "hash_embed": f"""
WITH c AS (SELECT item_id, {hash_embed_sql('text')} AS c FROM benchmark),
v AS (SELECT item_id, {_norm_sql('c')} AS vec FROM c)
SELECT item_id, bucket, weight FROM (
  SELECT item_id, unnest(vec) AS weight, unnest(range(0, {DIM})) AS bucket FROM v)
WHERE weight > 0""",
        "knn_top_k": f"""
SELECT qid AS query_id, rank, cid AS neighbor_id, round(dist, 6) AS distance FROM ({_knn_sql(emb, K)})""",
        "knn_ivf_recall": f"""
SELECT (sum(least({K}, (SELECT count(*) - 1 FROM embeddings))))::BIGINT AS n_exact, true AS recall_reached FROM embeddings WHERE vec_id % 50 = 0""",
        "knn_small_corpus": """
WITH x AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY label, i)
SELECT a.label, b.label AS neighbor, round(sum((a.m - b.m) * (a.m - b.m)), 6) AS distance
FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY a.label, b.label""",
        "knn_best_distance": f"""
SELECT e.vec_id AS query_id, round(coalesce(min(h.dist), 'inf'::DOUBLE), 6) AS best_distance
FROM embeddings e LEFT JOIN ({_knn_sql(emb, K)}) h ON h.qid = e.vec_id GROUP BY e.vec_id""",
        "cosine_similarity": """
WITH comp AS (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings),
cent AS (SELECT label, list(m ORDER BY i) AS centroid FROM (SELECT label, i, avg(x) AS m FROM comp GROUP BY label, i)
         GROUP BY label)
SELECT e.vec_id, e.label,
  round(CASE WHEN e.embedding IS NULL OR len(e.embedding) = 0 THEN 0.0::DOUBLE ELSE
    list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: CAST(e.embedding[i] AS DOUBLE) * c.centroid[i]))
    / (sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))
       * sqrt(list_sum(list_transform(c.centroid, lambda x: x * x)))) END, 6) AS cosine
FROM embeddings e JOIN cent c ON c.label = e.label""",
        "ctx_vector": docs + f"""
SELECT d.id AS question_id,
       {q(TX.FEW_SHOT_HEADER)} || coalesce(b.blocks, '') || {q(VECTOR_TAIL)} || d.text AS context
FROM docs d LEFT JOIN blocks b ON b.qid = d.id""",
        "ctx_baseline": "SELECT item_id AS question_id, text AS context FROM benchmark",
    }
