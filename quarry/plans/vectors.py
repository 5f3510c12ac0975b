"""Named queries for vector retrieval (V) and the vector context (K1, K2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts as TX
from ..operators import ann
from ..operators import vectors as V
from ..session import stored
from ..sources import adapters as A
from ..sources.tables import table
from .workload import version

K = 3
VECTOR_TAIL = TX.VECTOR_TAIL


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"),
                                                     "label")


def q_hash_embed(spark, sf_dir):
    b = V.with_hash_embedding(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text")
    return (b.select("item_id", F.posexplode("vec").alias("bucket", "weight"))
            .where(F.col("weight") > 0))


def _knn_embeddings(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    return V.knn(e.select("qid", "vec"), e.select(F.col("qid").alias("cid"), "vec"), k=K)


def q_knn_top_k(spark, sf_dir):
    h = _knn_embeddings(spark, sf_dir)
    return h.select(F.col("qid").alias("query_id"), "rank", F.col("cid").alias("neighbor_id"),
                    F.round("dist", 6).alias("distance"))


def _every_50th(e):
    """The stated query set of searches: the rows whose id is divisible by 50, against all rows."""
    return e.where("qid % 50 = 0").select("qid", "vec")


def q_knn_ivf(spark, sf_dir):
    """V2: approximate neighbours of every 50th embedding among all of them."""
    e = _embeddings(spark, sf_dir)
    index = ann.build_index(e.select(F.col("qid").alias("cid"), "vec"), K)
    h = ann.search(index, _every_50th(e), K)
    return h.select(F.col("qid").alias("query_id"), "rank", F.col("cid").alias("neighbor_id"), F.round("dist", 6).alias("distance"))


def q_knn_ivf_recall(spark, sf_dir):
    """V2: whether the approximate search finds at least 0.9 of the exact neighbours."""
    e = _embeddings(spark, sf_dir)
    corpus = e.select(F.col("qid").alias("cid"), "vec")
    found = ann.search(ann.build_index(corpus, K), _every_50th(e), K)
    r = ann.recall(found, V.knn(_every_50th(e), corpus, K))
    return r.select("n_exact", (F.col("recall") >= 0.9).alias("recall_reached"))


def q_knn_small_corpus(spark, sf_dir):
    """V4: more neighbours asked for than there are rows: each label's centroid among the others."""
    comp = _embeddings(spark, sf_dir).select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    c = comp.groupBy(F.col("label").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("vec"))
    h = V.knn(c, c.withColumnRenamed("qid", "cid"), k=1000)
    return h.select(F.col("qid").alias("label"), F.col("cid").alias("neighbor"), F.round("dist", 6).alias("distance"))


def q_knn_best_distance(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    b = V.best_distance(e, _knn_embeddings(spark, sf_dir))
    return b.select(F.col("qid").alias("query_id"), F.round("best_distance", 6).alias("best_distance"))


def q_cosine_similarity(spark, sf_dir):
    """V7: cosine of every embedding with the centroid of its label."""
    e = _embeddings(spark, sf_dir)
    comp = e.select("label", F.posexplode("vec").alias("i", "x"))
    cent = (comp.groupBy("label", "i").agg(F.avg("x").alias("m"))
            .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))),
                                              lambda s: s["m"]).alias("centroid")))  # DIM entries per label
    return (e.join(cent, "label")
            .select(F.col("qid").alias("vec_id"), "label",
                    F.round(V.cosine(F.col("vec").cast("array<double>"), F.col("centroid")), 6).alias("cosine")))


_CONTEXTS: dict = {}


def benchmark_docs(spark, sf_dir):
    """Benchmark items as the few-shot corpus: text + golden SQL of the matching log entry; of the log only these are read as text."""
    b = table(spark, sf_dir, "benchmark")
    log = A.qlog(spark, sf_dir, b.select(F.col("item_id").alias("query_id"))).select(F.col("query_id").alias("item_id"), "sql")
    d = (b.join(log, "item_id", "left")
         .select(F.col("item_id").alias("cid"), "text", F.coalesce("sql", F.lit("")).alias("sql")))
    return V.with_hash_embedding(d, "text")


def vector_context(spark, sf_dir):
    """The few-shot text of every benchmark item, made once per session and state of its tables."""
    key = version(spark, sf_dir, ["orders", "benchmark"])
    if key not in _CONTEXTS:
        docs = stored(benchmark_docs(spark, sf_dir), "docs")
        qs = docs.select(F.col("cid").alias("qid"), "text", "vec")
        hits = V.knn(qs.select("qid", "vec"), docs.select("cid", "vec"), k=K)
        fs = V.few_shot_text(qs, hits, docs.select("cid", "text", "sql"))
        _CONTEXTS[key] = stored(qs.join(fs, "qid").select("qid", "text", "rag_context"), "contexts")
    return _CONTEXTS[key]


def q_ctx_vector(spark, sf_dir):
    v = vector_context(spark, sf_dir)
    return v.select(F.col("qid").alias("question_id"),
                    F.concat("rag_context", F.lit(VECTOR_TAIL), "text").alias("context"))


def q_ctx_baseline(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"),
                                                    F.col("text").alias("context"))


QUERIES = {
    "hash_embed": q_hash_embed,
    "knn_top_k": q_knn_top_k,
    "knn_ivf": q_knn_ivf,
    "knn_ivf_recall": q_knn_ivf_recall,
    "knn_small_corpus": q_knn_small_corpus,
    "knn_best_distance": q_knn_best_distance,
    "cosine_similarity": q_cosine_similarity,
    "ctx_vector": q_ctx_vector,
    "ctx_baseline": q_ctx_baseline,
}
