"""Queries over vectors and rank fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion as U
from ..operators import search as S
from ..operators import vectors as V
from .fixtures import table
from .text_plans import QUERY, bm25_sql

ITEM, OTHER = 17, 42


def _e(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def vector_topk(spark, sf_dir):
    e = _e(spark, sf_dir)
    return V.top_k(e, V.vector_of(e, ITEM))


def vector_scores_in_scope(spark, sf_dir):
    e = _e(spark, sf_dir)
    return V.scores_in_scope(e, e.where("label = 3"), V.vector_of(e, ITEM))


def similar_items(spark, sf_dir):
    return V.similar_to(_e(spark, sf_dir), ITEM)


def knn_graph(spark, sf_dir):
    return V.knn_graph(_e(spark, sf_dir))


def truncated_vectors(spark, sf_dir):
    cut = _e(spark, sf_dir).select("vec_id", V.truncated(F.col("embedding"), 32).alias("v"))
    return cut.select("vec_id", F.round(V.norm(F.col("v")), 6).alias("norm"), F.round(F.element_at("v", 1), 6).alias("first"), F.size("v").alias("dims"))


def quantized_scores(spark, sf_dir):
    """Cosines against a query that is quantised like the vectors."""
    e = _e(spark, sf_dir)
    q = V.quantization(e).head()
    scale, offset = (F.array(*map(F.lit, x)) for x in (q["scale"], q["offset"]))
    back = lambda v: V.dequantized(V.quantized(v, scale, offset), scale, offset)
    query = F.array(*(F.lit(x) for x in V.vector_of(e, ITEM)))
    return e.select("vec_id", F.round(V.cosine(back(F.col("embedding")), back(query)), 4).alias("score"))


def upserted_vectors(spark, sf_dir):
    e = _e(spark, sf_dir)
    return V.upsert(e, e.where("vec_id % 3 = 0").withColumn("label", F.lit(-1))).select("vec_id", "label")


def deleted_vectors(spark, sf_dir):
    e = _e(spark, sf_dir)
    return V.delete(e, e.where("label = 2")).select("vec_id")


def space_missing(spark, sf_dir):
    e = _e(spark, sf_dir).withColumn("model", F.when(F.col("vec_id") % 4 == 0, "old").otherwise("new"))
    return V.reconcile_space(e, e.select("vec_id"), "new")[1]


def chunk_hits_to_images(spark, sf_dir):
    e = _e(spark, sf_dir)
    hits = V.top_k(e, V.vector_of(e, ITEM)).select(F.col("vec_id").alias("doc_id"), "score")
    targets = e.select(F.col("vec_id").alias("doc_id"), (F.col("vec_id") % 60).alias("image")).union(e.where("vec_id % 5 = 0").select("vec_id", (F.col("vec_id") % 7)))
    return V.best_chunks(hits, targets, spark.range(0, 50).select(F.col("id").alias("image")))


def _signals(spark, sf_dir):
    e = _e(spark, sf_dir)
    image = lambda df, key: df.select((F.col(key)).alias("image"), "score")
    text = image(S.search(table(spark, sf_dir, "documents"), QUERY), "doc_id")
    return text, image(V.top_k(e, V.vector_of(e, ITEM)), "vec_id"), image(V.top_k(e, V.vector_of(e, OTHER)), "vec_id")


def rrf_fusion(spark, sf_dir):
    text, a, _ = _signals(spark, sf_dir)
    return U.fuse([U.Ranked("text", text), U.Ranked("other", a.withColumn("score", -F.col("score")), 0.5)])


def rrf_dense_tilt(spark, sf_dir):
    _, a, b = _signals(spark, sf_dir)
    return U.fuse([U.Ranked("a", a, 1.0, True), U.Ranked("b", b, 0.5, True)])


def hybrid_search(spark, sf_dir):
    text, a, b = _signals(spark, sf_dir)
    recency = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_orderdate").alias("last_ts"))
    return U.hybrid(text, [U.Ranked("a", a, 1.0, True), U.Ranked("b", b, 0.5, True)], recency)


def hybrid_without_vectors(spark, sf_dir):
    return U.hybrid(_signals(spark, sf_dir)[0], [])


def hybrid_explained(spark, sf_dir):
    text, a, _ = _signals(spark, sf_dir)
    fused = U.hybrid(text, [U.Ranked("a", a, 1.0, True)])
    return U.explained(fused, [("quote", text.where("image % 2 = 0").select("image", F.col("image").cast("string").alias("because"))), ("visual", a.where("image % 3 = 0").select("image", F.lit("match").alias("because")))]).select("image", "fused", "because")


QUERIES = [vector_topk, vector_scores_in_scope, similar_items, knn_graph, truncated_vectors, quantized_scores, upserted_vectors, deleted_vectors, space_missing, chunk_hits_to_images, rrf_fusion, rrf_dense_tilt, hybrid_search, hybrid_without_vectors, hybrid_explained]

_COS = lambda a, b: f"(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]) * list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"
_Q = lambda n: f"(SELECT embedding FROM embeddings WHERE vec_id = {n})"
_TOPV = lambda name, n: f"{name} AS (SELECT vec_id AS image, round({_COS('embedding', 'q')}, 6) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = {n}) ORDER BY 2 DESC, 1 LIMIT 200)"
_TEXT = bm25_sql([("the", False), ("tion", True)])
_PART = lambda name, w, order: f"(SELECT image, {w}::DOUBLE / (60 + row_number() OVER (ORDER BY {order}, image)) AS part FROM {name})"
_TILT = lambda name, w: f"(SELECT image, {w}::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, image)) * (1 + 0.5::DOUBLE * (2 * least(1.0, greatest(0.0, (score + 1) / 2)) - 1)) AS part FROM {name})"
_FUSE = lambda *parts: f"SELECT image, round(sum(part), 9) AS fused, count(*) AS n_signals FROM ({' UNION ALL '.join('SELECT * FROM ' + p for p in parts)}) GROUP BY image"
_HITS = "thits AS (SELECT doc_id AS image, score FROM hits)"
SQL = {
    "vector_topk": f"WITH {_TOPV('t', ITEM)} SELECT image AS vec_id, score FROM t",
    "vector_scores_in_scope": f"SELECT vec_id, round({_COS('embedding', 'q')}, 6) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = {ITEM}) WHERE label = 3",
    "similar_items": f"SELECT vec_id, round({_COS('embedding', 'q')}, 6) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = {ITEM}) WHERE vec_id <> {ITEM} ORDER BY 2 DESC, 1 LIMIT 60",
    "knn_graph": f"SELECT src, dst, sim FROM (SELECT a.vec_id AS src, b.vec_id AS dst, greatest(round({_COS('a.embedding', 'b.embedding')}, 6), 0) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY greatest(round({_COS('a.embedding', 'b.embedding')}, 6), 0) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE r <= 12",
    "truncated_vectors": "SELECT vec_id, round(1.0::DOUBLE, 6) AS norm, round(c[1] / sqrt(list_dot_product(c, c)), 6) AS first, len(c)::INTEGER AS dims FROM (SELECT vec_id, embedding[1:32]::DOUBLE[] AS c FROM embeddings)",
    "quantized_scores": f"""WITH x AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), q AS (SELECT i, (max(x) - min(x)) / 254 AS s, (max(x) + min(x)) / 2 AS o FROM x GROUP BY i),
      b AS (SELECT vec_id, i, greatest(-127, least(127, CASE WHEN s = 0 THEN 0 ELSE sign((x - o) / s) * floor(abs((x - o) / s) + 0.5) END)) * s + o AS b FROM x JOIN q USING (i)), z AS (SELECT i, b AS z FROM b WHERE vec_id = {ITEM})
      SELECT vec_id, round(sum(b * z) / sqrt(sum(b * b) * sum(z * z)), 4) AS score FROM b JOIN z USING (i) GROUP BY vec_id""",
    "upserted_vectors": "SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END AS label FROM embeddings",
    "deleted_vectors": "SELECT vec_id FROM embeddings WHERE label <> 2",
    "space_missing": "SELECT vec_id FROM embeddings WHERE vec_id % 4 = 0",
    "chunk_hits_to_images": f"WITH {_TOPV('t', ITEM)}, f AS (SELECT image AS doc_id, image % 60 AS image, score FROM t UNION ALL SELECT image, image % 7, score FROM t WHERE image % 5 = 0) SELECT image, arg_min(doc_id, (-score, doc_id)) AS doc_id, max(score) AS score FROM f WHERE image < 50 GROUP BY image",
    "rrf_fusion": f"WITH {_TEXT}, {_HITS}, {_TOPV('a', ITEM)} {_FUSE(_PART('thits', 1, 'score'), _PART('a', 0.5, 'score DESC'))} ORDER BY fused DESC, image LIMIT 100",
    "rrf_dense_tilt": f"WITH {_TOPV('a', ITEM)}, {_TOPV('b', OTHER)} {_FUSE(_TILT('a', 1), _TILT('b', 0.5))} ORDER BY fused DESC, image LIMIT 100",
    "hybrid_search": f"WITH {_TEXT}, {_HITS}, {_TOPV('a', ITEM)}, {_TOPV('b', OTHER)} SELECT f.*, o_orderdate AS last_ts FROM ({_FUSE(_PART('thits', 1, 'score'), _TILT('a', 1), _TILT('b', 0.5))}) f LEFT JOIN orders ON o_orderkey = image ORDER BY fused DESC, last_ts DESC NULLS LAST, image LIMIT 100",
    "hybrid_without_vectors": f"WITH {_TEXT}, {_HITS} SELECT * FROM thits ORDER BY score, image LIMIT 100",
    "hybrid_explained": f"WITH {_TEXT}, {_HITS}, {_TOPV('a', ITEM)}, f AS ({_FUSE(_PART('thits', 1, 'score'), _TILT('a', 1))} ORDER BY fused DESC, image LIMIT 100) SELECT image, fused, CASE WHEN image % 2 = 0 AND image IN (SELECT image FROM thits) THEN 'quote: ' || image WHEN image % 3 = 0 AND image IN (SELECT image FROM a) THEN 'visual: match' END AS because FROM f WHERE because IS NOT NULL",
}
