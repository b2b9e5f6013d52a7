"""Queries over graphs, topics, selection, collections and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collections as K
from ..operators import evaluate as E
from ..operators import graph as G
from ..operators import search as S
from ..operators import select as L
from ..operators import temporal as M
from ..operators import topics as P
from ..operators import vectors as V
from ..storage import written
from .filter_plans import FIXTURE_SQL, tables
from .fixtures import journal, table, with_journal
from .time_plans import _GAPS
from .vector_plans import _COS, SQL as VECTOR_SQL


def _signatures(spark, sf_dir):
    """Sign bits of the 64 components."""
    e = table(spark, sf_dir, "embeddings")
    bits = F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0).cast("long"))
    sig = F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))
    return e.select(F.col("vec_id").alias("image"), sig.alias("sig"))


def hamming_pairs(spark, sf_dir):
    return G.hamming_pairs(_signatures(spark, sf_dir), "image", "sig", threshold=16)


def near_dup_groups(spark, sf_dir):
    return G.near_duplicate_groups(_signatures(spark, sf_dir), "image", "sig", threshold=17)


def _ratings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 3 > 0").select(F.col("vec_id").alias("image"), (F.col("vec_id") % 6).alias("rating"))


def dup_representatives(spark, sf_dir):
    return G.representatives(G.near_duplicate_groups(_signatures(spark, sf_dir), "image", "sig", threshold=17), _ratings(spark, sf_dir)).drop("component")


def dup_redundant(spark, sf_dir):
    groups = G.near_duplicate_groups(_signatures(spark, sf_dir), "image", "sig", threshold=17)
    return G.redundant(groups, G.representatives(groups, _ratings(spark, sf_dir)))


def symmetric_neighbours(spark, sf_dir):
    return G.symmetric(V.knn_graph(table(spark, sf_dir, "embeddings")))


def _affinities(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.transform(F.slice("embedding", 1, 5), lambda x: F.when(x > 0.12, F.round(x.cast("double"), 4)).otherwise(0.0)).alias("affinities"), ((F.col("vec_id") * 37 % 100) / 100).alias("intensity"), (F.col("vec_id") % 3 + 1).alias("mass"))


def unnamed_clusters(spark, sf_dir):
    edges = G.symmetric(V.knn_graph(table(spark, sf_dir, "embeddings")))
    return G.unnamed_clusters(edges, _affinities(spark, sf_dir).withColumnRenamed("image", "node"), least_weight=0.38).select("component", "size", F.round("coherence", 5).alias("coherence"), F.array_join("members", ",").alias("members"))


def cluster_label_match(spark, sf_dir):
    """Which nation's number of suppliers, fifteen times over, comes nearest to the number of a nation's customers."""
    clusters = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("component")).agg(F.count(F.lit(1)).alias("size"))
    suppliers = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg((F.count(F.lit(1)) * 15).alias("size"))
    labels = table(spark, sf_dir, "nation").join(suppliers, F.col("n_nationkey") == F.col("s_nationkey")).select(F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.col("n_name")).alias("label"), "size")
    return G.match_labels(clusters, labels, separation=0.02)


def density_field(spark, sf_dir):
    """The topic density after three blurs of radius two, on tiles of sixteen cells."""
    e = table(spark, sf_dir, "embeddings").select(F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"), "label")
    return G.blurred_field(G.density_grid(e, 0.02, "label"), 2, tile=16).withColumn("w", F.round("w", 6)).where("w <> 0")


def picture_hashes(spark, sf_dir):
    """Difference hashes of pictures of eight by eight pixels that vectors stand for."""
    grey = F.transform("embedding", lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), (F.floor(x.cast("double") * 400) + 128).cast("int")))), 2, "0"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.unhex(F.array_join(grey, "")).alias("pixels"))
    return e.select("vec_id", G.difference_hash(F.col("pixels"), F.lit(8), F.lit(8)).alias("hash"))


def topic_density(spark, sf_dir):
    return G.density_grid(table(spark, sf_dir, "embeddings").select(F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"), F.col("label").alias("w")), 0.05)


def stroke_shapes(spark, sf_dir):
    pts = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.struct(F.element_at("embedding", i).cast("double").alias("x"), F.element_at("embedding", i + 20).cast("double").alias("y")))
    e = table(spark, sf_dir, "embeddings").select("vec_id", pts.alias("points"))
    return e.select("vec_id", F.round(G.stroke_length(F.col("points"), F.lit(6000.0), F.lit(4000.0)), 5).alias("length"), G.worth_keeping(G.stroke_length(F.slice("points", 1, 2)), F.col("vec_id") % 200).alias("kept"), F.round(G.distance_to_stroke(F.col("points"), F.lit(0.05), F.lit(0.0)), 5).alias("distance"), F.element_at(G.quantized_points(F.col("points")), 1)["x"].alias("qx"))


def eraser_picks(spark, sf_dir):
    pts = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(F.element_at("embedding", i).cast("double").alias("x"), F.element_at("embedding", i + 20).cast("double").alias("y")))
    e = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 25).alias("mark"), F.lit(0.05).alias("x"), F.lit(0.02).alias("y"), F.col("vec_id").alias("id"), pts.alias("points"))
    return G.eraser_pick(e, 0.04)


def _visual(spark, sf_dir, item=17):
    e = table(spark, sf_dir, "embeddings")
    return V.scores_in_scope(e, e.where("vec_id % 4 <> 0"), V.vector_of(e, item)).select(F.col("vec_id").alias("image"), "score")


def topic_affinity_rank(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    other = V.scores_in_scope(e, e.where("vec_id % 3 <> 0"), V.vector_of(e, 42)).select(F.col("vec_id").alias("image"), "score")
    return P.affinity(_visual(spark, sf_dir), other, e.select(F.col("vec_id").alias("image")), alpha=0.7)


def topic_baked(spark, sf_dir):
    return P.bake(topic_affinity_rank(spark, sf_dir), 0.05).agg(F.count(F.lit(1)).alias("n"))


def _notes(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select((F.col("item_id") % 40).alias("image"), "text")


def topic_suggestions(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("n"))
    return P.suggestions(_notes(spark, sf_dir), names)


def _links(spark, sf_dir):
    return journal(spark, sf_dir).where("kind IN ('remark', 'rating', 'stroke') AND image IS NOT NULL").select("session", "image")


def co_annotation(spark, sf_dir):
    started = journal(spark, sf_dir).groupBy("session").agg(F.min("ts").alias("started")).where("session % 2 = 0")
    return P.co_annotated(_links(spark, sf_dir), started).withColumn("members", F.array_join("members", ","))


def repeated_phrases(spark, sf_dir):
    return P.repeated_phrases(_notes(spark, sf_dir)).withColumn("members", F.array_join("members", ","))


def collection_suggestions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    bursts = M.bursts(e.withColumn("user_id", F.concat(F.lit("root/f"), F.col("user_id").cast("string"))), "user_id", "ts", "event_id", gap=3600, least=4)
    started = journal(spark, sf_dir).groupBy("session").agg(F.min("ts").alias("started"))
    out = P.collection_suggestions(P.co_annotated(_links(spark, sf_dir), started), P.repeated_phrases(_notes(spark, sf_dir)), P.burst_candidates(bursts, "user_id"))
    return out.select("label", "source", "score", F.size("members").alias("members"))


def attention_intensity(spark, sf_dir):
    j = journal(spark, sf_dir).where("image IS NOT NULL").groupBy("image").agg(F.sum(F.col("id") % 90 * 1000).alias("dwell_ms"), F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == "stroke").alias("strokes"), F.max("ts").alias("last_ts"))
    return P.intensity(j, F.lit("2024-01-28").cast("timestamp")).withColumn("intensity", F.round("intensity", 6))


def engaged_topics(spark, sf_dir):
    return P.engaged_topics(_affinities(spark, sf_dir)).select("topic", F.round("score", 6).alias("score"), F.round("mean", 6).alias("mean"))


def overlooked_topics(spark, sf_dir):
    return P.overlooked_topics(_affinities(spark, sf_dir)).select("topic", F.round("score", 6).alias("score"), F.round("mean", 6).alias("mean"))


def lod_supernodes(spark, sf_dir):
    return P.super_nodes(_affinities(spark, sf_dir)).select("topic", "mass", F.element_at("affinities", 1).alias("a0"), F.element_at("affinities", 5).alias("a4"))


def node_overlay(spark, sf_dir):
    n = _affinities(spark, sf_dir)
    return P.overlay(n, P.overlooked_topics(n), "overlooked").withColumn("score", F.round("score", 6))


def kmeans_clusters(spark, sf_dir):
    return L.kmeans(table(spark, sf_dir, "embeddings")).withColumn("cosine", F.round("cosine", 6))


def cluster_labels(spark, sf_dir):
    c = L.kmeans(table(spark, sf_dir, "embeddings")).withColumnRenamed("vec_id", "image")
    return P.cluster_topics(c, _notes(spark, sf_dir))


def _diversified(spark, sf_dir, method):
    e = table(spark, sf_dir, "embeddings")
    items = e.select(F.col("label").alias("scope"), F.col("vec_id").alias("image"), (F.col("vec_id") * 7 % 6).cast("double").alias("quality"))
    edges = G.symmetric(V.knn_graph(e))
    return L.diversify(items, edges, method, tolerance=1.4 / 2)


def diversify_facility(spark, sf_dir):
    return _diversified(spark, sf_dir, "facility")


def diversify_mmr(spark, sf_dir):
    return _diversified(spark, sf_dir, "mmr")


def diversify_kcenter(spark, sf_dir):
    return _diversified(spark, sf_dir, "k_center")


def collection_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("collection"), F.col("c_name").alias("name"))
    notes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("collection"), F.col("o_orderkey").alias("note"))
    return K.summaries(c, tables(spark, sf_dir)["members"], notes)


def members_added(spark, sf_dir):
    m = tables(spark, sf_dir)["members"]
    return K.add_members(m, m.where("image % 3 = 0").select("collection", "image").union(m.select((F.col("collection") + 1), "image").where("image % 50 = 0")), F.lit("1995-01-01").cast("timestamp_ntz"))


def members_removed(spark, sf_dir):
    m = tables(spark, sf_dir)["members"]
    return K.remove_members(m, m.where("image % 3 = 0"), F.lit("1996-01-01").cast("timestamp_ntz"))


def _docs(spark, sf_dir, shift):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.where(k % 5 != shift).select(k.alias("collection"), F.concat(F.col("c_name"), F.when(k % 3 == shift, " x").otherwise("")).alias("name"), F.col("c_mktsegment").alias("description"), F.when(k % 4 == shift, "done").otherwise("active").alias("status"), (k % 7 + shift).alias("created_ts"), (k % 2 * shift + k).alias("updated_ts"))


def merge_collections_lww(spark, sf_dir):
    return K.merge_collections(_docs(spark, sf_dir, 0), _docs(spark, sf_dir, 1))


def merge_members(spark, sf_dir):
    m = tables(spark, sf_dir)["members"]
    other = m.where("image % 2 = 0").withColumn("removed_ts", F.when(F.col("image") % 4 == 0, F.expr("added_ts + INTERVAL 10 DAYS")))
    return K.merge_members(m, other)


def _two_notes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey")).alias("collection"), F.col("o_orderkey").alias("note"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("text"))
    return o, o.where("note % 2 = 0").withColumn("text", F.when(F.col("note") % 6 == 0, "0-HIGH").otherwise(F.col("text")))


def merge_notes(spark, sf_dir):
    return K.merge_notes(*_two_notes(spark, sf_dir))[0]


def note_conflicts(spark, sf_dir):
    return K.merge_notes(*_two_notes(spark, sf_dir))[1]


def scope_folder(spark, sf_dir):
    return K.scope(tables(spark, sf_dir)["paths"], folder="Shoot12/roll3")


def _judged(spark, sf_dir):
    docs, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ranked = written(S.search_batch(docs, b).select(F.col("item_id").alias("query"), F.col("doc_id").alias("item"), "rank"), "ranked")
    relevant = ranked.where("item % 3 <> 1").select("query", "item").union(b.where("item_id % 4 = 0").select(F.col("item_id"), F.lit(-1).cast("long")))
    return b.select(F.col("item_id").alias("query")), ranked, relevant


def ir_metrics(spark, sf_dir):
    return E.query_metrics(*_judged(spark, sf_dir), k=3)


def config_sweep(spark, sf_dir):
    q, ranked, relevant = _judged(spark, sf_dir)
    return E.rank_configs(E.sweep([("all", ranked), ("late", ranked.withColumn("rank", F.col("rank") + 1)), ("first", ranked.where("rank = 1"))], q, relevant, k=3), "ndcg")


def regression_gate(spark, sf_dir):
    """Ranked lists that start one place late against the lists as they are; one metric is not measured."""
    q, ranked, relevant = _judged(spark, sf_dir)
    means = lambda r: E.mean_metrics(E.query_metrics(q, r, relevant, k=3)).selectExpr("stack(4, 'precision', precision, 'recall', recall, 'mrr', mrr, 'ndcg', ndcg) AS (metric, value)")
    return E.regressions(means(ranked.withColumn("rank", F.col("rank") + 1)).where("metric <> 'recall'"), means(ranked))


QUERIES = [hamming_pairs, near_dup_groups, dup_representatives, dup_redundant, symmetric_neighbours, unnamed_clusters, cluster_label_match, density_field, picture_hashes, topic_density, stroke_shapes, eraser_picks, topic_affinity_rank, topic_baked, topic_suggestions, co_annotation, repeated_phrases, collection_suggestions, attention_intensity, engaged_topics, overlooked_topics, lod_supernodes, node_overlay, kmeans_clusters, cluster_labels, diversify_facility, diversify_mmr, diversify_kcenter, collection_counts, members_added, members_removed, merge_collections_lww, merge_members, merge_notes, note_conflicts, scope_folder, ir_metrics, config_sweep, regression_gate]

_SIG = "sig AS (SELECT vec_id AS image, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings), hp AS (SELECT x.image AS a, y.image AS b, list_sum(list_transform(list_zip(x.b, y.b), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INTEGER AS distance FROM sig x JOIN sig y ON x.image < y.image)"
_GROUPS = _SIG + ", e AS (SELECT a, b FROM hp WHERE distance <= 17), reach(node, seen) AS (SELECT a, a FROM e UNION SELECT b, b FROM e UNION SELECT r.node, CASE WHEN e.a = r.seen THEN e.b ELSE e.a END FROM reach r JOIN e ON e.a = r.seen OR e.b = r.seen), comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1), grp AS (SELECT *, count(*) OVER (PARTITION BY component) AS size FROM comp), rated AS (SELECT g.*, row_number() OVER (PARTITION BY component ORDER BY CASE WHEN node % 3 > 0 THEN node % 6 ELSE -1 END DESC, node) AS r FROM grp g)"
_AFF = "aff AS (SELECT vec_id AS image, list_transform(embedding[1:5], lambda x: CASE WHEN x > 0.12::FLOAT THEN round(x::DOUBLE, 4) ELSE 0 END) AS affinities, (vec_id * 37 % 100) / 100.0::DOUBLE AS intensity, vec_id % 3 + 1 AS mass FROM embeddings), ex AS (SELECT image, unnest(range(0, 5))::INTEGER AS topic, unnest(affinities) AS a, intensity AS h, mass AS m FROM aff)"
_NOTE_GRAMS = "w AS (SELECT item_id % 40 AS image, list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda t: t <> '') AS w FROM benchmark), g AS (SELECT image, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])) AS g FROM w, (VALUES (1), (2), (3)) v(n) WHERE len(w) >= n), ph AS (SELECT image, array_to_string(g, ' ') AS phrase FROM g WHERE g[1] NOT IN ({s}) AND g[-1] NOT IN ({s}) AND (len(g) > 1 OR strlen(g[1]) > 2))"
from ..functions.text import STOP_WORDS  # noqa: E402

_NOTE_GRAMS = _NOTE_GRAMS.format(s=", ".join(f"'{x}'" for x in STOP_WORDS))
_MEMBERS = "mem AS (SELECT o_custkey AS collection, o_orderkey AS image, o_orderdate AS added_ts, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAYS END AS removed_ts FROM orders)"
_SCOPE = lambda n, m: f"(SELECT vec_id, round({_COS('embedding', 'q')}, 6) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = {n}) WHERE vec_id % {m} <> 0)"
_RANK = f"SELECT e.vec_id AS image, round(coalesce(v.score, 0) * 0.7::DOUBLE + coalesce(n.score, 0) * 0.3::DOUBLE, 9) AS affinity FROM embeddings e LEFT JOIN {_SCOPE(17, 4)} v USING (vec_id) LEFT JOIN {_SCOPE(42, 3)} n USING (vec_id)"
_DOC = lambda s: f"SELECT c_custkey AS collection, c_name || CASE WHEN c_custkey % 3 = {s} THEN ' x' ELSE '' END AS name, c_mktsegment AS description, CASE WHEN c_custkey % 4 = {s} THEN 'done' ELSE 'active' END AS status, c_custkey % 7 + {s} AS created_ts, c_custkey % 2 * {s} + c_custkey AS updated_ts FROM customer WHERE c_custkey % 5 <> {s}"
_NOTES2 = "n1 AS (SELECT o_custkey AS collection, o_orderkey AS note, o_orderdate AS ts, o_orderpriority AS text FROM orders), n2 AS (SELECT * FROM n1 UNION SELECT collection, note, ts, CASE WHEN note % 6 = 0 THEN '0-HIGH' ELSE text END FROM n1 WHERE note % 2 = 0)"
_SYM = f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(sim) AS sim FROM ({VECTOR_SQL['knn_graph']}) GROUP BY 1, 2"

def _strokes(n, x, y):
    """Pieces of the strokes of ``n`` points, each with its distance ``far`` from a point."""
    return f"""piece AS (SELECT vec_id, unnest(range(1, {n}))::INTEGER AS i, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT vec_id, i, e[i] AS x0, e[i + 20] AS y0, e[i + 1] - e[i] AS dx, e[i + 21] - e[i + 20] AS dy FROM piece),
      near AS (SELECT *, CASE WHEN dx * dx + dy * dy > 0 THEN least(1, greatest(0, (({x}::DOUBLE - x0) * dx + ({y}::DOUBLE - y0) * dy) / (dx * dx + dy * dy))) ELSE 0 END AS t FROM d), far AS (SELECT *, sqrt(pow({x}::DOUBLE - x0 - t * dx, 2) + pow({y}::DOUBLE - y0 - t * dy, 2)) AS far FROM near)"""


SQL = {
    "hamming_pairs": f"WITH {_SIG} SELECT * FROM hp WHERE distance <= 16",
    "near_dup_groups": f"WITH RECURSIVE {_GROUPS} SELECT node, component, size FROM grp",
    "dup_representatives": f"WITH RECURSIVE {_GROUPS} SELECT node AS representative, size FROM rated WHERE r = 1",
    "dup_redundant": f"WITH RECURSIVE {_GROUPS} SELECT node FROM rated WHERE r > 1",
    "symmetric_neighbours": _SYM,
    "unnamed_clusters": f"WITH RECURSIVE {_AFF}, sym AS ({_SYM}), un AS (SELECT image FROM aff WHERE list_max(affinities) <= 1e-4), e AS (SELECT * FROM sym WHERE sim >= 0.38 AND a IN (SELECT image FROM un) AND b IN (SELECT image FROM un)), reach(node, seen) AS (SELECT a, a FROM e UNION SELECT b, b FROM e UNION SELECT r.node, CASE WHEN e.a = r.seen THEN e.b ELSE e.a END FROM reach r JOIN e ON e.a = r.seen OR e.b = r.seen), comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1) SELECT component, count(*) AS size, round((SELECT avg(sim) FROM e JOIN comp c2 ON c2.node = e.a WHERE c2.component = comp.component), 5) AS coherence, array_to_string(list_sort(list(node)), ',') AS members FROM comp GROUP BY component HAVING count(*) >= 3",
    "cluster_label_match": """WITH c AS (SELECT c_nationkey::BIGINT AS component, count(*) AS size FROM customer GROUP BY 1), l AS (SELECT n_name AS label, 15 * count(*) AS size FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey % 5 <> 0 GROUP BY 1),
      d AS (SELECT component, label, abs(l.size - c.size)::DOUBLE / greatest(l.size, c.size) AS d FROM c, l), r AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY d, label) AS r, lead(d) OVER (PARTITION BY component ORDER BY d, label) AS next FROM d)
      SELECT component, max(CASE WHEN r = 1 AND d <= 0.25 AND (next IS NULL OR next - d >= 0.02::DOUBLE) THEN label END) AS label FROM r GROUP BY 1""",
    "density_field": "WITH b0 AS (SELECT floor(embedding[1]::DOUBLE / 0.02::DOUBLE)::BIGINT AS gx, floor(embedding[2]::DOUBLE / 0.02::DOUBLE)::BIGINT AS gy, sum(label)::DOUBLE AS w FROM embeddings GROUP BY 1, 2), "
      + ", ".join(f"b{i + 1} AS (SELECT gx{' + d' if i % 2 == 0 else ''} AS gx, gy{' + d' if i % 2 else ''} AS gy, sum(w) / 5 AS w FROM b{i}, range(-2, 3) r(d) GROUP BY 1, 2)" for i in range(6))
      + " SELECT gx, gy, round(w, 6) AS w FROM b6 WHERE round(w, 6) <> 0",
    "picture_hashes": """WITH g AS (SELECT vec_id, i // 8 AS y, i % 8 AS px, greatest(0, least(255, floor(embedding[i + 1]::DOUBLE * 400)::INTEGER + 128)) AS v FROM embeddings, range(64) r(i)),
      c AS (SELECT vec_id, y, x, sum(v * greatest(0, least(8 * x + 8, 9 * px + 9) - greatest(8 * x, 9 * px))) AS v FROM g, range(9) q(x) GROUP BY ALL),
      b AS (SELECT vec_id, sum(CASE WHEN v > nxt THEN 1::HUGEINT << (y * 8 + x)::INTEGER ELSE 0 END)::HUGEINT AS bits FROM (SELECT *, lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) AS nxt FROM c) GROUP BY 1)
      SELECT vec_id, (CASE WHEN bits >= 1::HUGEINT << 63 THEN bits - (1::HUGEINT << 64) ELSE bits END)::BIGINT AS hash FROM b""",
    "topic_density": "SELECT floor(embedding[1]::DOUBLE / 0.05::DOUBLE)::BIGINT AS gx, floor(embedding[2]::DOUBLE / 0.05::DOUBLE)::BIGINT AS gy, sum(label)::BIGINT AS w FROM embeddings GROUP BY 1, 2",
    "topic_affinity_rank": _RANK,
    "topic_baked": f"SELECT count(*) AS n FROM ({_RANK}) WHERE affinity >= 0.05",
    "topic_suggestions": f"WITH {_NOTE_GRAMS}, nm AS (SELECT lower(n_name) AS phrase, max(n_nationkey)::BIGINT AS n FROM nation GROUP BY 1) SELECT * FROM (SELECT phrase, 'collection' AS source, n FROM nm UNION ALL SELECT phrase, 'note', count(*) FROM ph WHERE phrase NOT IN (SELECT phrase FROM nm) GROUP BY phrase HAVING count(*) >= 2) ORDER BY source, n DESC, phrase LIMIT 24",
    "stroke_shapes": f"WITH {_strokes(7, 0.05, 0)} SELECT vec_id, round(sum(sqrt(dx * dx + pow(dy * 4000::DOUBLE / 6000, 2))), 5) AS length, NOT (sum(CASE WHEN i = 1 THEN sqrt(dx * dx + dy * dy) END) < 0.003 AND vec_id % 200 < 100) AS kept, round(min(far), 5) AS distance, least(12500, greatest(-2500, floor(sum(CASE WHEN i = 1 THEN x0 END) * 10000 + 0.5)))::INTEGER AS qx FROM far GROUP BY vec_id",
    "eraser_picks": f"WITH {_strokes(3, 0.05, 0.02)} SELECT vec_id % 25 AS mark, max(vec_id) AS stroke FROM far WHERE far <= 0.04 GROUP BY 1",
    "node_overlay": f"WITH {_AFF}, s AS (SELECT topic, sum(a * a * m) / sum(a * m) AS c, sum(a * h * m) / sum(a * m) AS h FROM ex WHERE a > 1e-4 GROUP BY 1), o AS (SELECT topic, c / max(c) OVER () * (1 - h / max(h) OVER ()) AS s FROM s), d AS (SELECT image, intensity, CASE WHEN list_max(affinities) > 0 THEN list_position(affinities, list_max(affinities)) - 1 ELSE -1 END AS topic FROM aff) SELECT image, round(coalesce(s, 0) * (1 - intensity), 6) AS score FROM d LEFT JOIN o USING (topic)",
    "collection_suggestions": with_journal("SELECT label, source, score, least(m, 500)::INTEGER AS members FROM (SELECT * FROM co UNION ALL SELECT * FROM named UNION ALL SELECT * FROM burst) ORDER BY score DESC, source, label LIMIT 24", f"""l AS (SELECT DISTINCT session, image FROM journal WHERE kind IN ('remark', 'rating', 'stroke')),
      began AS (SELECT session, min(ts) AS began FROM journal GROUP BY 1), co AS (SELECT 'worked together ' || strftime(any_value(began), '%Y-%m-%d') AS label, 'co_annotation' AS source, count(*)::DOUBLE AS score, count(*) AS m FROM l JOIN began USING (session) GROUP BY session HAVING count(*) >= 3),
      {_NOTE_GRAMS}, same AS (SELECT phrase, list_sort(list(DISTINCT image)) AS members FROM ph GROUP BY 1 HAVING count(DISTINCT image) >= 3), named AS (SELECT 'images you called "' || arg_min(phrase, (-len(string_split(phrase, ' ')), phrase)) || '"' AS label, 'repeated_phrase' AS source, len(members)::DOUBLE AS score, len(members) AS m FROM same GROUP BY same.members),
      burst AS (SELECT 'burst, f' || user_id || ', ' || strftime(start, '%Y-%m-%d') AS label, 'time_folder' AS source, n::DOUBLE AS score, n AS m FROM ({_GAPS(3600, '>')}) WHERE n >= 4)"""),
    "co_annotation": with_journal("SELECT 'worked together' || CASE WHEN session % 2 = 0 THEN ' ' || strftime((SELECT min(ts) FROM journal j WHERE j.session = l.session), '%Y-%m-%d') ELSE '' END AS label, 'co_annotation' AS source, count(*)::DOUBLE AS score, array_to_string(list_sort(list(image)), ',') AS members FROM l GROUP BY session HAVING count(*) >= 3", "l AS (SELECT DISTINCT session, image FROM journal WHERE kind IN ('remark', 'rating', 'stroke'))"),
    "repeated_phrases": f"WITH {_NOTE_GRAMS}, s AS (SELECT phrase, list_sort(list(DISTINCT image)) AS members FROM ph GROUP BY 1 HAVING count(DISTINCT image) >= 3) SELECT 'images you called \"' || arg_min(phrase, (-len(string_split(phrase, ' ')), phrase)) || '\"' AS label, 'repeated_phrase' AS source, len(members)::DOUBLE AS score, array_to_string(members, ',') AS members FROM s GROUP BY s.members",
    "attention_intensity": with_journal("SELECT image, round(raw / max(raw) OVER (), 6) AS intensity FROM (SELECT image, (sum(id % 90 * 1000) * 0.0001::DOUBLE + count(*) + count(*) FILTER (WHERE kind = 'stroke') * 0.5::DOUBLE) * pow(0.5::DOUBLE, greatest(0, (epoch_us(TIMESTAMP '2024-01-28') - epoch_us(max(ts))) / 86400e6::DOUBLE) / 14) AS raw FROM journal WHERE image IS NOT NULL GROUP BY image)"),
    "engaged_topics": f"WITH {_AFF}, s AS (SELECT topic, sum(a * h * m) AS w, sum(a * m) AS mass FROM ex WHERE a > 1e-4 GROUP BY 1) SELECT topic, round(w / max(w) OVER (), 6) AS score, round(w / mass, 6) AS mean FROM s",
    "overlooked_topics": f"WITH {_AFF}, s AS (SELECT topic, sum(a * a * m) / sum(a * m) AS c, sum(a * h * m) / sum(a * m) AS h FROM ex WHERE a > 1e-4 GROUP BY 1) SELECT topic, round(c / max(c) OVER () * (1 - h / max(h) OVER ()), 6) AS score, round(h / max(h) OVER (), 6) AS mean FROM s",
    "lod_supernodes": f"WITH {_AFF} SELECT CASE WHEN list_max(affinities) > 0 THEN list_position(affinities, list_max(affinities)) - 1 ELSE -1 END::INTEGER AS topic, count(*) AS mass, round(avg(affinities[1]), 6) AS a0, round(avg(affinities[5]), 6) AS a4 FROM aff GROUP BY 1",
    "collection_counts": f"WITH {_MEMBERS} SELECT c_custkey AS collection, c_name AS name, (SELECT count(DISTINCT image) FROM mem WHERE collection = c_custkey AND removed_ts IS NULL) AS members, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS notes FROM customer",
    "members_added": f"WITH {_MEMBERS}, ad AS (SELECT collection, image FROM mem WHERE image % 3 = 0 UNION SELECT collection + 1, image FROM mem WHERE image % 50 = 0) SELECT * FROM mem UNION ALL SELECT collection, image, greatest(TIMESTAMP '1995-01-01', (SELECT max(added_ts) + INTERVAL 1 MILLISECOND FROM mem m WHERE m.collection = ad.collection AND m.image = ad.image)), NULL FROM ad WHERE (collection, image) NOT IN (SELECT collection, image FROM mem WHERE removed_ts IS NULL)",
    "members_removed": f"WITH {_MEMBERS} SELECT collection, image, added_ts, CASE WHEN removed_ts IS NULL AND image % 3 = 0 THEN greatest(TIMESTAMP '1996-01-01', added_ts) ELSE removed_ts END AS removed_ts FROM mem",
    "merge_collections_lww": f"WITH d AS ({_DOC(0)} UNION ALL {_DOC(1)}), c AS (SELECT collection, min(created_ts) AS created_ts FROM d GROUP BY 1) SELECT collection, name, description, status, c.created_ts, updated_ts FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY updated_ts DESC, name, description, status) AS r FROM d) JOIN c USING (collection) WHERE r = 1",
    "merge_members": f"WITH {_MEMBERS} SELECT collection, image, added_ts, min(removed_ts) AS removed_ts FROM (SELECT * FROM mem UNION ALL SELECT collection, image, added_ts, CASE WHEN image % 4 = 0 THEN added_ts + INTERVAL 10 DAYS END FROM mem WHERE image % 2 = 0) GROUP BY ALL",
    "merge_notes": f"WITH {_NOTES2} SELECT collection, note, ts, min(text) AS text FROM n2 GROUP BY ALL",
    "note_conflicts": f"WITH {_NOTES2} SELECT collection, note, ts, text FROM (SELECT *, row_number() OVER (PARTITION BY note ORDER BY text) AS r FROM n2) WHERE r > 1",
    "scope_folder": f"{FIXTURE_SQL} SELECT image FROM paths WHERE active AND starts_with(rel_path, 'Shoot12/roll3/')",
}
from .text_plans import SQL as _TEXT_SQL  # noqa: E402

_JUDGED = f"ranked AS (SELECT item_id AS query, doc_id AS item, rank FROM ({_TEXT_SQL['bm25_batch']})), relevant AS (SELECT query, item FROM ranked WHERE item % 3 <> 1 UNION SELECT item_id, -1 FROM benchmark WHERE item_id % 4 = 0)"
_METRICS = lambda ranked: f"""SELECT query, round(coalesce(h, 0) / 3.0::DOUBLE, 6) AS precision, round(CASE WHEN t > 0 THEN coalesce(h, 0) / t::DOUBLE ELSE 0 END, 6) AS recall, round(coalesce(1.0::DOUBLE / f, 0), 6) AS mrr, round(CASE WHEN t > 0 THEN coalesce(dcg, 0) / list_sum(list_transform(range(1, least(t, 3) + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))) ELSE 0 END, 6) AS ndcg FROM (
  SELECT b.item_id AS query, (SELECT count(*) FROM relevant r WHERE r.query = b.item_id) AS t, x.h, x.f, x.dcg FROM benchmark b LEFT JOIN (SELECT query, count(*) FILTER (WHERE rank <= 3) AS h, min(rank) AS f, sum(CASE WHEN rank <= 3 THEN 1.0::DOUBLE / log2(rank + 1.0::DOUBLE) END) AS dcg FROM {ranked} JOIN relevant USING (query, item) GROUP BY query) x ON x.query = b.item_id)"""  # noqa: E731
SQL["regression_gate"] = f"""WITH {_JUDGED}, late AS (SELECT query, item, rank + 1 AS rank FROM ranked), x AS (SELECT round(avg(precision), 6) AS p, round(avg(recall), 6) AS r, round(avg(mrr), 6) AS m, round(avg(ndcg), 6) AS n FROM ({_METRICS('ranked')})),
  y AS (SELECT round(avg(precision), 6) AS p, round(avg(mrr), 6) AS m, round(avg(ndcg), 6) AS n FROM ({_METRICS('late')})), b AS (SELECT 'precision' AS metric, y.p AS measured, x.p AS baseline FROM x, y UNION ALL SELECT 'recall', NULL, r FROM x UNION ALL SELECT 'mrr', y.m, x.m FROM x, y UNION ALL SELECT 'ndcg', y.n, x.n FROM x, y)
  SELECT *, coalesce(measured >= baseline - greatest(0.01::DOUBLE, baseline * 0.05), false) AS ok FROM b"""
SQL["ir_metrics"] = f"WITH {_JUDGED} {_METRICS('ranked')}"
SQL["config_sweep"] = f"WITH {_JUDGED}, late AS (SELECT query, item, rank + 1 AS rank FROM ranked), fst AS (SELECT * FROM ranked WHERE rank = 1) " + " UNION ALL ".join(f"SELECT '{n}' AS config, count(*) AS queries, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM ({_METRICS(t)})" for n, t in (("all", "ranked"), ("late", "late"), ("first", "fst")))
