"""Queries over text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import journal as J
from ..operators import names as R
from ..operators import search as S
from ..storage import new_folder
from .fixtures import journal, table, with_journal

QUERY = "the tion"
LONG_QUERY = "of the and"


def bm25_topk(spark, sf_dir):
    return S.search(table(spark, sf_dir, "documents"), QUERY)


def bm25_filtered_after_limit(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return S.search(table(spark, sf_dir, "documents"), LONG_QUERY).join(good, "doc_id", "left_semi")


_indexes: dict[tuple, str] = {}


def bm25_index(spark, sf_dir):
    """The index of the documents: (term, postings, tokens) of its longest lists."""
    folder = new_folder(spark, "index")
    S.build_index(table(spark, sf_dir, "documents"), folder)
    return spark.read.parquet(f"{folder}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("postings"), F.sum("tf").alias("tokens"))


def bm25_indexed(spark, sf_dir):
    """The same search over an index, which is built anew when the table's files are others than before."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/documents.parquet").select("path", "modificationTime", "length")
    at = spark.sparkContext.applicationId, sf_dir, *files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)"))).head()
    if at not in _indexes:
        folder = new_folder(spark, "index")
        S.build_index(table(spark, sf_dir, "documents"), folder)
        _indexes[at] = folder
    return S.search_index(spark, _indexes[at], QUERY)


def _targets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 50).alias("image"))


def search_session_split(spark, sf_dir):
    return S.hits_by_image(S.search(table(spark, sf_dir, "documents"), QUERY), _targets(spark, sf_dir))


def search_image_scoped(spark, sf_dir):
    images = spark.range(0, 50, 2).select(F.col("id").alias("image"))
    return S.hits_by_image(S.search(table(spark, sf_dir, "documents"), QUERY), _targets(spark, sf_dir), filtered=images)


def search_recent_ties(spark, sf_dir):
    """Images by their best hit, with scores in whole numbers: ties go to the last annotated."""
    hits = S.search(table(spark, sf_dir, "documents"), "of").withColumn("score", F.round("score"))
    targets = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 7 % 800).alias("image"))
    return S.ordered_images(S.hits_by_image(hits, targets).select("image", "score"), J.image_stats(journal(spark, sf_dir)))


def search_within(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return S.search_images(docs, docs.where("lang = 'en'").select("doc_id"), QUERY)


def search_snippets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return S.snippets(S.search(docs, QUERY).join(docs.select("doc_id", "text"), "doc_id"), QUERY).select("doc_id", "score", "snippet", "spans")


def postings_stats(spark, sf_dir):
    return S.postings(table(spark, sf_dir, "documents")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def bm25_batch(spark, sf_dir):
    return S.search_batch(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def ngram_counts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(text.grams(text.words(F.col("text")))).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


def fuzzy_match(spark, sf_dir):
    return S.fuzzy_matches(table(spark, sf_dir, "part"), "brasd stel", ["p_type", "p_brand", "p_name"], "p_partkey")


def fuzzy_appended_union(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return S.append_fuzzy(part.where("lower(p_name) LIKE '%a%' AND p_partkey % 5 = 0").select("p_partkey"), S.fuzzy_matches(part, "brasd stel", ["p_type", "p_brand", "p_name"], "p_partkey"), "p_partkey")


def chunk_spans(spark, sf_dir):
    return S.chunks(table(spark, sf_dir, "documents"), context=(F.col("lang"), F.col("source"))).select("doc_id", "chunk", "start", "end", F.sha2("embed_text", 256).alias("digest"))


def _turn_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hypothesis"))
    return c.select("conv_id", "turn", F.col("text").alias("reference")).join(nxt, ["conv_id", "turn"])


def wer_by_turn(spark, sf_dir):
    return S.word_errors(_turn_pairs(spark, sf_dir)).drop("reference", "hypothesis")


def wer_corpus(spark, sf_dir):
    return S.corpus_word_error(S.word_errors(_turn_pairs(spark, sf_dir)))


def input_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.input_digest(F.col("lang"), F.col("source"), F.col("text")).alias("digest"))


def stale_quotes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", S.quote(F.col("text"), F.lit(4), F.lit(12), F.when(F.col("doc_id") % 2 == 0, F.substring("text", 5, 8)).otherwise("stale")).alias("quote"))


def resolve_name_jw(spark, sf_dir):
    """Nations whose name is near a misspelled one, as collection names are resolved."""
    names = table(spark, sf_dir, "nation").select("n_nationkey", text.collapsed(F.col("n_name")).alias("name"))
    asked = spark.createDataFrame([("germny",), ("nation 1",), ("untied kingdom",), ("brasil",)], "asked string")
    near = asked.join(F.broadcast(names)).withColumn("score", F.round(similarity.jaro_winkler_column(F.col("asked"), F.col("name")), 6)).where("score >= 0.80")
    return S.top_per_group(near, ["asked"], [F.desc("score"), F.col("n_nationkey")], 1).drop("rank")


def resolve_names(spark, sf_dir):
    """What each customer meant by a misspelled part name; parts of one name differ in status and time."""
    part = table(spark, sf_dir, "part")
    status = F.element_at(F.array(F.lit("done"), F.lit("active"), F.lit("shelved"), F.lit("gone")), (F.col("p_size") % 4 + 1).cast("int"))
    names = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), status.alias("status"), F.timestamp_seconds(F.col("p_partkey") * 37 % 50).alias("updated_ts"))
    typed = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("  "), F.upper("p_name"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.substring("p_name", 1, 1), F.substring("p_name", 3, 99))).when(F.col("c_custkey") % 4 == 2, F.concat("p_name", F.lit("s"))).otherwise("no such thing")
    asked = table(spark, sf_dir, "customer").join(part, F.col("c_custkey") == F.col("p_partkey")).select("c_custkey", typed.alias("asked"))
    return R.resolve(asked, names)


QUERIES = [bm25_topk, bm25_index, bm25_indexed, bm25_filtered_after_limit, search_recent_ties, search_session_split, search_image_scoped, search_within, search_snippets, postings_stats, bm25_batch, ngram_counts, fuzzy_match, fuzzy_appended_union, chunk_spans, wer_by_turn, wer_corpus, input_digests, stale_quotes, resolve_name_jw, resolve_names]

TOKENS = "list_filter(string_split_regex(strip_accents(lower(text)), '[^\\pL\\pN]+'), lambda t: t <> '')"


def bm25_sql(terms: list[tuple[str, bool]], limit: int = 500) -> str:
    cond = lambda t, p: f"starts_with(t, '{t}')" if p else f"t = '{t}'"
    fs = ", ".join(f"len(list_filter(toks, lambda t: {cond(t, p)})) AS f{i}" for i, (t, p) in enumerate(terms))
    idf = lambda i: f"CASE WHEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) > 0 THEN ln((n - d{i} + 0.5) / (d{i} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(i)}) * (f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av)))" for i in range(len(terms)))
    return f"""toks AS (SELECT doc_id, coalesce({TOKENS}, []) AS toks FROM documents), counted AS (SELECT doc_id, len(toks)::DOUBLE AS len, {fs} FROM toks),
      corpus AS (SELECT count(*)::DOUBLE AS n, sum(len) / count(*) AS av, {', '.join(f'count(*) FILTER (WHERE f{i} > 0)::DOUBLE AS d{i}' for i in range(len(terms)))} FROM counted),
      hits AS (SELECT doc_id, round(-({score}), 6) AS score FROM counted, corpus WHERE {' AND '.join(f'f{i} > 0' for i in range(len(terms)))} ORDER BY 2, 1 LIMIT {limit})"""


_TOP = bm25_sql([("the", False), ("tion", True)])
_TARGETS = "targets AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 50 END AS image FROM documents)"
_BEST = "SELECT image, arg_min(doc_id, (score, doc_id)) AS doc_id, min(score) AS score FROM hits JOIN targets USING (doc_id) WHERE image IS NOT NULL {} GROUP BY image"
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_NEAR = lambda col, t, n: f"(contains(lower({col}), '{t}') OR len(list_filter(string_split_regex(lower({col}), '[^\\pL\\pN]+'), lambda p: p <> '' AND levenshtein(p, '{t}') <= {n})) > 0)"
_FUZZY = f"""fuzzy AS (SELECT p_partkey, place, CASE place WHEN 0 THEN 'p_type' WHEN 1 THEN 'p_brand' ELSE 'p_name' END AS field FROM (
   SELECT p_partkey, CASE WHEN {_NEAR('p_type', 'brasd', 2)} OR {_NEAR('p_type', 'stel', 1)} THEN 0 WHEN {_NEAR('p_brand', 'brasd', 2)} OR {_NEAR('p_brand', 'stel', 1)} THEN 1 WHEN {_NEAR('p_name', 'brasd', 2)} OR {_NEAR('p_name', 'stel', 1)} THEN 2 END AS place FROM part)
   WHERE place IS NOT NULL ORDER BY place, p_partkey LIMIT 500)"""
SQL = {
    "bm25_topk": f"WITH {_TOP} SELECT * FROM hits",
    "bm25_indexed": f"WITH {_TOP} SELECT * FROM hits",
    "bm25_index": f"SELECT term, count(*) AS postings, sum(tf)::BIGINT AS tokens FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL) GROUP BY term",
    "search_recent_ties": with_journal("SELECT image, score, last_ts, (row_number() OVER (ORDER BY score, last_ts DESC NULLS LAST, image))::INTEGER AS place FROM (SELECT doc_id * 7 % 800 AS image, min(round(score)) AS score FROM hits GROUP BY 1) LEFT JOIN stats USING (image)", bm25_sql([("of", True)])),
    "bm25_filtered_after_limit": f"WITH {bm25_sql([('of', False), ('the', False), ('and', True)])} SELECT * FROM hits WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "search_session_split": f"WITH {_TOP}, {_TARGETS} {_BEST.format('')} UNION ALL SELECT NULL, doc_id, score FROM hits JOIN targets USING (doc_id) WHERE image IS NULL",
    "search_image_scoped": f"WITH {_TOP}, {_TARGETS} {_BEST.format('AND image % 2 = 0')}",
    "search_within": f"WITH {bm25_sql([('the', False), ('tion', True)], 10**9)} SELECT * FROM hits WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "postings_stats": f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL) GROUP BY term",
    "bm25_batch": f"""WITH asked AS (SELECT DISTINCT item_id, unnest({TOKENS}) AS term FROM benchmark), toks AS (SELECT doc_id, {TOKENS} AS toks FROM documents), size AS (SELECT count(*)::DOUBLE AS n, sum(len(toks)) / count(*)::DOUBLE AS av FROM toks),
      post AS (SELECT doc_id, term, count(*)::DOUBLE AS tf, any_value(len) AS len FROM (SELECT doc_id, len(toks)::DOUBLE AS len, unnest(toks) AS term FROM toks) WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term), df AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term),
      w AS (SELECT doc_id, term, greatest(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END, 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av)) AS w FROM post JOIN df USING (term), size),
      need AS (SELECT item_id, count(*) AS terms FROM asked GROUP BY 1), s AS (SELECT item_id, doc_id, round(-sum(w), 6) AS score FROM asked JOIN w USING (term) JOIN need USING (item_id) GROUP BY item_id, doc_id, terms HAVING count(*) = terms)
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 10""",
    "ngram_counts": f"""WITH w AS (SELECT list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda t: t <> '') AS w FROM benchmark), g AS (SELECT n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])) AS g FROM w, (VALUES (1), (2), (3)) v(n) WHERE len(w) >= n)
      SELECT array_to_string(g, ' ') AS phrase, count(*) AS n FROM g WHERE g[1] NOT IN ({_STOP}) AND g[-1] NOT IN ({_STOP}) AND (len(g) > 1 OR strlen(g[1]) > 2) GROUP BY 1""",
    "fuzzy_match": f"WITH {_FUZZY} SELECT p_partkey, field FROM fuzzy",
    "fuzzy_appended_union": f"WITH {_FUZZY}, ex AS (SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%a%' AND p_partkey % 5 = 0) SELECT p_partkey, 'exact' AS lane FROM ex UNION ALL SELECT p_partkey, 'fuzzy' FROM fuzzy WHERE p_partkey NOT IN (SELECT p_partkey FROM ex)",
    "input_digests": "SELECT doc_id, sha256(concat_ws(chr(31), coalesce(lang, ''), coalesce(source, ''), coalesce(text, ''))) AS digest FROM documents",
    "resolve_name_jw": "SELECT asked, n_nationkey, name, score FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, n_nationkey) AS r FROM (SELECT asked, n_nationkey, name, round(jaro_winkler_similarity(asked, name), 6) AS score FROM (SELECT n_nationkey, trim(regexp_replace(lower(n_name), '\\s+', ' ', 'g')) AS name FROM nation), (VALUES ('germny'), ('nation 1'), ('untied kingdom'), ('brasil')) v(asked)) WHERE score >= 0.80) WHERE r = 1",
    "resolve_names": """WITH n AS (SELECT p_partkey AS id, lower(p_name) AS name, CASE p_size % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS rank, p_partkey * 37 % 50 AS t FROM part),
      a AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '  ' || upper(p_name) WHEN 1 THEN substr(p_name, 1, 1) || substr(p_name, 3) WHEN 2 THEN p_name || 's' ELSE 'no such thing' END AS asked FROM customer JOIN part ON c_custkey = p_partkey),
      d AS (SELECT DISTINCT trim(lower(asked)) AS q FROM a), s AS (SELECT q, name, round(jaro_winkler_similarity(q, name), 9) AS score FROM d, (SELECT DISTINCT name FROM n)),
      r AS (SELECT q, id, name, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, rank, t DESC, id) AS r FROM s JOIN n USING (name) WHERE score >= 0.80)
      SELECT c_custkey, asked, id, name, score FROM a LEFT JOIN r ON q = trim(lower(asked)) AND r = 1""",
    "stale_quotes": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR substring(text, 5, 8) = 'stale' THEN substring(text, 5, 8) END AS quote FROM documents",
}
