"""Registered queries of retrieval, context and the whole question."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import context, graph
from ..operators import retrieve as rt
from ..operators.settle import fresh_folder
from ..sources import files
from ..tables import table
from .kg import EDGES_SQL, key_edges
from .registry import query

QUESTIONS = "q AS (SELECT n_nationkey AS qid, 'Who supplies ' || n_name || ' and what about ' || r_name || '?' AS question FROM nation JOIN region ON n_regionkey = r_regionkey)"
NAMES = "en AS (SELECT n_name AS entity FROM nation UNION SELECT r_name FROM region UNION SELECT DISTINCT p_name FROM part)"


def _questions(spark, sf):
    t = lambda n: table(spark, sf, n)
    both = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("Who supplies "), "n_name", F.lit(" and what about "), "r_name", F.lit("?")).alias("question"))


def _names(spark, sf):
    t = lambda n: table(spark, sf, n)
    return t("nation").select(F.col("n_name").alias("entity")).union(t("region").select("r_name")).union(t("part").select("p_name")).distinct()


KNOWN = "kn AS (SELECT qid, entity FROM q, en WHERE contains(lower(question), lower(entity)) OR len(list_intersect(list_filter(string_split(lower(question), ' '), lambda w: length(w) > 2), string_split(lower(entity), ' '))) > 0)"


@query("j5_known_matches", f"WITH {QUESTIONS}, {NAMES}, {KNOWN} SELECT qid, entity FROM kn")
def known_matches(spark, sf):
    return rt.known_matches(_questions(spark, sf), _names(spark, sf))


@query("j6_best_matches", f"WITH {NAMES}, c AS (SELECT DISTINCT split_part(p_name, ' ', 1) || ' widget' AS candidate FROM part), s AS (SELECT candidate, entity, CASE WHEN contains(lower(entity), lower(candidate)) THEN length(candidate) / length(entity) WHEN contains(lower(candidate), lower(entity)) THEN length(entity) / length(candidate) ELSE len(list_intersect(string_split(lower(candidate), ' '), string_split(lower(entity), ' '))) / greatest(len(string_split(candidate, ' ')), len(string_split(entity, ' '))) * 0.8::DOUBLE END AS score FROM c, en) SELECT candidate, entity, score FROM (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, length(entity), entity) AS r FROM s WHERE score > 0.5) WHERE r = 1")
def best_matches(spark, sf):
    c = table(spark, sf, "part").select(F.concat(F.split("p_name", " ")[0], F.lit(" widget")).alias("candidate")).distinct()
    return rt.best_matches(c, _names(spark, sf))


@query("j7_legacy_entities", f"WITH {QUESTIONS}, {NAMES} SELECT qid, entity FROM (SELECT qid, entity, row_number() OVER (PARTITION BY qid ORDER BY entity) AS r FROM q, en WHERE contains(lower(question), lower(entity)) OR len(list_filter(string_split(lower(question), ' '), lambda w: length(w) > 3 AND contains(lower(entity), w))) > 0) WHERE r <= 10")
def legacy(spark, sf):
    return rt.legacy_entities(_questions(spark, sf), _names(spark, sf)).select("qid", "entity")


@query(
    "e2_pattern_candidates",
    f"""WITH {QUESTIONS}, f AS (SELECT qid, CASE qid % 4 WHEN 0 THEN [split_part(split_part(question, 'about ', 2), '?', 1)] WHEN 1 THEN ['a ' || qid, 'b' || qid] WHEN 2 THEN ['Ann', 'Bob', 'Ann', 'Bob', 'Ann'] ELSE ['homer'] END AS c FROM q)
SELECT qid, (i - 1)::INT AS pos, c[i] AS candidate FROM (SELECT qid, c, unnest(range(1, len(c) + 1)) AS i FROM f)""",
)
def candidates(spark, sf):
    """Questions that ask about something, quote, ask for a relationship, and ask who someone is."""
    q, qid = _questions(spark, sf), F.col("qid")
    quoted = F.concat(F.lit('tell of "a '), qid, F.lit("\" or 'b"), qid, F.lit("'"))
    form = F.when(qid % 4 == 0, F.col("question")).when(qid % 4 == 1, quoted).when(qid % 4 == 2, F.lit("the relationship between Ann and Bob")).otherwise(F.lit("who is homer"))
    return q.select("qid", F.posexplode(rt.pattern_candidates(form)).alias("pos", "candidate"))


@query("e1_question_entities", f"WITH {QUESTIONS}, {NAMES}, {KNOWN} SELECT qid, r::INT AS rank, entity, 'known' AS source FROM (SELECT qid, entity, row_number() OVER (PARTITION BY qid ORDER BY length(entity), entity) AS r FROM kn) WHERE r <= 10")
def question_entities(spark, sf):
    """All that a candidate resolves to here is known already, and a known match comes first."""
    return rt.question_entities(_questions(spark, sf), _names(spark, sf))


@query("e4_explain", f"WITH {QUESTIONS} SELECT qid, list_distinct(list_filter(string_split(lower(question), ' '), lambda w: length(w) > 2))[1] AS first_word, len(list_distinct(list_filter(string_split(lower(question), ' '), lambda w: length(w) > 2)))::INT AS n_words FROM q WHERE false UNION ALL SELECT qid, 'who', len(list_distinct(list_filter(string_split(lower(question), ' '), lambda w: length(w) > 2)))::INT FROM q")
def explain(spark, sf):
    return rt.explain_entities(_questions(spark, sf)).select("qid", F.element_at("words", 1).alias("first_word"), F.size("words").alias("n_words"))


def _passages(spark, sf):
    """Each vector as a passage with the text of a document."""
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents")
    return e.join(d, F.col("vec_id") == F.col("doc_id")).select((F.col("vec_id") % 40 + 1).cast("int").alias("page_num"), F.col("label").alias("chunk_num"), F.concat(F.lit("page"), F.col("vec_id") % 40 + 1).alias("page"), "source", F.col("text").alias("content"), "embedding", "vec_id")


def _vector(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id = 3").first()["embedding"]


SCORED = "v AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 3), s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS score FROM embeddings, v)"


@query("v1_similarity_scores", f"WITH {SCORED} SELECT vec_id, round(score, 6) AS score FROM s")
def scores(spark, sf):
    return rt.scored(table(spark, sf, "embeddings"), _vector(spark, sf)).select("vec_id", F.round("score", 6).alias("score"))


@query("p7_threshold", f"WITH {SCORED} SELECT vec_id FROM s WHERE score >= 0.25")
def threshold(spark, sf):
    return rt.scored(table(spark, sf, "embeddings"), _vector(spark, sf)).where("score >= 0.25").select("vec_id")


@query("v2_adaptive_threshold", f"WITH {SCORED}, o AS (SELECT * FROM s WHERE vec_id <> 3), t AS (SELECT CASE WHEN max(score) >= 0.75 THEN 0.75 WHEN max(score) >= 0.5 THEN 0.5 ELSE 0.25 END::DOUBLE AS threshold FROM o) SELECT vec_id, round(score, 6) AS score, threshold FROM o, t WHERE score >= threshold")
def adaptive(spark, sf):
    return rt.adaptive(table(spark, sf, "embeddings").where("vec_id <> 3"), _vector(spark, sf)).select("vec_id", F.round("score", 6).alias("score"), "threshold")


PASSAGES = f"{SCORED}, p AS (SELECT vec_id, (vec_id % 40 + 1)::INT AS page_num, label AS chunk_num, text AS content, score FROM s JOIN documents ON vec_id = doc_id WHERE score >= -0.2), d AS (SELECT *, row_number() OVER (PARTITION BY page_num, chunk_num ORDER BY score DESC, length(content), content) AS r, count(*) OVER (PARTITION BY page_num, chunk_num) AS copies FROM p)"


def _distinct(spark, sf):
    return rt.distinct_passages(rt.scored(_passages(spark, sf), _vector(spark, sf)).where("score >= -0.2"))


@query("a8_distinct_passages", f"WITH {PASSAGES} SELECT page_num, chunk_num, vec_id, copies FROM d WHERE r = 1")
def distinct(spark, sf):
    return _distinct(spark, sf).select("page_num", "chunk_num", "vec_id", "copies")


BUDGET = ", w AS (SELECT *, sum(length(content) // 4) OVER (ORDER BY score DESC, page_num, chunk_num ROWS UNBOUNDED PRECEDING) AS used FROM d WHERE r = 1)"


@query("w3_token_budget", f"WITH {PASSAGES}{BUDGET} SELECT vec_id, used::BIGINT AS used FROM w WHERE used <= 9000")
def token_budget(spark, sf):
    return rt.within_budget(_distinct(spark, sf), 9000, [F.desc("score"), "page_num", "chunk_num"]).select("vec_id", "used")


@query("p10_excerpts", f"WITH {PASSAGES} SELECT page_num, chunk_num, left(content, 500) AS excerpt, 'rag' AS source, length(content)::INT AS full_length FROM d WHERE r = 1")
def excerpts(spark, sf):
    return context.excerpts(_distinct(spark, sf)).drop("page")


@query("j18_page_sources", "SELECT page_num, max_by(source, chunk_num) AS source FROM (SELECT doc_id % 40 AS page_num, doc_id AS chunk_num, source FROM documents) GROUP BY page_num")
def page_sources(spark, sf):
    return context.page_sources(table(spark, sf, "documents").select((F.col("doc_id") % 40).alias("page_num"), F.col("doc_id").alias("chunk_num"), "source"))


@query("j17_provenance", f"WITH {EDGES_SQL}, p AS (SELECT DISTINCT (doc_id % 4 + 1)::INT AS page_num FROM documents), k AS (SELECT page_num, count(*)::INT AS n FROM e GROUP BY page_num) SELECT coalesce(p.page_num, k.page_num) AS page_num, CASE WHEN p.page_num IS NOT NULL THEN 'rag' ELSE 'kg' END AS source, n FROM p FULL JOIN k ON p.page_num = k.page_num")
def provenance(spark, sf):
    pages = table(spark, sf, "documents").select((F.col("doc_id") % 4 + 1).cast("int").alias("page_num"))
    return context.provenance(pages, key_edges(spark, sf)).select("page_num", "source", F.size("kg_edges").alias("n"))


@query("s12_page_texts", "SELECT doc_id::INT AS page_num, CASE WHEN length(text) > 10000 THEN left(text, 10000) || chr(10) || '... [' || (length(text) - 10000) || ' more characters]' ELSE text END AS text FROM documents UNION ALL SELECT (SELECT max(doc_id) + 1 FROM documents)::INT, '[Page ' || (SELECT max(doc_id) + 1 FROM documents) || ' not found]'")
def page_texts(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("doc_id").cast("int")
    name = F.when(n % 3 == 0, F.format_string("page%03d.txt", n)).when(n % 3 == 1, F.format_string("page%04d.txt", n)).otherwise(F.format_string("page_%03d.txt", n))
    pages = d.select(F.concat(F.lit("/in/"), name).alias("source"), name.alias("page"), F.col("text").alias("content"))
    missing = d.agg((F.max("doc_id") + 1).cast("int").alias("page_num"))
    wanted = d.select(n.alias("page_num")).unionByName(missing)
    return context.page_texts(wanted, pages, spark.createDataFrame([], "page_num int, source string"))


@query("f10_context", f"WITH {PASSAGES}{BUDGET}, b AS (SELECT content, row_number() OVER (ORDER BY used) AS i FROM w WHERE used <= 3000) SELECT md5(coalesce(string_agg('[Document Excerpt ' || i || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY i), '[No relevant document excerpts found]')) AS digest FROM b")
def context_text(spark, sf):
    p = rt.within_budget(_distinct(spark, sf), 3000, [F.desc("score"), "page_num", "chunk_num"]).withColumn("rank", F.col("used"))
    none = spark.createDataFrame([("",)], "context string")
    return context.context(p, none).select(F.md5("context").alias("digest"))


@query("v3_hybrid_query")
def hybrid(spark, sf):
    """Question entities, graph neighbourhood, passages in a budget, provenance and context in one row."""
    from ..api import hybrid_query

    return hybrid_query(spark, "What about ASIA and NATION_3?", key_edges(spark, sf), _passages(spark, sf), _vector(spark, sf)).select("rag_chunks", "rag_tokens_used", "rag_candidates", "rag_duplicates", "rag_unique", "subgraph_nodes", "subgraph_edges", "response")


@query("a19_timing_total", "SELECT l_orderkey, round(sum(l_tax), 6) AS total FROM lineitem GROUP BY l_orderkey")
def timing(spark, sf):
    m = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("l_linenumber", F.lit("/"), "l_partkey", F.lit("/"), "l_suppkey", F.lit("/"), "l_quantity").alias("k"), "l_tax"))).alias("t"))
    return m.select("l_orderkey", F.round(F.aggregate(F.map_values("t"), F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@query("s13_question_words", f"WITH {QUESTIONS} SELECT qid::INT AS id, CASE qid % 3 WHEN 0 THEN 'easy' ELSE 'hard' END AS difficulty, question, len(list_distinct(list_filter(string_split(lower(question), ' '), lambda w: length(w) > 2)))::INT AS n FROM q")
def question_rows(spark, sf):
    """Questions written as a question file and read again."""
    rows = _questions(spark, sf).select(F.struct(F.col("qid").cast("int").alias("id"), F.when(F.col("qid") % 3 == 0, "easy").otherwise("hard").alias("difficulty"), "question").alias("q"))
    path = fresh_folder(spark) + "/questions"
    # one question file; a nation a question
    rows.agg(F.to_json(F.struct(F.array_sort(F.collect_list("q")).alias("test_questions"))).alias("value")).write.text(path)
    read = files.read_questions(spark, path)
    return read.select("id", "difficulty", "question", F.size(rt.query_words("question")).alias("n"))
