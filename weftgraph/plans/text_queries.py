"""Registered queries over texts: functions, patterns, chunks, extraction and entity names."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import plugins
from ..functions import patterns as pt
from ..functions import text as tx
from ..operators import resolve, triples
from ..sources import files
from ..tables import table
from ..vocab import PATTERNS, TYPES
from .registry import query

#: SQL word boundaries that hold for all letters, as Spark's do.
_EDGE = r"[^\p{L}\p{N}_]"


def _re2(p: str) -> str:
    """A pattern for DuckDB: leading and trailing word boundaries spelled out."""
    if p.startswith(r"\b"):
        p = rf"(?:^|{_EDGE}){p[2:]}"
    if p.endswith(r"\b"):
        p = rf"{p[:-2]}(?:$|{_EDGE})"
    return "(?im)" + p.replace("'", "''")


def _score_sql(column: str, kind: str, language: str = "en") -> str:
    own = PATTERNS[language][kind]
    return "(" + " + ".join(f"regexp_matches({column}, '{_re2(p)}')::INT" for p in own) + f") / {len(own)}.0::DOUBLE"


def _words_sql(language: str) -> str:
    from ..vocab import LANGUAGE_WORDS

    own = LANGUAGE_WORDS[language]
    return "(" + " + ".join(f"regexp_matches(text, '{_re2(chr(92) + 'b' + w + chr(92) + 'b')}')::INT" for w in own) + f") / {len(own)}.0::DOUBLE"


def _docs(spark, sf):
    return table(spark, sf, "documents")


SCORES = ", ".join(f"{_score_sql('text', t)} AS {t}" for t in TYPES)
FRENCH = ", ".join(f"{_score_sql('text', t, 'fr')} AS {t}" for t in TYPES)
PICK = "CASE WHEN trim(text) = '' OR greatest(technical, conversational, scientific, narrative) < 0.3 THEN 'unknown' WHEN technical >= greatest(conversational, scientific, narrative) THEN 'technical' WHEN conversational >= greatest(scientific, narrative) THEN 'conversational' WHEN scientific >= narrative THEN 'scientific' ELSE 'narrative' END"


@query("c2_type_scores", f"SELECT doc_id, {SCORES} FROM documents")
def type_scores(spark, sf):
    return _docs(spark, sf).select("doc_id", pt.DEFAULT.scores(F.col("text")).alias("s")).select("doc_id", *[f"s.{t}" for t in TYPES])


@query("c1_detect_type", f"SELECT doc_id, {PICK} AS type, greatest(technical, conversational, scientific, narrative) AS confidence FROM (SELECT doc_id, text, {SCORES} FROM documents)")
def detect_type(spark, sf):
    return _docs(spark, sf).select("doc_id", pt.DEFAULT.detect(F.col("text")).alias("d")).select("doc_id", "d.type", "d.confidence")


@query("c3_language", f"SELECT doc_id, CASE WHEN fr > en AND fr > 0.1 THEN 'fr' ELSE 'en' END AS language FROM (SELECT doc_id, {_words_sql('en')} AS en, {_words_sql('fr')} AS fr FROM documents)")
def language(spark, sf):
    return _docs(spark, sf).select("doc_id", pt.language(F.col("text")).alias("language"))


@query(
    "c4_detect_any_language",
    f"""WITH l AS (SELECT doc_id, text, {_words_sql('en')} AS en, {_words_sql('fr')} AS fr FROM documents),
s AS (SELECT doc_id, text, {SCORES} FROM l WHERE NOT (fr > en AND fr > 0.1) UNION ALL SELECT doc_id, text, {FRENCH} FROM l WHERE fr > en AND fr > 0.1)
SELECT doc_id, {PICK} AS type FROM s""",
)
def detect_any(spark, sf):
    return _docs(spark, sf).select("doc_id", pt.DEFAULT.detect_any(F.col("text"))["type"].alias("type"))


@query("a3_type_histogram", f"SELECT {PICK} AS type, count(*) AS n FROM (SELECT text, {SCORES} FROM conversations) GROUP BY 1")
def histogram(spark, sf):
    return table(spark, sf, "conversations").select(pt.DEFAULT.detect(F.col("text"))["type"].alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("c5_matched_patterns", f"SELECT doc_id, CASE WHEN fr > en AND fr > 0.1 THEN 'fr' ELSE 'en' END AS language, " + ", ".join(f"({_score_sql('text', t).split(' / ')[0]})::INT AS {t}" for t in TYPES) + f" FROM (SELECT doc_id, text, {_words_sql('en')} AS en, {_words_sql('fr')} AS fr FROM documents)")
def matched(spark, sf):
    return _docs(spark, sf).select("doc_id", pt.language(F.col("text")).alias("language"), *[F.size(pt.DEFAULT.matched(F.col("text"), t)).alias(t) for t in TYPES])


@query("c2_added_pattern", "SELECT doc_id, (" + " + ".join(f"regexp_matches(text, '{_re2(p)}')::INT" for p in [*PATTERNS["en"]["technical"], r"\blicensed\b"]) + ") / 9.0::DOUBLE AS technical FROM documents")
def added(spark, sf):
    return _docs(spark, sf).select("doc_id", pt.DEFAULT.add("technical", r"\blicensed\b").score(F.col("text"), "technical").alias("technical"))


@query("c6_model_classifier", "SELECT doc_id, CASE WHEN contains(left(text, 500), 'a') AND NOT contains(left(text, 500), '!') THEN 'technical' WHEN contains(left(text, 500), '!') THEN 'unknown' ELSE 'narrative' END AS doc_type FROM documents")
def classified(spark, sf):
    """A model by rule: a bad word for texts that shout, else technical for those with an a, else narrative."""

    def model():
        def answer(prompts):
            texts = [p.split("\n\n", 1)[1] for p in prompts]
            return ["shouting" if "!" in t else "TYPE: technical" if "a" in t else "Narrative" for t in texts]

        return answer

    return plugins.classify(_docs(spark, sf).select("doc_id", "text"), model).select("doc_id", "doc_type")


FOLD = "replace(lower({c}), 'ß', 'ss')"
NORM = r"regexp_replace(regexp_replace(regexp_replace(" + FOLD + r", '[\s\x1c-\x1f\x{{85}}\x{{a0}}]+', ' ', 'g'), '^[[:punct:] ]+|[[:punct:] ]+$', '', 'g'), '^(?:the|a|an|le|la|les|un|une)(?: |$)', '')"


def _sentences(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s"))


SENTENCES = "SELECT doc_id, s, i - 1 AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)"


@query("f1_normalize", f"SELECT doc_id, i::INT AS i, {NORM.format(c='s')} AS norm FROM ({SENTENCES})")
def normalize(spark, sf):
    return _sentences(spark, sf).select("doc_id", "i", tx.normalize_entity("s").alias("norm"))


@query("f2_base_form", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name WHEN 2 THEN 'Sir' ELSE 'of ' || c_name END AS base FROM customer")
def base(spark, sf):
    c = table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("King "), "c_name")).when(F.col("c_custkey") % 4 == 1, F.col("c_name")).when(F.col("c_custkey") % 4 == 2, F.lit("Sir")).otherwise(F.concat(F.lit("Lady of "), "c_name"))
    return c.select("c_custkey", tx.base_form(name).alias("base"))


@query("f3_similarity_ratio")
def similarity(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("a")).distinct()
    return p.join(p.withColumnRenamed("a", "b"), F.split("a", " ")[1] == F.split("b", " ")[1]).select("a", "b", F.round(resolve.ratio("a", "b"), 6).alias("ratio"))


@query("f5_tokens_budget", "SELECT doc_id, (length(text) // 4)::BIGINT AS tokens, greatest(123000 - length(text) // 4, 10000)::BIGINT AS budget FROM documents")
def budget(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.tokens("text").alias("tokens"), tx.context_budget("text").alias("budget"))


CHUNKS = r"""s AS (SELECT doc_id, string_split(regexp_replace(trim(text, E' \n\t\r'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents),
f AS (SELECT doc_id, 0 AS i, l, '' AS cur, ''::VARCHAR AS out, false AS emit FROM s
UNION ALL SELECT doc_id, i + 1, l, CASE WHEN length(cur) + length(l[i + 1]) <= 500 THEN cur || l[i + 1] || ' ' ELSE right(cur, 50) || l[i + 1] || ' ' END,
  trim(cur, E' \n\t\r'), length(cur) + length(l[i + 1]) > 500 AND trim(cur, E' \n\t\r') <> '' FROM f WHERE i < len(l)),
c AS (SELECT doc_id, i, out AS text FROM f WHERE emit UNION ALL SELECT doc_id, i + 1, trim(cur, E' \n\t\r') FROM f WHERE i = len(l) AND trim(cur, E' \n\t\r') <> ''),
k AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS chunk_idx, text FROM c)"""


@query("f6_sentence_chunks", f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_idx, text FROM k")
def chunked(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(tx.chunks("text", 500, 50)).alias("chunk_idx", "text"))


@query("w8_batches", f"WITH RECURSIVE {CHUNKS} SELECT doc_id AS page_num, (chunk_idx // 4)::INT AS batch_idx, string_agg(text, chr(10) || chr(10) ORDER BY chunk_idx) AS text FROM k GROUP BY ALL")
def batched(spark, sf):
    pages = _docs(spark, sf).select(F.col("doc_id").alias("page_num"), F.lit("").alias("page"), "source", F.col("text").alias("content"))
    return files.page_batches(pages).select("page_num", "batch_idx", "text")


@query("f7_line_chunks")
def line_chunks(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(tx.line_chunks("text")).alias("chunk_num", "content"))


@query("s6_line_batches", r"WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS l FROM documents), b AS (SELECT doc_id, l, unnest(range(0, ((len(l) - 1) // 50 + 1)::BIGINT)) AS b FROM l) SELECT doc_id, b::INT AS batch_idx, array_to_string(l[b * 50 + 1:b * 50 + 50], chr(10)) AS text FROM b")
def line_batches(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(files.text_batches("text")).alias("batch_idx", "text"))


@query("w1_page_numbers", "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_num FROM documents")
def page_numbers(spark, sf):
    from pyspark.sql import Window as W

    return _docs(spark, sf).select("source", "doc_id", F.row_number().over(W.partitionBy("source").orderBy("doc_id")).cast("long").alias("page_num"))


@query("a20_processing_estimate", r"SELECT doc_id, length(text)::INT AS chars, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS words, greatest(1, length(text) // 800)::INT AS chunks, (greatest(1, length(text) // 800) * 2)::INT AS low_s, (greatest(1, length(text) // 800) * 5)::INT AS high_s FROM documents")
def estimate(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.processing_estimate("text").alias("e")).select("doc_id", "e.*")


@query("k11_sanitize_path", r"SELECT page_id, regexp_replace(regexp_replace(url, '^[./\\]+', ''), '[/\\]', '_', 'g') AS name FROM pages")
def sanitize(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.sanitize_path("url").alias("name"))


@query("p1_strip_triples", r"SELECT p_partkey AS seq, p_name AS subject, p_brand AS predicate, p_type AS object FROM part")
def stripped(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit(" \t"), "p_name", F.lit("\n")).alias("subject"), F.col("p_brand").alias("predicate"), F.concat("p_type", F.lit("  ")).alias("object"))
    return triples.normalized(p)


VALID = "length({c}) >= 2 AND lower({c}) NOT IN ('he','she','it','they','we','you','i','me','him','her','them','us')"
STRICT = VALID + " AND len(string_split({c}, ' ')) <= 4 AND lower({c}) NOT IN ('speaker','person','someone','something','thing','place','time','way') AND len(list_filter(string_split({c}, ' '), lambda w: lower(w) = w AND upper(w) <> w)) <= len(string_split({c}, ' ')) // 2"


@query("p2_valid_entity", f"SELECT p_partkey, {STRICT.format(c='p_name')} AS strict, {STRICT.format(c='p_brand')} AS strict_brand, {VALID.format(c='p_name')} AS verbose FROM part")
def valid_entity(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tx.valid_entity("p_name").alias("strict"), tx.valid_entity("p_brand").alias("strict_brand"), tx.valid_entity("p_name", "verbose").alias("verbose"))


@query("p3_valid_triples", f"SELECT p_partkey AS seq, p_brand AS subject, 'IS_A' AS predicate, p_type AS object FROM part WHERE {STRICT.format(c='p_brand')} AND {STRICT.format(c='p_type')}")
def valid_triples(spark, sf):
    return triples.valid(table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("subject"), F.lit("IS_A").alias("predicate"), F.col("p_type").alias("object")))


@query("x2_pattern_triples")
def pattern_triples(spark, sf):
    pages = _docs(spark, sf).select(F.col("doc_id").alias("page_num"), F.lit("").alias("page"), "source", F.col("text").alias("content"))
    return triples.extract(files.page_batches(pages)).select("seq", "subject", "predicate", "object", "page_num")


NAMED = "SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS a, CASE c_custkey % 3 WHEN 0 THEN 'ship owner' WHEN 1 THEN 'dealer in wine' ELSE 'x' END AS b FROM customer"


@query(
    "x2_literal_triples",
    f"""WITH c AS ({NAMED}) SELECT c_custkey, a AS s, 'IS_A' AS p, b AS o FROM c WHERE length(b) > 2 AND c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'Priam', 'RULES', a FROM c WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, a, 'RELATED_TO', 'Bob' FROM c WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'Bob', 'RELATED_TO', a FROM c WHERE c_custkey % 7 = 0""",
)
def literal_triples(spark, sf):
    """Sentences with a copula, a title and conjunctions, each in some rows only, and with objects too short to keep."""
    k, a = F.col("c_custkey"), F.initcap(F.lower("c_mktsegment"))
    b = F.when(k % 3 == 0, "ship owner").when(k % 3 == 1, "dealer in wine").otherwise("x")
    copula = F.when(k % 2 == 0, F.concat(a, F.lit(" is a "), b, F.lit("."))).otherwise(F.lit(""))
    title = F.when(k % 5 != 0, F.concat(F.lit(" Priam, king of "), a, F.lit("."))).otherwise(F.lit(""))
    both = F.when(k % 7 == 0, F.concat(F.lit(" "), a, F.lit(" and Bob. Bob et "), a)).otherwise(F.lit(""))
    rows = table(spark, sf, "customer").select(k, F.concat(copula, title, both).alias("t"))
    return rows.select("c_custkey", F.inline(triples.pattern_triples(F.col("t"))))


@query("x3_parse_answers", "SELECT n_nationkey, n_name AS s, 'PART_OF' AS p, 'R' || n_regionkey AS o FROM nation")
def parse_answers(spark, sf):
    n = table(spark, sf, "nation")
    r = F.concat(F.lit("R"), "n_regionkey")
    form = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("("), "n_name", F.lit(", part_of, "), r, F.lit(")"))).when(F.col("n_nationkey") % 3 == 1, F.concat("n_name", F.lit(" -> part_of -> "), r)).otherwise(F.concat("n_name", F.lit(", part_of, "), r, F.lit(", x")))
    return n.select("n_nationkey", F.inline(triples.parsed_triples(form)))


@query("f13_json_object", "SELECT event_id, props AS object FROM events")
def json_object(spark, sf):
    e = table(spark, sf, "events")
    form = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```\ndone"))).otherwise(F.concat(F.lit("So it is "), "props", F.lit(", I think.")))
    return e.select("event_id", tx.json_object(form).alias("object"))


@query("f14_cache_key", "SELECT doc_id, md5(left(text, 500)) AS key FROM documents")
def cache_key(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.cache_key("text").alias("key"))


@query("f15_document_type", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'scientific' WHEN o_orderkey % 3 = 1 THEN 'narrative' ELSE 'unknown' END AS type FROM orders")
def document_type(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", tx.document_type(F.when(F.col("o_orderkey") % 3 == 0, " SCIENTIFIC ").when(F.col("o_orderkey") % 3 == 1, "Narrative").otherwise("poem")).alias("type"))


EXAMPLES_SQL = "(VALUES ('technical', ['IS_A', 'PART_OF', 'CAUSES', 'REQUIRES', 'CONTAINS', 'USED_FOR']), ('narrative', ['FATHER_OF', 'LOVES', 'FIGHTS', 'JOURNEYS_TO', 'SAVES', 'BETRAYS']), ('conversational', ['DISCUSSES', 'DECIDES', 'ASSIGNED_TO', 'PROPOSES', 'AGREES_TO']), ('scientific', ['HYPOTHESIZES', 'PROVES', 'CITES', 'FINDS', 'USES_METHOD', 'CORRELATES_WITH']), ('unknown', ['RELATES_TO', 'CONNECTED_TO', 'HAS', 'IS_A']))"


@query("f16_example_predicates", f"SELECT conv_id, turn, type, array_to_string(l, ' ') AS examples FROM (SELECT conv_id, turn, {PICK} AS type FROM (SELECT conv_id, turn, text, {SCORES} FROM conversations)) JOIN {EXAMPLES_SQL} v(kind, l) ON kind = type")
def examples(spark, sf):
    """The example predicates of each turn's type."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", pt.DEFAULT.detect(F.col("text"))["type"].alias("type"))
    known = F.create_map(*[x for k in (*TYPES, "unknown") for x in (F.lit(k), F.lit(" ".join(plugins.relationship_examples(k))))])
    return rows.withColumn("examples", F.element_at(known, F.col("type")))


@query("f18_node_id", "SELECT n_name || '__page' || n_regionkey AS node_id FROM nation")
def node_id(spark, sf):
    return table(spark, sf, "nation").select(tx.node_id("n_name", "n_regionkey").alias("node_id"))


# -- entity names

MENTIONS = "m AS (SELECT c_custkey AS seq, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'The ' || lower(c_mktsegment) ELSE c_mktsegment || ' Street ' || c_nationkey END AS mention FROM customer), x AS (SELECT seq, mention, regexp_replace(lower(mention), '^the ', '') AS norm FROM m), f AS (SELECT norm, min_by(mention, seq) AS form, min(seq) AS first_seq, count(*) AS n FROM x GROUP BY norm)"


def _mentions(spark, sf):
    c = table(spark, sf, "customer")
    kind = F.col("c_custkey") % 3
    name = F.when(kind == 0, F.col("c_mktsegment")).when(kind == 1, F.concat(F.lit("The "), F.lower("c_mktsegment"))).otherwise(F.concat("c_mktsegment", F.lit(" Street "), F.col("c_nationkey").cast("string")))
    return c.select(F.col("c_custkey").cast("long").alias("seq"), name.alias("mention"))


@query("n5_first_forms", f"WITH {MENTIONS} SELECT * FROM f")
def first_forms(spark, sf):
    return resolve.first_forms(_mentions(spark, sf))


@query("j13_prefix_join", f"WITH {MENTIONS} SELECT a.norm, b.norm AS longer FROM f a JOIN f b ON b.norm LIKE a.norm || ' %'")
def prefix_join(spark, sf):
    return resolve.prefix_links(resolve.first_forms(_mentions(spark, sf)))


@query("j14_title_join", "SELECT lower(n_name) AS norm, 'king ' || lower(n_name) AS longer FROM nation")
def title_join(spark, sf):
    n = table(spark, sf, "nation")
    m = n.select(F.col("n_nationkey").cast("long").alias("seq"), F.col("n_name").alias("mention")).unionByName(n.select((F.col("n_nationkey") + 100).cast("long").alias("seq"), F.concat(F.lit("King "), "n_name").alias("mention")))
    return resolve.title_links(resolve.first_forms(m))


@query("j15_fuzzy_join")
def fuzzy_join(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("mention"))
    return resolve.fuzzy_links(resolve.first_forms(p)).withColumn("ratio", F.round("ratio", 6))


BEST = ", seg AS (SELECT *, split_part(norm, ' ', 1) AS g FROM f), best AS (SELECT g, min_by(form, (-len(string_split(norm, ' ')), -length(norm), first_seq)) AS canonical FROM seg GROUP BY g), r AS (SELECT norm, canonical FROM seg JOIN best USING (g))"


@query("n2_resolve_batch", f"WITH {MENTIONS}{BEST} SELECT norm, canonical FROM r")
def resolve_batch(spark, sf):
    return resolve.resolve_batch(_mentions(spark, sf), "light")


@query("a4_entity_frequency", f"WITH {MENTIONS}{BEST} SELECT canonical, sum(n)::BIGINT AS n FROM f JOIN r USING (norm) GROUP BY canonical")
def frequency(spark, sf):
    m = _mentions(spark, sf)
    return resolve.entity_frequency(m, resolve.resolve_batch(m, "light"))


@query("a5_dedup_stats", f"WITH {MENTIONS}{BEST} SELECT (SELECT count(DISTINCT canonical) FROM r) AS canonicals, (SELECT count(*) FROM r) AS aliases, (SELECT count(*) FROM m)::BIGINT AS mentions, (SELECT count(*) FROM r) / (SELECT count(DISTINCT canonical) FROM r) AS ratio")
def dedup_stats(spark, sf):
    m = _mentions(spark, sf)
    r = resolve.resolve_batch(m, "light")
    return resolve.dedup_stats(r, resolve.entity_frequency(m, r))


@query("t2_top_entities", f"WITH {MENTIONS}{BEST} SELECT canonical, sum(n)::BIGINT AS n FROM f JOIN r USING (norm) GROUP BY canonical ORDER BY n DESC, canonical LIMIT 10")
def top_entities(spark, sf):
    m = _mentions(spark, sf)
    return resolve.top_entities(resolve.entity_frequency(m, resolve.resolve_batch(m, "light")))


@query("n1_resolve_sequential")
def resolve_sequential(spark, sf):
    return resolve.resolve_sequential(_mentions(spark, sf), "light")


@query("n3_resolve_standard")
def resolve_standard(spark, sf):
    return resolve.resolve_sequential(table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("mention")), "standard")


@query("n4_resolve_none", "SELECT DISTINCT p_name AS norm, p_name AS canonical FROM part")
def resolve_none(spark, sf):
    return resolve.resolve_batch(table(spark, sf, "part").select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("mention")), "none")


@query("a6_dedup_delta", f"WITH {MENTIONS}{BEST}, o AS (SELECT * FROM x WHERE seq % 2 = 0), ro AS (SELECT DISTINCT norm, split_part(norm, ' ', 1) AS g FROM o) SELECT (SELECT count(DISTINCT canonical) FROM r) - (SELECT count(DISTINCT g) FROM ro) AS canonicals, (SELECT count(*) FROM r) - (SELECT count(*) FROM ro) AS aliases, ((SELECT count(*) FROM m) - (SELECT count(*) FROM o))::BIGINT AS mentions")
def dedup_delta(spark, sf):
    def stats(m):
        r = resolve.resolve_batch(m, "light")
        return resolve.dedup_stats(r, resolve.entity_frequency(m, r))

    m = _mentions(spark, sf)
    return resolve.dedup_delta(stats(m.where("seq % 2 = 0")), stats(m))


@query("o4_word_overlap", "SELECT a.p_partkey, len(list_intersect(string_split(a.p_name, ' '), ['red', 'ring', 'small']))::INT AS shared FROM part a")
def word_overlap(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.size(F.array_intersect(tx.words("p_name"), F.array(F.lit("red"), F.lit("ring"), F.lit("small")))).alias("shared"))


@query("s4_page_passages")
def page_passages(spark, sf):
    pages = _docs(spark, sf).select(F.col("doc_id").alias("page_num"), F.concat(F.lit("page"), "doc_id").alias("page"), "source", F.col("text").alias("content"))
    return files.passages(pages)
