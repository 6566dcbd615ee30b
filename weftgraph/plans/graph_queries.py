"""Registered queries over the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as comp
from ..operators import context, graph
from ..operators import triples as tr
from ..tables import table
from .kg import EDGES_SQL, TRIPLES_SQL, key_edges, key_triples, order_triples
from .registry import query

REACH = "r AS (SELECT 'ASIA' AS entity, 0 AS depth UNION SELECT other, depth + 1 FROM r JOIN u ON r.entity = u.node WHERE depth < {hops}), d AS (SELECT entity, min(depth)::INT AS depth FROM r GROUP BY entity)"
KEPT = "k AS (SELECT entity, depth FROM d ORDER BY depth, entity LIMIT 50), g AS (SELECT e.* FROM e WHERE src IN (SELECT entity FROM k) AND dst IN (SELECT entity FROM k))"


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "wanted string")


def start(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "entity string")


@query(
    "x_flagship_context",
    f"""WITH RECURSIVE {EDGES_SQL}, {REACH.format(hops=2)}, {KEPT}, f AS (SELECT * FROM g ORDER BY first_seq, src, dst LIMIT 20)
SELECT '[Knowledge Graph Context]' || chr(10) || string_agg('  ' || src || ' --[' || relation || ']--> ' || dst, chr(10) ORDER BY first_seq, src, dst) || chr(10)
  || '[' || (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM g UNION SELECT dst FROM g)) || ' entities, ' || (SELECT count(*) FROM g) || ' relationships]' AS context FROM f""",
)
def flagship(spark, sf):
    _, g = graph.subgraph(key_edges(spark, sf), names(spark, "ASIA"))
    return graph.graph_text(g)


@query("g1_upsert", "SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, max_by(l_returnflag, l_orderkey * 10 + l_linenumber) AS relation, max_by(l_linenumber, l_orderkey * 10 + l_linenumber)::INT AS page_num, min(l_orderkey * 10 + l_linenumber) AS first_seq, max(l_orderkey * 10 + l_linenumber) AS last_seq FROM lineitem GROUP BY l_suppkey, l_partkey")
def upsert(spark, sf):
    return graph.upsert(order_triples(spark, sf))


@query("g1_nodes", f"WITH {TRIPLES_SQL} SELECT entity, list_sort(list(DISTINCT page_num)) AS pages FROM (SELECT subject AS entity, page_num FROM t UNION ALL SELECT object, page_num FROM t) GROUP BY entity")
def nodes(spark, sf):
    return graph.nodes(key_triples(spark, sf))


@query("r3_merge_builds", "SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, max_by(l_returnflag, l_orderkey * 10 + l_linenumber) AS relation FROM lineitem GROUP BY l_suppkey, l_partkey")
def merge(spark, sf):
    t = order_triples(spark, sf)
    return graph.merge(graph.upsert(t.where("seq % 2 = 0")), graph.upsert(t.where("seq % 2 = 1"))).select("src", "dst", "relation")


@query("p11_entities", f"WITH {EDGES_SQL} SELECT entity FROM n")
def entities(spark, sf):
    return graph.entities(key_edges(spark, sf))


@query("p12_all_triples", f"WITH {EDGES_SQL} SELECT src, coalesce(relation, 'RELATED_TO') AS relation, dst FROM e")
def all_triples(spark, sf):
    return graph.triples_of(key_edges(spark, sf))


@query("p9_edge_pages", f"WITH {EDGES_SQL} SELECT DISTINCT page_num FROM e WHERE page_num IS NOT NULL AND page_num <> 0")
def edge_pages(spark, sf):
    return graph.pages_of(key_edges(spark, sf))


@query("o1_undirected", f"WITH {EDGES_SQL} SELECT node, other FROM u")
def undirected(spark, sf):
    return graph.undirected(key_edges(spark, sf))


@query("j8_seed_lookup", f"WITH {EDGES_SQL} SELECT * FROM (VALUES ('ASIA', 'ASIA'), ('nation_3', 'NATION_3'), ('Customer#00000000', 'Customer#000000000')) v(wanted, entity)")
def seed_lookup(spark, sf):
    return graph.seeds(graph.entities(key_edges(spark, sf)), names(spark, "ASIA", "nation_3", "Customer#00000000", "no such thing"))


@query("j9_reach", f"WITH RECURSIVE {EDGES_SQL}, {REACH.format(hops=3)} SELECT entity, depth FROM d")
def reach(spark, sf):
    return graph.reach(key_edges(spark, sf), start(spark, "ASIA"), 3)


@query("g2_subgraph_nodes", f"WITH RECURSIVE {EDGES_SQL}, {REACH.format(hops=2)}, {KEPT} SELECT entity, depth FROM k")
def subgraph_nodes(spark, sf):
    return graph.subgraph(key_edges(spark, sf), names(spark, "asia"))[0]


@query("g2_subgraph_edges", f"WITH RECURSIVE {EDGES_SQL}, {REACH.format(hops=2)}, {KEPT} SELECT src, dst, relation FROM g")
def subgraph_edges(spark, sf):
    return graph.subgraph(key_edges(spark, sf), names(spark, "asia"))[1].select("src", "dst", "relation")


@query("j10_induced", f"WITH RECURSIVE {EDGES_SQL}, {REACH.format(hops=1)} SELECT src, dst, relation FROM e WHERE src IN (SELECT entity FROM d) AND dst IN (SELECT entity FROM d)")
def induced(spark, sf):
    e = key_edges(spark, sf)
    return graph.induced(e, graph.reach(e, start(spark, "ASIA"), 1)).select("src", "dst", "relation")


@query("g3_touching_triples", f"WITH RECURSIVE {EDGES_SQL}, {REACH.format(hops=1)} SELECT src, dst, relation FROM e WHERE src IN (SELECT entity FROM d) OR dst IN (SELECT entity FROM d) ORDER BY first_seq, src, dst LIMIT 100")
def touching(spark, sf):
    return graph.touching(key_edges(spark, sf), start(spark, "ASIA"), 1).select("src", "dst", "relation")


PATH_SQL = f"""WITH RECURSIVE {EDGES_SQL}, p AS (SELECT ['Customer#000000001'] AS path UNION ALL SELECT list_append(path, dst) FROM p JOIN e ON path[-1] = src WHERE len(path) < 5 AND NOT list_contains(path, dst)),
best AS (SELECT path FROM p WHERE path[-1] = (SELECT r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey = 1) ORDER BY len(path), path LIMIT 1)"""


def _path(spark, sf):
    t = lambda n: table(spark, sf, n)
    home = t("customer").where("c_custkey = 1").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).first()
    return graph.shortest_path(key_edges(spark, sf), "Customer#000000001", home["r_name"])


@query("g4_shortest_path", f"{PATH_SQL} SELECT path FROM best")
def shortest_path(spark, sf):
    return _path(spark, sf)


@query("g5_path_edges", f"{PATH_SQL}, s AS (SELECT unnest(range(1, len(path))) AS i, path FROM best) SELECT (i - 1)::INT AS step, src, relation, dst, (len(path) - 1)::INT AS length FROM s JOIN e ON src = path[i] AND dst = path[i + 1]")
def path_edges(spark, sf):
    return graph.path_edges(key_edges(spark, sf), _path(spark, sf))


@query(
    "g6_neighbour_lists",
    f"""WITH {EDGES_SQL}, a AS (SELECT src AS entity, 'o' AS d, relation || ' -> ' || dst AS l, row_number() OVER (PARTITION BY src ORDER BY first_seq, dst) AS r FROM e
UNION ALL SELECT dst, 'i', src || ' -> ' || relation, row_number() OVER (PARTITION BY dst ORDER BY first_seq, src) FROM e)
SELECT entity, coalesce(list(l ORDER BY r) FILTER (WHERE d = 'o'), []) AS outgoing, coalesce(list(l ORDER BY r) FILTER (WHERE d = 'i'), []) AS incoming FROM a WHERE r <= 10 GROUP BY entity""",
)
def neighbour_lists(spark, sf):
    return graph.neighbour_lists(key_edges(spark, sf))


@query(
    "g7_compare",
    f"""WITH {EDGES_SQL}, a AS (SELECT other FROM u WHERE node = 'NATION_1'), b AS (SELECT other FROM u WHERE node = 'NATION_2'),
c AS (SELECT coalesce(list_sort(list(other)), []) AS l FROM (SELECT * FROM a INTERSECT SELECT * FROM b)), x AS (SELECT coalesce(list_sort(list(other)), []) AS l FROM (SELECT * FROM a EXCEPT SELECT * FROM b)), y AS (SELECT coalesce(list_sort(list(other)), []) AS l FROM (SELECT * FROM b EXCEPT SELECT * FROM a))
SELECT 'NATION_1' AS entity1, 'NATION_2' AS entity2, c.l AS common, x.l AS only1, y.l AS only2, len(c.l)::INT AS n_common, (len(c.l) + len(x.l))::INT AS n1, (len(c.l) + len(y.l))::INT AS n2 FROM c, x, y""",
)
def compare(spark, sf):
    return graph.compare(key_edges(spark, sf), "NATION_1", "NATION_2")


DEGREE = ", g AS (SELECT entity, count(*) AS degree FROM (SELECT src AS entity FROM e UNION ALL SELECT dst FROM e) GROUP BY entity), m AS (SELECT count(*) AS n FROM g), c AS (SELECT entity, degree, degree / (n - 1) AS centrality, floor(degree / (n - 1) * n)::BIGINT AS shown FROM g, m)"


@query("a14_centrality", f"WITH {EDGES_SQL}{DEGREE} SELECT * FROM c")
def centrality(spark, sf):
    return graph.centrality(key_edges(spark, sf))


@query("t3_top_central", f"WITH {EDGES_SQL}{DEGREE} SELECT * FROM c ORDER BY degree DESC, entity LIMIT 10")
def top_central(spark, sf):
    return graph.most_central(key_edges(spark, sf), 10)


@query("a15_central_subgraph", f"WITH {EDGES_SQL}{DEGREE}, k AS (SELECT entity FROM c ORDER BY degree DESC, entity LIMIT 100) SELECT src, dst, relation FROM e WHERE src IN (FROM k) AND dst IN (FROM k)")
def central_subgraph(spark, sf):
    return graph.central_subgraph(key_edges(spark, sf))[1].select("src", "dst", "relation")


@query("a15_central_nodes", f"WITH {EDGES_SQL}{DEGREE} SELECT entity, degree, centrality * 50 + 10 AS size FROM c ORDER BY degree DESC, entity LIMIT 100")
def central_nodes(spark, sf):
    return graph.central_subgraph(key_edges(spark, sf))[0].select("entity", "degree", "size")


@query("a16_dashboard", f"WITH {EDGES_SQL}{DEGREE} SELECT (SELECT n FROM m) AS nodes, count(*) AS edges, count(*) / (SELECT n FROM m) AS edges_per_node, CASE WHEN (SELECT n FROM m) < 50 THEN 'small' WHEN (SELECT n FROM m) < 150 THEN 'medium' WHEN (SELECT n FROM m) < 300 THEN 'large' ELSE 'massive' END AS strategy FROM e")
def dashboard(spark, sf):
    return graph.stats(key_edges(spark, sf))


#: The least name reaches all of a component in as many rounds as its diameter has links: four in this graph.
ROUNDS = 5
COMP = "l0 AS (SELECT entity, entity AS component FROM n), " + ", ".join(
    f"l{i} AS (SELECT a.entity, least(any_value(a.component), min(b.component)) AS component FROM l{i - 1} a JOIN u ON u.node = a.entity JOIN l{i - 1} b ON b.entity = u.other GROUP BY a.entity)" for i in range(1, ROUNDS + 1)
)
STRATEGY = "CASE WHEN (SELECT count(*) FROM n) < 50 THEN 'small' WHEN (SELECT count(*) FROM n) < 150 THEN 'medium' WHEN (SELECT count(*) FROM n) < 300 THEN 'large' ELSE 'massive' END"


@query("g9_components", f"WITH {EDGES_SQL}, {COMP} SELECT * FROM l{ROUNDS}")
def weak_components(spark, sf):
    return comp.components(key_edges(spark, sf))


@query("a13_graph_stats", f"WITH {EDGES_SQL}, {COMP} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM e) / (SELECT count(*) FROM n) AS edges_per_node, {STRATEGY} AS strategy, (SELECT count(DISTINCT component) = 1 FROM l{ROUNDS}) AS is_connected")
def graph_stats(spark, sf):
    e = key_edges(spark, sf)
    return graph.stats(e, comp.components(e))


@query("g8_communities")
def communities(spark, sf):
    return comp.communities(key_edges(spark, sf))


@query("w10_ranked_communities")
def ranked_communities(spark, sf):
    return comp.ranked_communities(comp.communities(key_edges(spark, sf)))


@query("j20_node_communities")
def node_communities(spark, sf):
    e = key_edges(spark, sf)
    found = comp.communities(e)
    return comp.with_community(graph.most_central(e, 100), found)


PAGES = "pg AS (SELECT entity, list_sort(list(DISTINCT page_num)) AS pages FROM (SELECT src AS entity, coalesce(page_num, 1) AS page_num FROM e UNION ALL SELECT dst, coalesce(page_num, 1) FROM e) GROUP BY entity)"


@query("a10_entity_pages", f"WITH {EDGES_SQL}, {PAGES} SELECT * FROM pg")
def entity_pages(spark, sf):
    return graph.entity_pages(key_edges(spark, sf), 1)


@query("a11_common_entities", f"WITH {EDGES_SQL}, {PAGES} SELECT * FROM pg WHERE len(pages) >= 2")
def common_entities(spark, sf):
    return graph.common_entities(key_edges(spark, sf))


@query("g10_layered_nodes", f"WITH {EDGES_SQL}, {PAGES}, p AS (SELECT entity, unnest(pages) AS page_num, len(pages) >= 2 AS is_common FROM pg) SELECT entity || '__page' || page_num AS node_id, entity, page_num, 0.5::DOUBLE AS x, 0.5::DOUBLE AS y, (page_num - 1)::DOUBLE AS z, is_common FROM p")
def layered_nodes(spark, sf):
    return comp.layered_nodes(key_edges(spark, sf))


@query(
    "g10_layered_edges",
    f"""WITH {EDGES_SQL}, {PAGES}, p AS (SELECT entity, unnest(pages) AS page_num FROM pg WHERE len(pages) >= 2), l AS (SELECT entity, page_num, lead(page_num) OVER (PARTITION BY entity ORDER BY page_num) AS nx FROM p)
SELECT src || '__page' || page_num AS source_id, dst || '__page' || page_num AS target_id, relation, false AS is_identity, page_num FROM e
UNION ALL SELECT entity || '__page' || page_num, entity || '__page' || nx, 'SAME_ENTITY', true, NULL FROM l WHERE nx IS NOT NULL""",
)
def layered_edges(spark, sf):
    return comp.layered_edges(key_edges(spark, sf))


@query("g11_page_layout")
def page_layout(spark, sf):
    return comp.scaled(comp.page_layout(key_edges(spark, sf)))


@query("w6_min_max_scaling", "SELECT page_num, entity, (x - min(x) OVER w) / (CASE WHEN max(x) OVER w = min(x) OVER w THEN 1 ELSE max(x) OVER w - min(x) OVER w END) AS x, (y - min(y) OVER w) / (CASE WHEN max(y) OVER w = min(y) OVER w THEN 1 ELSE max(y) OVER w - min(y) OVER w END) AS y FROM (SELECT s_nationkey AS page_num, s_name AS entity, s_acctbal AS x, s_suppkey::DOUBLE AS y FROM supplier) WINDOW w AS (PARTITION BY page_num)")
def min_max(spark, sf):
    return comp.scaled(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("page_num"), F.col("s_name").alias("entity"), F.col("s_acctbal").alias("raw_x"), F.col("s_suppkey").cast("double").alias("raw_y")))


@query("a12_edges_by_page", f"WITH {EDGES_SQL} SELECT page_num, count(*) AS n, string_agg(src || '|' || relation || '|' || dst, ';' ORDER BY first_seq, src, dst) AS listed FROM e GROUP BY page_num")
def edges_by_page(spark, sf):
    p = context.edges_by_page(key_edges(spark, sf))
    return p.select("page_num", F.size("kg_edges").cast("long").alias("n"), F.array_join(F.transform("kg_edges", lambda x: F.concat_ws("|", x["u"], x["relation"], x["v"])), ";").alias("listed"))


@query("f9_triple_context", f"WITH {EDGES_SQL} SELECT string_agg('- ' || src || ' ' || lower(replace(relation, '_', ' ')) || ' ' || dst, chr(10) ORDER BY first_seq, src, dst) AS context FROM (SELECT * FROM e ORDER BY first_seq, src, dst LIMIT 50)")
def triple_context(spark, sf):
    return context.triple_context(key_edges(spark, sf).orderBy("first_seq", "src", "dst").limit(50))


@query("f12_entity_report", f"WITH {EDGES_SQL}, o AS (SELECT relation || ' -> ' || dst AS l, row_number() OVER (ORDER BY first_seq, dst) AS r FROM e WHERE src = 'NATION_1'), i AS (SELECT src || ' -> ' || relation AS l, row_number() OVER (ORDER BY first_seq, src) AS r FROM e WHERE dst = 'NATION_1') SELECT 'NATION_1' AS entity, 'Entity: NATION_1' || chr(10) || 'Outgoing:' || chr(10) || (SELECT string_agg('  ' || l, chr(10) ORDER BY r) FROM o WHERE r <= 10) || chr(10) || 'Incoming:' || chr(10) || (SELECT string_agg('  ' || l, chr(10) ORDER BY r) FROM i WHERE r <= 10) AS report")
def entity_report(spark, sf):
    e = key_edges(spark, sf)
    return context.entity_report("NATION_1", graph.neighbour_lists(e), e)


@query(
    "x7_with_inverses",
    f"WITH {TRIPLES_SQL} SELECT 2 * seq AS seq, subject, predicate, object, false AS is_inverse, page_num FROM t UNION ALL SELECT 2 * seq + 1, object, CASE predicate WHEN 'LIVES_IN' THEN 'HOME_OF' ELSE 'INVERSE_' || predicate END, subject, true, page_num FROM t",
)
def with_inverses(spark, sf):
    return tr.with_inverses(key_triples(spark, sf), "narrative")


@query("j2_resolve_inverses", f"WITH {TRIPLES_SQL} SELECT * FROM (SELECT DISTINCT predicate, CASE predicate WHEN 'PART_OF' THEN 'CONTAINS' ELSE 'INVERSE_' || predicate END AS inverse, CASE predicate WHEN 'PART_OF' THEN 'static' ELSE 'fallback' END AS source FROM t)")
def resolve_inverses(spark, sf):
    return tr.resolve_inverses(spark, key_triples(spark, sf), "technical")


@query(
    "j1_inverse_of",
    """WITH p AS (SELECT o_orderkey, list_value('CITES', 'cites', 'HAS', 'CAUSES', 'FATHER_OF', 'is near', o_orderpriority)[(o_orderkey % 7 + 1)::INT] AS predicate FROM orders)
SELECT predicate, CASE upper(predicate) WHEN 'CITES' THEN 'CITED_BY' WHEN 'HAS' THEN 'BELONGS_TO' WHEN 'CAUSES' THEN 'CAUSED_BY' ELSE 'INVERSE_OF_' || predicate END AS inverse, count(*) AS n FROM p GROUP BY 1, 2""",
)
def inverse_of(spark, sf):
    """Predicates of the type in either case, of every type, of another type, and unknown ones."""
    some = F.array(*[F.lit(x) for x in ("CITES", "cites", "HAS", "CAUSES", "FATHER_OF", "is near")], F.col("o_orderpriority"))
    p = table(spark, sf, "orders").select(F.element_at(some, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("predicate"))
    return p.select("predicate", tr.inverse_of(F.col("predicate"), "scientific", "INVERSE_OF_").alias("inverse")).groupBy("predicate", "inverse").agg(F.count(F.lit(1)).alias("n"))


@query("a1_insertions_and_edges", "SELECT count(*) AS insertions, count(DISTINCT (l_suppkey, l_partkey)) AS edges, count(DISTINCT l_suppkey) + count(DISTINCT l_partkey) AS entities FROM lineitem")
def insertions(spark, sf):
    t = order_triples(spark, sf)
    pairs = t.groupBy("subject", "object").agg(F.count(F.lit(1)).alias("k"))
    ends = t.select(F.explode(F.array("subject", "object")).alias("x")).distinct().agg(F.count(F.lit(1)).alias("entities"))
    return pairs.agg(F.sum("k").alias("insertions"), F.count(F.lit(1)).alias("edges")).join(F.broadcast(ends))


@query("a2_page_stats", "SELECT l_linenumber::INT AS page_num, count(*) AS triples, count(DISTINCT l_suppkey) AS subjects FROM lineitem GROUP BY l_linenumber")
def page_stats(spark, sf):
    return order_triples(spark, sf).groupBy("page_num").agg(F.count(F.lit(1)).alias("triples"), F.countDistinct("subject").alias("subjects"))


@query("w5_same_entity_chain", f"WITH {EDGES_SQL}, {PAGES}, p AS (SELECT entity, unnest(pages) AS page_num FROM pg WHERE len(pages) >= 2), l AS (SELECT entity, page_num, lead(page_num) OVER (PARTITION BY entity ORDER BY page_num) AS nx FROM p) SELECT entity || '__page' || page_num AS source_id, entity || '__page' || nx AS target_id FROM l WHERE nx IS NOT NULL")
def same_entity(spark, sf):
    return comp.layered_edges(key_edges(spark, sf)).where("is_identity").select("source_id", "target_id")


@query("a17_strategy", "SELECT o_orderkey, CASE WHEN o_orderkey % 400 < 50 THEN 'small' WHEN o_orderkey % 400 < 150 THEN 'medium' WHEN o_orderkey % 400 < 300 THEN 'large' ELSE 'massive' END AS strategy FROM orders")
def strategies(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", graph.strategy(F.col("o_orderkey") % 400).alias("strategy"))


@query("t8_first_neighbours", f"WITH {EDGES_SQL}, a AS (SELECT src AS entity, 'out' AS direction, relation, dst AS other, row_number() OVER (PARTITION BY src ORDER BY first_seq, dst) AS r FROM e UNION ALL SELECT dst, 'in', relation, src, row_number() OVER (PARTITION BY dst ORDER BY first_seq, src) FROM e) SELECT entity, direction, relation, other FROM a")
def first_neighbours(spark, sf):
    return graph.neighbours(key_edges(spark, sf)).drop("first_seq")
