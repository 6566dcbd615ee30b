"""The labelled graph as two tables: edges by (src, dst), nodes by entity; neighbourhoods, paths and sets over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .settle import settle
from .substrings import inside

RELATED = "RELATED_TO"
EXTRAS = ("page_num", "source_page", "subject_original", "object_original")


def upsert(triples: DataFrame) -> DataFrame:
    """Triples (seq, subject, predicate, object, extras ...) -> edges: the last predicate of an ordered pair wins.

    Extras keep their last value that is not null. One aggregation, partly done before its shuffle.
    """
    extras = [c for c in EXTRAS if c in triples.columns]
    kept = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in extras]
    return triples.groupBy(F.col("subject").alias("src"), F.col("object").alias("dst")).agg(F.max_by("predicate", "seq").alias("relation"), *kept, F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def merge(edges: DataFrame, newer: DataFrame) -> DataFrame:
    """Edges of an earlier build with those of a later one, whose ``seq`` run on from the earlier."""
    both = edges.unionByName(newer, allowMissingColumns=True)
    extras = [c for c in EXTRAS if c in both.columns]
    kept = [F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("last_seq"))).alias(c) for c in extras]
    return both.groupBy("src", "dst").agg(F.max_by("relation", "last_seq").alias("relation"), *kept, F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


def nodes(triples: DataFrame) -> DataFrame:
    """(entity, pages): every end of a triple with the sorted distinct pages it is on."""
    ends = triples.select(F.explode(F.array("subject", "object")).alias("entity"), "page_num")
    return ends.groupBy("entity").agg(F.array_sort(F.collect_set("page_num")).alias("pages"))


def entities(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("entity")).distinct()


def triples_of(edges: DataFrame) -> DataFrame:
    return edges.select("src", F.coalesce("relation", F.lit(RELATED)).alias("relation"), "dst")


def undirected(edges: DataFrame) -> DataFrame:
    """(node, other) in both directions, once each."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()


def seeds(entity_table: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted) -> (wanted, entity): equal, else equal without case, else the shortest that contains or is contained.

    Two equi-joins settle nearly all; what neither finds is looked for inside the entities, and they in it, by equality
    of substrings.
    """
    e = entity_table.select("entity")
    exact = wanted.join(e, F.col("wanted") == F.col("entity")).select("wanted", "entity", F.lit(0).alias("tier"))
    rest = wanted.join(exact, "wanted", "left_anti")
    caseless = rest.join(e, F.lower("wanted") == F.lower("entity")).select("wanted", "entity", F.lit(1).alias("tier"))
    rest = rest.join(caseless, "wanted", "left_anti")
    low, want = e.withColumn("low", F.lower("entity")), rest.select("wanted", F.lower("wanted").alias("want"))
    partial = inside(low, "low", want, "want").select("wanted", "entity").unionByName(inside(want, "want", low, "low").select("wanted", "entity"))
    partial = partial.withColumn("tier", F.lit(2))
    best = F.min(F.struct("tier", F.length("entity").alias("n"), "entity")).alias("b")
    return exact.unionByName(caseless).unionByName(partial).groupBy("wanted").agg(best).select("wanted", F.col("b.entity").alias("entity"))


def reach(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(entity, depth) of all within ``hops`` of the start entities, edges taken both ways; a breadth-first search by joins."""
    around = undirected(edges)
    seen = settle(start.select("entity").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for d in range(1, hops + 1):
        nxt = frontier.join(around, frontier["entity"] == around["node"]).select(F.col("other").alias("entity")).distinct()
        # each level is used twice, so that without a cut the plan would double with every hop
        frontier = settle(nxt.join(seen, "entity", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def capped(reached: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest entities; seeds first, then by depth and name."""
    return reached.orderBy("depth", "entity").limit(most)


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends kept."""
    k = kept.select("entity")
    return edges.join(k.withColumnRenamed("entity", "src"), "src", "left_semi").join(k.withColumnRenamed("entity", "dst"), "dst", "left_semi")


def subgraph(edges: DataFrame, wanted: DataFrame, hops: int = 2, max_nodes: int = 50) -> tuple[DataFrame, DataFrame]:
    """(entities with depth, induced edges) around the wanted names."""
    found = seeds(entities(edges), wanted).select("entity")
    kept = settle(capped(reach(edges, found, hops), max_nodes))
    return kept, settle(induced(edges, kept))


def touching(edges: DataFrame, start: DataFrame, hops: int = 2, max_triples: int = 100) -> DataFrame:
    """The first triples with at least one end within reach of exact start entities, in order of insertion."""
    seen = reach(edges, start, hops).select("entity")
    a = edges.join(seen.withColumnRenamed("entity", "src"), "src", "left_semi")
    b = edges.join(seen.withColumnRenamed("entity", "dst"), "dst", "left_semi")
    return a.unionByName(b.select(a.columns)).distinct().orderBy("first_seq", "src", "dst").limit(max_triples)


def shortest_path(edges: DataFrame, source: str, target: str, max_nodes: int = 5) -> DataFrame:
    """One row (path): the shortest directed path of at most ``max_nodes`` entities, least by name; none if there is none.

    Level by level; each entity keeps the least of its shortest paths, so a level never holds more than one row each.
    """
    hop = edges.select("src", "dst").distinct()
    level = hop.sparkSession.createDataFrame([(source, [source])], "node string, path array<string>")
    seen = level
    for _ in range(max_nodes - 1):
        grown = level.join(hop, level["node"] == hop["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        level = grown.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("path").alias("path"))
        level = settle(level)
        seen = seen.unionByName(level)
    there = entities(edges).where(F.col("entity") == source)
    found = seen.where(F.col("node") == target).select("path")
    return found.join(there, F.element_at("path", 1) == F.col("entity"), "left_semi")


def path_edges(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """(step, src, relation, dst, length) of the edges along each path."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.element_at("path", i).alias("src"), F.element_at("path", i + 1).alias("dst")))
    steps = paths.where(F.size("path") > 1).select((F.size("path") - 1).alias("length"), F.posexplode(pairs).alias("step", "z")).select("length", "step", "z.src", "z.dst")
    return steps.join(edges.select("src", "dst", "relation"), ["src", "dst"]).select("step", "src", F.coalesce("relation", F.lit(RELATED)).alias("relation"), "dst", "length")


def neighbours(edges: DataFrame) -> DataFrame:
    """(entity, direction, relation, other, first_seq) for every entity."""
    r = F.coalesce("relation", F.lit(RELATED)).alias("relation")
    out = edges.select(F.col("src").alias("entity"), F.lit("out").alias("direction"), r, F.col("dst").alias("other"), "first_seq")
    return out.unionByName(edges.select(F.col("dst").alias("entity"), F.lit("in").alias("direction"), r, F.col("src").alias("other"), "first_seq"))


def neighbour_lists(edges: DataFrame, most: int = 10) -> DataFrame:
    """(entity, outgoing, incoming): the first ``most`` of each as text, in order of insertion."""
    n = neighbours(edges)
    w = W.partitionBy("entity", "direction").orderBy("first_seq", "other")
    n = n.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    line = F.when(F.col("direction") == "out", F.concat("relation", F.lit(" -> "), "other")).otherwise(F.concat("other", F.lit(" -> "), "relation"))
    listed = lambda d: F.transform(F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct("r", line.alias("line"))))), lambda x: x["line"])
    return n.groupBy("entity").agg(listed("out").alias("outgoing"), listed("in").alias("incoming"))


def compare(edges: DataFrame, one: str, two: str) -> DataFrame:
    """One row: neighbours that two entities share and that each has alone, with counts, and whether an edge joins them."""
    around = undirected(edges).where(F.col("node").isin(one, two))
    own = lambda e: F.coalesce(F.array_sort(F.collect_set(F.when(F.col("node") == e, F.col("other")))), F.array().cast("array<string>"))
    sets = around.agg(own(one).alias("a"), own(two).alias("b"))
    both = F.array_sort(F.array_intersect("a", "b"))
    return sets.select(
        F.lit(one).alias("entity1"), F.lit(two).alias("entity2"), both.alias("common"), F.array_sort(F.array_except("a", "b")).alias("only1"), F.array_sort(F.array_except("b", "a")).alias("only2"),
        F.size(both).alias("n_common"), F.size("a").alias("n1"), F.size("b").alias("n2"),
    )


def degrees(edges: DataFrame) -> DataFrame:
    """(entity, degree): ends of edges, a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("degree"))


def centrality(edges: DataFrame) -> DataFrame:
    """(entity, degree, centrality, shown): degree over the other nodes, and the whole number that a dashboard shows."""
    d = degrees(edges)
    n = d.agg(F.count(F.lit(1)).alias("n"))
    c = F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(F.lit(1.0))
    return d.join(F.broadcast(n)).select("entity", "degree", c.alias("centrality"), F.floor(c * F.col("n")).cast("long").alias("shown"))


def most_central(edges: DataFrame, k: int) -> DataFrame:
    return centrality(edges).orderBy(F.desc("degree"), "entity").limit(k)


def central_subgraph(edges: DataFrame, k: int = 100) -> tuple[DataFrame, DataFrame]:
    """The ``k`` most central entities with the size to draw them, and the edges among them."""
    top = most_central(edges, k).withColumn("size", F.col("centrality") * 50 + 10)
    return top, induced(edges, top)


def strategy(n: Column) -> Column:
    """How to show a graph of ``n`` nodes."""
    return F.when(n < 50, "small").when(n < 150, "medium").when(n < 300, "large").otherwise("massive")


def stats(edges: DataFrame, connected: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, edges a node, strategy and, from a component table, whether the graph is weakly connected."""
    n = degrees(edges).agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    out = n.join(F.broadcast(e)).select("nodes", "edges", F.when(F.col("nodes") > 0, F.col("edges") / F.col("nodes")).otherwise(0.0).alias("edges_per_node"), strategy(F.col("nodes")).alias("strategy"))
    if connected is None:
        return out
    c = connected.agg((F.countDistinct("component") == 1).alias("is_connected"))
    return out.join(F.broadcast(c))


def entity_pages(triples: DataFrame, missing: int | None = None) -> DataFrame:
    """(entity, pages) from the edges; a missing page counts as ``missing`` if given."""
    page = F.coalesce("page_num", F.lit(missing)) if missing is not None else F.col("page_num")
    ends = triples.select(F.explode(F.array("src", "dst")).alias("entity"), page.alias("page_num"))
    return ends.groupBy("entity").agg(F.array_sort(F.collect_set("page_num")).alias("pages"))


def pages_of(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("page_num").isNotNull() & (F.col("page_num") != 0)).select("page_num").distinct()


def common_entities(edges: DataFrame, least: int = 2) -> DataFrame:
    """Entities on ``least`` pages or more."""
    return entity_pages(edges, 1).where(F.size("pages") >= least)


def graph_text(edges: DataFrame, most: int = 20, header: str = "[Knowledge Graph Context]") -> DataFrame:
    """One row (context): a header, the first edges as lines, and the full counts; empty for no edges."""
    first = edges.orderBy("first_seq", "src", "dst").limit(most)
    line = F.concat(F.lit("  "), F.col("src"), F.lit(" --["), F.coalesce("relation", F.lit(RELATED)), F.lit("]--> "), F.col("dst"))
    lines = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "src", "dst", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    counts = entities(edges).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("m"))))
    foot = F.concat(F.lit("["), F.col("n").cast("string"), F.lit(" entities, "), F.col("m").cast("string"), F.lit(" relationships]"))
    text = F.when(F.size("lines") == 0, "").otherwise(F.concat(F.lit(header + "\n"), F.array_join("lines", "\n"), F.lit("\n"), foot))
    return lines.join(F.broadcast(counts)).select(text.alias("context"))
