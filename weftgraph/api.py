"""Building and asking a collection; the command line is a thin layer over it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plugins
from .functions.text import sanitize_path
from .operators import components, context, graph, resolve, retrieve, triples
from .operators.settle import settle
from .sources import files
from .sources.store import Store

CONTEXT_LIMIT = 128_000
#: Tokens that the graph's text is given.
GRAPH_TOKENS = 1_000


def hybrid_query(spark: SparkSession, question: str, edges: DataFrame, passages: DataFrame, vector: list[float] | None, hops: int = 2, max_nodes: int = 50, thresholds: tuple[float, ...] = retrieve.THRESHOLDS, limit: int = CONTEXT_LIMIT, make_model: Callable | None = None) -> DataFrame:
    """One row: response, query entities, counts of passages and of the subgraph, context and provenance."""
    questions = spark.createDataFrame([(0, question)], "qid int, question string")
    more = plugins.model_entities(make_model) if make_model else None
    found = settle(retrieve.question_entities(questions, graph.entities(edges), more=more))
    kept, sub = graph.subgraph(edges, found.select(F.col("entity").alias("wanted")), hops, max_nodes)
    budget = max(limit - len(question) // 4 - 5_000, 10_000) - GRAPH_TOKENS
    if vector is None:
        hits = passages.withColumn("score", F.lit(0.0)).withColumn("threshold", F.lit(0.0)).limit(0)
    else:
        hits = retrieve.adaptive(passages, vector, thresholds)
    hits = settle(hits.drop("embedding"))
    unique = settle(retrieve.distinct_passages(hits))
    used = settle(retrieve.within_budget(unique, budget, [F.desc("score"), "page_num", "chunk_num"]).withColumn("rank", F.col("used")))
    text = context.context(used, graph.graph_text(sub))
    prov = context.provenance(used, sub)
    counts = [
        hits.agg(F.count(F.lit(1)).alias("rag_candidates")),
        unique.agg(F.count(F.lit(1)).alias("rag_unique")),
        used.agg(F.count(F.lit(1)).alias("rag_chunks"), F.coalesce(F.max("used"), F.lit(0)).alias("rag_tokens_used")),
        kept.agg(F.count(F.lit(1)).alias("subgraph_nodes")),
        sub.agg(F.count(F.lit(1)).alias("subgraph_edges")),
        found.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity"))), lambda x: x["entity"]).alias("query_entities")),
        prov.agg(F.map_from_entries(F.collect_list(F.struct("page_num", F.struct("source", "kg_edges")))).alias("page_provenance")),
        context.excerpts(used).agg(F.collect_list(F.struct("page", "page_num", "chunk_num", "excerpt", "source", "full_length")).alias("source_excerpts")),
    ]
    row = text
    for c in counts:  # one row each
        row = row.join(F.broadcast(c))
    row = row.withColumns({"question": F.lit(question), "rag_duplicates": F.col("rag_candidates") - F.col("rag_unique"), "context_budget": F.lit(budget)})
    return plugins.answers(row, make_model)


@dataclass
class Index:
    """A collection on disk: build it from text files, then ask it."""

    spark: SparkSession
    collection: str
    root: str = "kg_store"
    dedup: str = "light"
    validity: str = "verbose"
    chunk_size: int = 500
    overlap: int = 50
    batch: int = 4
    embed: Callable[[DataFrame], DataFrame] | None = None
    make_model: Callable | None = None
    store: Store = field(init=False)

    def __post_init__(self):
        if self.dedup not in ("none", "light", "standard"):
            raise ValueError(f"unknown dedup mode {self.dedup!r}")
        self.store = Store(self.spark, self.root, self.collection)

    def build(self, source: str, glob: str = "*.txt", mode: str = "append", doc_type: str | None = None, add_inverse: bool = True, validate: bool = True) -> DataFrame:
        """Index the files below ``source``; ``mode``: ``overwrite`` starts anew. Returns the build's statistics.

        ``doc_type``: the type of all texts; by default each batch of chunks has its own, by the model if there is one,
        else by patterns.
        """
        if mode == "overwrite":
            self.store.remove()
        self.store.write("pages", files.read_pages(self.spark, source, glob, self.collection))
        pages = self.store.read("pages")
        chunks = files.passages(pages)
        self.store.write("chunks", self.embed(chunks) if self.embed else chunks.withColumn("embedding", F.lit(None).cast("array<float>")))
        model = plugins.model_triples(self.make_model, doc_type, self.validity == "verbose") if self.make_model else None
        classifier = (lambda b: plugins.classify(b, self.make_model).drop("confidence", "level", "reasoning", "error")) if self.make_model else None
        batches = triples.typed(files.page_batches(pages, self.chunk_size, self.overlap, self.batch), doc_type, classifier)
        found = triples.extract(batches, model)
        found = triples.valid(found, self.validity) if validate else found
        found = triples.with_inverses(found, F.col("doc_type")) if add_inverse else found.withColumn("is_inverse", F.lit(False))
        self.store.write("triples", found.withColumnRenamed("page", "source_page"))
        rows = self.store.read("triples")
        mentions = rows.select((F.col("seq") * 2).alias("seq"), F.col("subject").alias("mention")).unionByName(rows.select((F.col("seq") * 2 + 1).alias("seq"), F.col("object").alias("mention")))
        if self.dedup == "none":
            named = rows.withColumns({"subject_original": F.col("subject"), "object_original": F.col("object")})
            freq = mentions.groupBy(F.col("mention").alias("canonical")).agg(F.count(F.lit(1)).alias("n"))
            resolved = resolve.resolve_batch(mentions, "none")
        else:
            resolved = resolve.resolve_batch(mentions, self.dedup)
            named = resolve.named(rows, resolved)
            freq = resolve.entity_frequency(mentions, resolved)
        self.store.write("resolver_map", resolved.withColumn("kind", F.lit("canonical_map")))
        self.store.write("entity_freq", freq)
        self.store.write("edges", graph.upsert(named))
        self.store.write("nodes", graph.nodes(named))
        return self.stats()

    def stats(self) -> DataFrame:
        """One row: pages, chunks, insertions, edges, nodes and deduplication."""
        s = self.store
        one = lambda name, alias: s.read(name).agg(F.count(F.lit(1)).alias(alias))
        row = one("pages", "pages")
        for name, alias in (("chunks", "chunks"), ("triples", "insertions"), ("edges", "edges"), ("nodes", "nodes")):
            row = row.join(F.broadcast(one(name, alias)))
        return row.join(F.broadcast(resolve.dedup_stats(s.read("resolver_map"), s.read("entity_freq"))))

    def query(self, question: str, vector: list[float] | None = None, **options) -> DataFrame:
        passages = self.store.read("chunks")
        return hybrid_query(self.spark, question, self.store.read("edges"), passages, vector, make_model=self.make_model, **options)

    def page(self, path: str, title: str = "Graph", most: int = 200) -> None:
        """Writes an HTML page of the ``most`` most central nodes in their layers, with the links between them."""
        from .sources.page import write_page

        write_page(self.spark, self.store.read("edges"), path, title, most)

    def type_counts(self) -> DataFrame:
        """(doc_type, n): batches with triples by type."""
        return self.store.read("triples").select("doc_type", "page_num", "batch_idx").distinct().groupBy("doc_type").agg(F.count(F.lit(1)).alias("n"))

    def layered(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of the page-layered projection, laid out page by page."""
        e = self.store.read("edges")
        return components.layered_nodes(e, components.page_layout(e)), components.layered_edges(e)

    def dashboard(self) -> DataFrame:
        e = self.store.read("edges")
        return graph.stats(e, components.components(e))


def collection_name(spark: SparkSession, path: str) -> str:
    """A collection's name from its path."""
    return spark.range(1).select(sanitize_path(F.lit(path)).alias("n")).first()["n"]
