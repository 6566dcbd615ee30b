"""Incremental builds: files as they arrive become pages, triples and edges; mentions become canonical names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, resolve, triples
from ..sources.files import joined, page_batches
from ..sources.store import Store


def page_stream(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """A stream of whole files (source, content)."""
    return spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).load(path).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content"))


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of lines (source, value)."""
    return spark.readStream.format("text").load(path).select(F.col("_metadata.file_path").alias("source"), "value")


def upsert_pages(store: Store, doc_type: str | None = None, add_inverse: bool = True, dedup: str = "light", progress: Callable[[int], None] | None = None):
    """A ``foreachBatch`` function that merges a batch of pages into the collection's edges, with entities resolved.

    State goes from batch to batch in two tables: the edges under the names as they came, and the first spelling of each
    normal form. A batch writes new versions beside the old; running it again writes the same versions. The edges under
    canonical names follow from both, so that a longer spelling renames what earlier batches brought.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        pages = batch.select("source", "content", F.element_at(F.split("source", "/"), -1).alias("page"))
        pages = pages.withColumn("page_num", F.greatest(F.lit(1), F.coalesce(F.try_to_number(F.regexp_extract("page", r"(\d+)", 1), F.lit("999999999")).cast("int"), F.lit(1))))
        found = triples.extract(triples.typed(page_batches(pages), doc_type))
        found = triples.with_inverses(found, F.col("doc_type")) if add_inverse else found
        found = found.withColumn("seq", F.col("seq") + F.lit(batch_id) * F.lit(1 << 52)).withColumnRenamed("page", "source_page")

        def carried(name: str, new: DataFrame, merge) -> DataFrame:
            own, old = f"{name}/v{batch_id}", f"{name}/v{batch_id - 1}"
            store.write(own, merge(store.read(old), new) if batch_id and store.exists(old) else new)
            return store.read(own)

        raw = carried("raw_edges", graph.upsert(found), graph.merge)
        if dedup == "none":
            store.write(f"edges/v{batch_id}", raw)
        else:
            ends = found.select((F.col("seq") * 2).alias("seq"), F.col("subject").alias("mention")).unionByName(found.select((F.col("seq") * 2 + 1).alias("seq"), F.col("object").alias("mention")))
            forms = carried("forms", resolve.first_forms(ends), resolve.merge_forms)
            resolved = resolve.resolve_forms(forms, dedup)
            store.write(f"resolver_map/v{batch_id}", resolved.withColumn("kind", F.lit("canonical_map")))
            renamed = resolve.named(raw, store.read(f"resolver_map/v{batch_id}"), ("src", "dst"))
            store.write(f"edges/v{batch_id}", graph.merge(renamed, renamed.limit(0)))
        if progress:
            progress(batch_id)

    return run


def run_pages(stream: DataFrame, store: Store, checkpoint: str, **options):
    """Start the incremental build over all files that are there, then stop."""
    return stream.writeStream.foreachBatch(upsert_pages(store, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def line_batches(lines: DataFrame, n: int = 50) -> DataFrame:
    """Lines of a micro-batch -> (source, batch_idx, text): each ``n`` lines of a file in their order."""
    ordered = lines.withColumn("i", F.monotonically_increasing_id())
    per_file = ordered.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"]).alias("l"))
    return per_file.select("source", F.posexplode(joined(F.col("l"), n, "\n")).alias("batch_idx", "text"))


def canonical_stream(mentions: DataFrame) -> DataFrame:
    """A stream (mention) -> (norm, canonical, n): the longest spelling so far of each normal form, with its count.

    State is one row a normal form, kept by Spark; no mention waits for others.
    """
    from ..functions.text import normalize_entity

    return mentions.withColumn("norm", normalize_entity("mention")).groupBy("norm").agg(F.max_by("mention", F.struct(F.length("mention"), "mention")).alias("canonical"), F.count(F.lit(1)).alias("n"))
