"""Texts and records that a question's answer is made of: excerpts, provenance, context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import page_text

NO_EXCERPTS = "[No relevant document excerpts found]"


def excerpts(passages: DataFrame, most: int = 500) -> DataFrame:
    """(page, page_num, chunk_num, excerpt, source, full_length)."""
    return passages.select("page", F.coalesce("page_num", F.lit(0)).alias("page_num"), F.coalesce("chunk_num", F.lit(0)).alias("chunk_num"), F.left("content", F.lit(most)).alias("excerpt"), F.lit("rag").alias("source"), F.length("content").alias("full_length"))


def page_sources(passages: DataFrame) -> DataFrame:
    """(page_num, source): the last passage's path of each page."""
    return passages.groupBy("page_num").agg(F.max_by("source", "chunk_num").alias("source"))


def edges_by_page(edges: DataFrame) -> DataFrame:
    """(page_num, kg_edges): the edges of each page as (u, relation, v), in order of insertion."""
    rows = edges.where("page_num IS NOT NULL AND page_num <> 0").select("page_num", F.struct("first_seq", F.struct(F.col("src").alias("u"), F.coalesce("relation", F.lit("RELATED_TO")).alias("relation"), F.col("dst").alias("v")).alias("e")).alias("x"))
    return rows.groupBy("page_num").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"]).alias("kg_edges"))


def provenance(passages: DataFrame, edges: DataFrame) -> DataFrame:
    """(page_num, source, kg_edges): pages that passages or edges come from; ``rag`` wins over ``kg``."""
    rag = passages.select("page_num").where("page_num IS NOT NULL").distinct().withColumn("rag", F.lit(True))
    return rag.join(edges_by_page(edges), "page_num", "full_outer").select("page_num", F.when(F.col("rag"), "rag").otherwise("kg").alias("source"), "kg_edges")


def page_names(page) -> list:
    """File names that a page number may have, the likeliest first."""
    return [F.format_string("page%03d.txt", page), F.format_string("page%04d.txt", page), F.format_string("page_%03d.txt", page)]


def page_texts(wanted: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """(page_num) -> (page_num, text): by the passages' path, else by the likely names; a note where there is none."""
    named = wanted.join(sources, "page_num", "left").select("page_num", F.posexplode(F.array(F.col("source"), *page_names(F.col("page_num")))).alias("pos", "name"))
    by_name = pages.select(F.explode(F.array_distinct(F.array("source", "page"))).alias("name"), "content")
    hit = named.join(by_name, "name").groupBy("page_num").agg(F.min_by("content", "pos").alias("content"))
    return wanted.join(hit, "page_num", "left").select("page_num", F.coalesce(page_text("content"), F.concat(F.lit("[Page "), F.col("page_num").cast("string"), F.lit(" not found]"))).alias("text"))


def context(passages: DataFrame, graph_text: DataFrame) -> DataFrame:
    """One row (context): numbered excerpts by rank, then the graph's text; ``passages`` has rank and content."""
    blocks = passages.agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x, i: F.concat(F.lit("[Document Excerpt "), (i + 1).cast("string"), F.lit("]\n"), x["content"])), "\n\n")
    body = F.when(F.size("b") == 0, F.lit(NO_EXCERPTS)).otherwise(text)
    g = graph_text.select(F.col("context").alias("g"))
    return blocks.join(F.broadcast(g)).select(F.when(F.col("g") == "", body).otherwise(F.concat(body, F.lit("\n\n"), F.col("g"))).alias("context"))


def triple_context(triples: DataFrame, nothing: str = "No relevant relationships found.") -> DataFrame:
    """One row (context) of plain-word lines of (seq, src, relation, dst)."""
    line = F.concat(F.lit("- "), F.col("src"), F.lit(" "), F.lower(F.replace("relation", F.lit("_"), F.lit(" "))), F.lit(" "), F.col("dst"))
    rows = triples.agg(F.transform(F.array_sort(F.collect_list(F.struct("first_seq", "src", "dst", line.alias("line")))), lambda x: x["line"]).alias("l"))
    return rows.select(F.when(F.size("l") == 0, nothing).otherwise(F.array_join("l", "\n")).alias("context"))


def entity_report(entity: str, lists: DataFrame, found: DataFrame) -> DataFrame:
    """One row (report) of an entity's first relations in both directions."""
    row = lists.where(F.col("entity") == entity)
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(title + "\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("  "), x)), "\n")))
    return row.select("entity", F.concat_ws("\n", F.concat(F.lit("Entity: "), "entity"), part("Outgoing:", "outgoing"), part("Incoming:", "incoming")).alias("report"))


def summary_lines(prov: DataFrame, texts: DataFrame, preview: int = 50) -> DataFrame:
    """(page_num, label, preview) for each page that an answer rests on."""
    n = F.coalesce(F.size("kg_edges"), F.lit(0))
    label = F.when((F.col("source") == "rag") & (n > 0), F.concat(F.lit("RAG + KG: "), n.cast("string"), F.lit(" edges"))).when(F.col("source") == "rag", "RAG").otherwise(F.concat(F.lit("KG: "), n.cast("string"), F.lit(" edges")))
    return prov.join(texts, "page_num").select("page_num", label.alias("label"), F.left(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(preview)).alias("preview"))
