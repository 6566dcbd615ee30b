"""Operator 10: exact duplicates by two passes over a Bloom filter of repeated hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom, workspace
from .hot import SHARE, join_counted


def normalised(text: Column | str) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _keys(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, s, h, row) of every row, written: SHA-256 and 64-bit hash of the normalised text."""
    own = docs.select(F.col("doc_id").alias("doc_id"), normalised("text").alias("text"))
    return workspace.written(spark, own.select("doc_id", F.unhex(F.sha2("text", 256)).alias("s"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row")), "keys")


def _filter(spark: SparkSession, keys: DataFrame, most_bits: int):
    """(rows, function that tells of a hash whether it may be repeated): the first pass."""
    total = keys.count()
    return total, bloom.passes(spark, bloom.bitmap(keys, bloom.bits_for(total, most_bits), repeated=True))


def duplicates(spark: SparkSession, docs: DataFrame, most_bits: int = bloom.MOST_BITS) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    The first pass sets the bits of all hashes in bitmaps of each task, which are joined by OR; a bit set twice tells of
    a possible repeat. In the second pass only rows all of whose bits were set twice are shuffled, pre-aggregated, on
    the SHA-256 of the text; all others are given out where they are. False positives cost a shuffled row and never
    change a result.

    Nulls: a null text is an empty text; a null doc_id stays only if its group has no other. Empty texts are one group.
    Ties: of rows with the same doc_id and text one stays. Very long texts are hashed whole. An empty table gives an
    empty result. Further columns, whatever their names, are not read.
    """
    workspace.prepare(spark)
    keys = _keys(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    total, maybe = _filter(spark, keys, most_bits)
    marked = keys.withColumn("maybe", maybe("h"))
    text_sha256 = F.lower(F.hex("s")).alias("text_sha256")
    alone = marked.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), text_sha256)
    some = marked.where("maybe").select("doc_id", "s", "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = some.groupBy("s").agg(first, F.count(F.lit(1)).alias("group_size"))
    shared = join_counted(some, groups, "s", "group_size", total).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), text_sha256
    )
    return alone.unionByName(shared)


def drop_duplicates(spark: SparkSession, docs: DataFrame, most_bits: int = bloom.MOST_BITS) -> DataFrame:
    """``docs``, whole rows with all their columns, but of rows with equal normalised text only the one of least doc_id.

    Rows whose hash the filter calls single pass straight through. The others meet by text, one a task and text at
    most; of a hot text only rows of its least doc_id leave their task at all.

    Nulls: a null text is an empty text; a row with a null doc_id stays only if no other has its text. Empty texts are
    one text. Ties: of rows with the same doc_id and text the least by text as it stands, then by the row as JSON. Very
    long texts are hashed whole. An empty table stays empty. Further columns may have any name and type.
    """
    workspace.prepare(spark)
    keys = _keys(spark, docs)
    total, maybe = _filter(spark, keys, most_bits)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    groups = keys.where(maybe("h")).groupBy("s").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(groups.where(F.col("n") * SHARE > F.lit(total)).select(F.col("s").alias("hot"), "first"))  # at most SHARE rows
    rows = workspace.packed(docs).withColumn("t", normalised("r.text"))
    rows = rows.select("r", F.unhex(F.sha2("t", 256)).alias("s"), F.xxhash64("t").alias("h")).withColumn("maybe", maybe("h"))
    some = rows.where("maybe").join(hot, F.col("s") == F.col("hot"), "left").where(F.col("hot").isNull() | F.col("r.doc_id").eqNullSafe(F.col("first.doc_id")))
    least = F.min_by("r", F.struct(F.col("r.doc_id").isNull(), F.col("r.doc_id"), F.col("r.text"), F.to_json("r")))
    return rows.where("not maybe").select("r").unionByName(some.groupBy("s").agg(least.alias("r")).select("r")).select("r.*")
