"""Text files as pages, chunks, batches and lines; questions as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import chunks, col, let, line_chunks
from ..operators.settle import settle


def numbered(names: DataFrame, column: str) -> DataFrame:
    """Rows numbered from 1 by a column, in two levels: inside ranges of it, after the rows of the ranges before."""
    spark = names.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = settle(names.repartitionByRange(n, column).withColumn("part", F.spark_partition_id()))
    inside = dealt.withColumn("place", F.row_number().over(W.partitionBy("part").orderBy(column)))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    before = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return inside.join(before, "part").withColumn("page_num", (F.col("before") + F.col("place")).cast("int")).drop("part", "place", "before")


def _paged(raw: DataFrame, collection: str) -> DataFrame:
    """Numbers pages by sorted path."""
    return raw.join(numbered(raw.select("source").distinct(), "source"), "source").select(F.lit(collection).alias("collection"), "page_num", F.element_at(F.split("source", "/"), -1).alias("page"), "source", "content")


def read_pages(spark: SparkSession, path: str, glob: str = "*.txt", collection: str = "default") -> DataFrame:
    """(collection, page_num, page, source, content): the files of a folder, one row each; bytes that are no UTF-8 read as Latin-1."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("source"), F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1")).alias("content"))
    return _paged(raw, collection)


def read_file(spark: SparkSession, path: str, collection: str = "default") -> DataFrame:
    """A single file as a collection of one page; an error if it is missing."""
    return read_pages(spark, path, "*", collection)


def passages(pages: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(page_num, chunk_num, page, source, content): passages for retrieval, numbered from 0 in each page."""
    return pages.select("page_num", F.posexplode(line_chunks("content", size, overlap)).alias("chunk_num", "content"), "page", "source").select("page_num", "chunk_num", "page", "source", "content")


def sentence_chunks(pages: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    return pages.select("page_num", "page", "source", F.posexplode(chunks("content", size, overlap)).alias("chunk_idx", "text"))


def batches(chunked: DataFrame, n: int = 4) -> DataFrame:
    """(page_num, batch_idx, text): each ``n`` chunks of a page joined by blank lines."""
    grouped = chunked.groupBy("page_num", "page", "source", F.floor(F.col("chunk_idx") / n).cast("int").alias("batch_idx"))
    return grouped.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def page_batches(pages: DataFrame, size: int = 500, overlap: int = 50, n: int = 4) -> DataFrame:
    """The same from pages, without a shuffle: a page's chunks are in its row already."""
    return pages.select("page_num", "page", "source", F.posexplode(let(chunks("content", size, overlap), lambda c: joined(c, n, "\n\n"))).alias("batch_idx", "text"))


def joined(items: Column, n: int, mark: str) -> Column:
    """Each ``n`` strings of an array joined; none for an empty array."""
    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / n).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(items, i * n + 1, F.lit(n)), mark))


def text_batches(c: Column | str, n: int = 50) -> Column:
    """Each ``n`` lines of a text, the tail too, joined again."""
    return let(F.split(F.regexp_replace(col(c), r"\n\z", ""), "\n"), lambda x: joined(x, n, "\n"))


def line_batches(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """(source, batch_idx, text): each ``n`` lines of a file, the tail too; lines are numbered in the row of their file."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value"))
    return raw.select("source", F.posexplode(text_batches("value", n)).alias("batch_idx", "text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(source, id, difficulty, category, question, expected_answer, notes) of question files."""
    schema = "test_questions array<struct<id:int,difficulty:string,category:string,question:string,expected_answer:string,notes:string>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.col("_metadata.file_path").alias("source"), F.explode("test_questions").alias("q")).select("source", "q.*")
