"""A collection's tables in one folder: pages, chunks, nodes, edges, resolver_map and entity_freq, as Parquet."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("pages", "chunks", "triples", "nodes", "edges", "resolver_map", "entity_freq")


def write_text(spark: SparkSession, path: str, parts) -> None:
    """One UTF-8 file on any store that Spark reaches, from strings one after the other."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        for part in parts:
            out.write(bytearray(part.encode("utf-8")))
    finally:
        out.close()


class Store:
    """Reads and writes a collection below ``root``; any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, collection: str):
        self.spark, self.collection = spark, collection
        self.path = f"{root.rstrip('/')}/{collection}"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(f"{self.path}/{name}")
        return fs.exists(p)

    def write(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        df.write.mode(mode).parquet(f"{self.path}/{name}")

    def read(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise FileNotFoundError(f"collection {self.collection!r} has no {name}; build it first")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def remove(self) -> None:
        """Delete the collection, as a forced rebuild does."""
        fs, p = self._fs(self.path)
        fs.delete(p, True)

    def info(self) -> DataFrame:
        """(name, exists, mb) of the collection's tables."""
        rows = []
        for name in TABLES:
            fs, p = self._fs(f"{self.path}/{name}")
            there = fs.exists(p)
            rows.append((name, there, fs.getContentSummary(p).getLength() / 1e6 if there else 0.0))
        return self.spark.createDataFrame(rows, "name string, exists boolean, mb double")

    def write_resolver(self, path: str) -> None:
        """The resolver's state as one JSON file."""
        maps = self.read("resolver_map")
        state = {kind: {r["norm"]: r["canonical"] for r in maps.where(F.col("kind") == kind).toLocalIterator()} for kind in ("canonical_map", "aliases")}
        state["entity_frequency"] = {r["canonical"]: r["n"] for r in self.read("entity_freq").toLocalIterator()}
        write_text(self.spark, path, [json.dumps(state, ensure_ascii=False, indent=1)])


def read_resolver(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(resolver_map, entity_freq) of a resolver's JSON file."""
    raw = spark.read.schema("canonical_map map<string,string>, aliases map<string,string>, entity_frequency map<string,bigint>").option("multiLine", True).json(path)
    kinds = [raw.select(F.explode(k).alias("norm", "canonical")).select("norm", "canonical", F.lit(k).alias("kind")) for k in ("canonical_map", "aliases")]
    return kinds[0].unionByName(kinds[1]), raw.select(F.explode("entity_frequency").alias("canonical", "n"))


def migrate(batches: list[DataFrame]) -> DataFrame:
    """Triples (subject, predicate, object) of several sources in order -> edges."""
    from ..operators.graph import upsert

    out = None
    for i, b in enumerate(batches):
        own = b.withColumn("seq", F.monotonically_increasing_id() + F.lit(i) * F.lit(1 << 50))
        out = own if out is None else out.unionByName(own)
    return upsert(out)
