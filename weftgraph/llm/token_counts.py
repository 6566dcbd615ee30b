"""Operator 1: token counts of whole texts by a map-side two-tier lookup."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workspace
from .bpe import encoder, gathered, tokenizer_file

#: Entries of the broadcast table, entries that a summary keeps, distinct entries before a task prunes its summary.
HOT, KEPT, PRUNE_AT = 16_384, 4_096, 200_000
#: Summaries are merged in two levels; so many merges run side by side.
FAN_IN = 64
OVER = 1024


def _pack(counts: dict[str, int]) -> bytes:
    return "\n".join(f"{n}\t{word}" for word, n in counts.items()).encode("utf-8", "surrogatepass")


def _unpack(blob: bytes) -> Counter:
    return Counter({w: int(n) for n, _, w in (line.partition("\t") for line in blob.decode("utf-8", "surrogatepass").split("\n") if line)})


def _summaries(batches):
    """One bounded summary a task: its most frequent space-separated words (lossy counting)."""
    from pyspark import TaskContext

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                seen.update(text.split(" "))
        if len(seen) > PRUNE_AT:
            seen = Counter(dict(seen.most_common(PRUNE_AT // 4)))
    top = {w: n for w, n in seen.most_common(KEPT) if n > 1 and len(w) < 64 and "\n" not in w and "\t" not in w}
    yield pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int64()), "words": pa.array([_pack(top)], pa.binary())})


def _merge(table: pa.Table) -> pa.Table:
    """Summaries of a group of tasks -> one bounded summary."""
    total: Counter = Counter()
    for blob in table.column("words"):
        total.update(_unpack(blob.as_py()))
        if len(total) > PRUNE_AT:
            total = Counter(dict(total.most_common(PRUNE_AT // 4)))
    return pa.table({"words": pa.array([_pack(dict(total.most_common(HOT)))], pa.binary())})


def hot_table(docs: DataFrame) -> list[str]:
    """The words that are frequent over all of ``docs``: at most ``HOT``, so that its broadcast has a fixed bound.

    Each task counts its own whole texts and hands on one summary of at most ``KEPT`` words. No word is a shuffle key.
    """
    parts = docs.select("text").mapInArrow(_summaries, "task long, words binary")
    merged = parts.groupBy(F.pmod("task", F.lit(FAN_IN)).alias("g")).applyInArrow(_merge, "words binary")
    total: Counter = Counter()
    for row in merged.collect():  # FAN_IN rows of at most HOT words
        total.update(_unpack(bytes(row["words"])))
    return [w for w, _ in total.most_common(HOT)]


def token_counts(spark: SparkSession, docs: DataFrame, tokenizer_path: str, over: int = OVER) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, n_bytes, n_tokens, over_limit), one row per input row.

    The first tier is a broadcast table of the lengths, in tokens, of frequent words; the second is each worker's own
    bounded cache, filled by encoding what the table misses. No row moves.

    Nulls: a null text counts as empty (0 bytes, 0 tokens); a null doc_id is carried. Empty texts: 0 and 0. Very long
    texts are counted whole. Repeated rows give repeated results. An empty table gives an empty result. Further columns
    of ``docs``, whatever their names, are not read.
    """
    workspace.prepare(spark)
    sc = spark.sparkContext
    file = tokenizer_file(tokenizer_path)
    enc = encoder(file)
    words = hot_table(docs)
    table = {w: n for w, n in zip(words, enc.lengths(words)) if n is not None and n < 256}
    shared = sc.broadcast((file, "\n".join(table), bytes(table.values())))  # one byte a word

    def count(batches):
        text_of, packed, sizes = shared.value
        enc = encoder(text_of)
        enc.seed_lengths(dict(zip(packed.split("\n"), sizes)) if sizes else {})
        for batch in gathered(batches):
            n = enc.counts(batch.column("text"))
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(n, pa.int64()), pa.array([x > over for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
