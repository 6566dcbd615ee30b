"""Bloom filters over 64-bit hashes, built where the rows are: compressed bitmaps travel, rows don't."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits a row, hash functions, and a filter's proven bound in bits (8 MB), whatever the number of rows.
BITS_A_ROW, HASHES, MOST_BITS = 16, 2, 1 << 26
#: 64-bit words of a segment, the unit that travels, and tasks whose bitmaps meet first.
SEGMENT, FAN_IN = 1 << 14, 256


def bits_for(rows: int, most: int = MOST_BITS) -> int:
    """Bits of a filter for so many rows, a power of two; beyond the bound more rows pass, and no result changes."""
    return min(most, 1 << max(10, (rows * BITS_A_ROW - 1).bit_length()))


def _positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Positions of 64-bit hashes: double hashing on their two halves."""
    low, high = h & 0xFFFFFFFF, (h.view(np.uint64) >> np.uint64(32)).astype(np.int64) | 1
    return [(low + i * high) % bits for i in range(HASHES)]


def _set(bitmap: np.ndarray, places: np.ndarray) -> None:
    """Set distinct places."""
    np.bitwise_or.at(bitmap, places >> 6, np.uint64(1) << (places & 63).astype(np.uint64))


def _get(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1


def _rows(task: int, parts) -> pa.RecordBatch:
    """(segment, task, once, twice) of segments with a bit."""
    parts = [(i, once, twice) for i, once, twice in parts if once.any()]
    pack = lambda x: zlib.compress(x.tobytes(), 1)
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in parts], pa.int32()), pa.array([task] * len(parts), pa.int64()), pa.array([pack(p[1]) for p in parts], pa.binary()), pa.array([pack(p[2]) for p in parts], pa.binary())],
        names=["segment", "task", "once", "twice"],
    )


def _build(bits: int):
    def run(batches):
        from pyspark import TaskContext

        once, twice = np.zeros(bits >> 6, np.uint64), np.zeros(bits >> 6, np.uint64)
        for batch in batches:
            for p in _positions(batch.column("h").to_numpy(), bits):
                places, n = np.unique(p, return_counts=True)
                _set(twice, places[(n > 1) | _get(once, places)])
                _set(once, places)
        yield _rows(TaskContext.get().partitionId(), ((i // SEGMENT, once[i : i + SEGMENT], twice[i : i + SEGMENT]) for i in range(0, len(once), SEGMENT)))

    return run


def _merge(batches):
    """Bitmaps sorted by (segment, task group) -> one a group: a bit that two of them have is set twice."""
    held, once, twice = None, None, None
    for batch in batches:
        for segment, group, a, b in zip(*(batch.column(c).to_pylist() for c in ("segment", "task", "once", "twice"))):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint64) for x in (a, b))
            if held == (segment, group):
                twice = twice | b | (once & a)
                once = once | a
            else:
                if held:
                    yield _rows(held[1], [(held[0], once, twice)])
                held, once, twice = (segment, group), a, b
    if held:
        yield _rows(held[1], [(held[0], once, twice)])


def bitmap(hashes: DataFrame, bits: int, repeated: bool = False) -> np.ndarray:
    """The filter over the column ``h``: places that a row has set or, if ``repeated``, that two rows have set.

    Every task has two bitmaps of the filter's size and hands on their segments, compressed. They meet in two levels;
    what reaches the driver is the filter itself, of at most ``MOST_BITS``.
    """
    kind = "segment int, task long, once binary, twice binary"
    parts = hashes.select("h").mapInArrow(_build(bits), kind)
    for divisor in (FAN_IN, FAN_IN * FAN_IN * FAN_IN):
        parts = parts.withColumn("task", F.floor(F.col("task") / divisor)).repartition("segment", "task").sortWithinPartitions("segment", "task").mapInArrow(_merge, kind)
    out = np.zeros(bits >> 6, np.uint64)
    for r in parts.select("segment", "twice" if repeated else "once").collect():  # a row a segment
        own = np.frombuffer(zlib.decompress(bytes(r[1])), np.uint64)
        out[r["segment"] * SEGMENT :][: len(own)] |= own
    return out


def passes(spark: SparkSession, filled: np.ndarray):
    """A function of a hash column: whether the filter has all places of a hash."""
    shared, bits = spark.sparkContext.broadcast(filled), len(filled) << 6

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        hit = np.ones(len(h), bool)
        for p in _positions(h.to_numpy(), bits):
            hit &= _get(shared.value, p)
        return pa.array(hit)

    def column(h: Column | str) -> Column:
        return maybe(h)

    return column
