"""Operator 8: mixing sources to target weights by Pfair scheduling with earliest deadline first.

Rows of a source are dealt into blocks. Block i of a source with weight w has its release at floor(i / w) and its
deadline at ceil((i + 1) / w), in slots of one block. Weights are whole numbers as exact as the floats given, and the
schedule is found for all blocks by earliest deadline first. When a source has no blocks left, the weights of the
others are made up to one again, and a new phase begins: phases are at most as many as sources.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import workspace

#: Rows of a block, and most blocks of a schedule, but for one more a source: with more rows blocks are larger, so that
#: the schedule that the driver finds and workers hold is at most 24 bytes a block, 24 MB.
BLOCK, BLOCKS = 16, 1 << 20
#: Weights by default: a source's share to this power; weight of a source that has none, or 0, among given ones.
POWER, LEAST = 0.5, 1e-9
SEED = 3


class Plan(Sequence):
    """Phases, each (first slot, sum of weights, weights of the lanes with blocks left, lane it empties), and each lane's blocks."""

    def __init__(self, weights: dict[int, float], blocks: dict[int, int]):
        self.weights, self.starts, self.gone = weights, [], []
        self.lanes = sorted(k for k in blocks if blocks[k])
        self.first = np.cumsum([0] + [blocks[k] for k in self.lanes])
        self.slot, self.release, self.deadline = (np.zeros(int(self.first[-1]), np.int64) for _ in range(3))

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, i):
        i = range(len(self))[i]
        parts = {k: self.weights[k] for k in self.gone[i:]}
        return self.starts[i], sum(parts.values()), parts, self.gone[i]


def _whole(weights: dict[int, float]) -> dict[int, int]:
    """Whole numbers in the very proportion of the weights."""
    exact = {k: Fraction(w) for k, w in weights.items()}
    if any(w <= 0 for w in exact.values()):
        raise ValueError("weights must be over 0")
    scale = max((w.denominator for w in exact.values()), default=1)  # powers of two, as of all floats
    return {k: int(w * scale) for k, w in exact.items()}


def phases(blocks: dict[int, int], weights: dict[int, float]) -> Plan:
    """The schedule of all blocks: of the released ones the one with the earliest deadline comes next.

    A phase ends with the block that empties a lane. A lane enters a phase's queue with its first block, in the order of
    weights, so that a phase costs its own slots. No weight is rounded.
    """
    plan, whole = Plan(weights, blocks), _whole({k: weights[k] for k in blocks if blocks[k]})
    first = {k: int(plan.first[i]) for i, k in enumerate(plan.lanes)}
    left, done, total, at = set(first), dict.fromkeys(first, 0), sum(whole.values()), 0
    order = sorted(whole, key=lambda k: (-whole[k], k))  # first deadlines are in this order in every phase
    place, after = {k: i for i, k in enumerate(order)}, list(range(len(order) + 1))

    def there(i: int) -> int:
        """The first place from ``i`` on whose lane has blocks left; what it passes is shortened."""
        while after[i] != i:
            after[i] = i = after[after[i]]
        return i

    while left:
        plan.starts.append(at)
        fresh, t = 0, 0  # place in ``order`` of the next lane without a block in this phase, and slot of the phase
        waiting: list[tuple[int, int, int, int]] = []  # release, -weight, lane, block of the phase
        ready: list[tuple[int, int, int, int]] = []  # deadline, -weight, lane, block of the phase
        while True:
            while waiting and waiting[0][0] <= t:
                _, w, k, i = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(i + 1) * total // -w), w, k, i))
            fresh = there(fresh)
            new = fresh < len(order) and (-(-total // whole[order[fresh]]), -whole[order[fresh]], order[fresh], 0)
            if new and (not ready or new < ready[0]):
                (end, w, k, i), fresh = new, fresh + 1
            else:
                end, w, k, i = heapq.heappop(ready)
            x = first[k] + done[k]
            plan.slot[x], plan.release[x], plan.deadline[x] = at + t, at + i * total // -w, at + end
            done[k] += 1
            t += 1
            if done[k] == blocks[k]:
                break
            heapq.heappush(waiting, ((i + 1) * total // -w, w, k, i + 1))
        at += t
        plan.gone.append(k)
        total -= whole[k]
        after[place[k]] += 1
        left.remove(k)
    return plan


def positions(plan: Plan, lane: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, release, deadline) of blocks by lane and number."""
    x = plan.first[np.searchsorted(plan.lanes, lane)] + block
    return plan.slot[x], plan.release[x], plan.deadline[x]


def mixed(spark: SparkSession, docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, most: int = BLOCKS) -> DataFrame:
    """``docs`` (doc_id, source, text, ...) -> (doc_id, source, lane, block, slot, release, deadline, position, h), one row per row.

    ``position`` is the row's place in the mix, from 0 without gaps but inside the last block of a source. Up to any
    slot of a phase, each source has had its weight's share of the blocks to less than one block. ``weights``: target
    weight of each source by name, where a missing one, or 0, counts as ``LEAST``; by default the share of rows to the
    power ``POWER``. A block has ``block`` rows, or as many as make ``most`` blocks, and one more a source, do. Inside a
    source rows come in the order of a seeded hash of doc_id, then doc_id. ``h`` is a hash of doc_id and text.

    Nulls: rows without a source are a source of their own; a null doc_id is ordered first among equal hashes. Empty
    and very long texts count as one row each. Ties and repeated rows take one place each. An empty table gives an
    empty result. Other columns are not read.
    """
    workspace.prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("h"))
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("source")).collect()  # one row a source
    lanes = {r["source"]: i for i, r in enumerate(counts)}  # every source has its own, the largest first
    table = workspace.small_table(spark, list(lanes.items()), pa.schema({"name": pa.string(), "lane": pa.int32()}))
    # one row a source, which has a block at least, of 24 bytes, in the schedule that workers are sent
    rows = rows.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "source", "h", "lane")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keyed = rows.withColumn("o", F.xxhash64(F.col("doc_id"), F.lit(SEED)))
    ordered = keyed.repartitionByRange(n, "lane", "o", "doc_id", "h").sortWithinPartitions("lane", "o", "doc_id", "h")

    def rank(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            lane = batch.column("lane").to_numpy(zero_copy_only=False)
            out = np.zeros(len(lane), np.int64)
            for k in np.unique(lane):
                own = np.flatnonzero(lane == k)
                out[own] = seen.get(int(k), 0) + np.arange(len(own))
                seen[int(k)] = seen.get(int(k), 0) + len(own)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "h", "lane")), pa.array([task] * len(lane), pa.int32()), pa.array(out)], names=["doc_id", "source", "h", "lane", "task", "local"])

    ranked = workspace.written(spark, ordered.mapInArrow(workspace.giving_back(rank), "doc_id long, source string, h long, lane int, task int, local long"), "ranked")
    by_task = ranked.groupBy("lane", "task").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("lane").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = by_task.select("lane", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    sizes = {r["lane"]: r["n"] for r in by_task.groupBy("lane").agg(F.sum("n").alias("n")).collect()}  # one row a lane
    names = {i: k for k, i in lanes.items()}
    target = {k: (weights.get(names[k]) or LEAST) if weights is not None else (m / sum(sizes.values())) ** POWER for k, m in sizes.items()}
    block = max(block, -(-sum(sizes.values()) // most))
    plan = phases({k: -(-m // block) for k, m in sizes.items()}, target)
    shared = spark.sparkContext.broadcast(plan)

    def place(batches):
        for batch in batches:
            lane = batch.column("lane").to_numpy(zero_copy_only=False)
            r = batch.column("rank").to_numpy(zero_copy_only=False)
            slot, release, deadline = positions(shared.value, lane, r // block)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), batch.column("lane"), pa.array(r // block), pa.array(slot), pa.array(release), pa.array(deadline), pa.array(slot * block + r % block), batch.column("h")],
                names=["doc_id", "source", "lane", "block", "slot", "release", "deadline", "position", "h"],
            )

    placed = ranked.join(before, ["lane", "task"]).select("doc_id", "source", "h", "lane", (F.col("before") + F.col("local")).alias("rank"))
    return placed.mapInArrow(workspace.giving_back(place), "doc_id long, source string, lane int, block long, slot long, release long, deadline long, position long, h long")


def mix(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``docs``, whole rows with all their columns, in the order of the mix: sorted by position over the partitions.

    A table that is written from it keeps the order in its files' numbers and the rows' places in them, where
    ``packing.pack_in_order`` finds it.

    Nulls: rows without a source are a source of their own; null texts and ids are hashed as nulls. Ties and repeated
    rows, alike in doc_id and text, stand side by side at the first of their places. Empty and very long texts count as
    one row each. An empty table stays empty. Further columns may have any name and type.
    """
    where = mixed(spark, docs, **options).groupBy(F.col("h").alias("at")).agg(F.min("position").alias("position"))
    rows = workspace.packed(docs).withColumn("h", F.xxhash64(F.col("r.doc_id").cast("long"), F.col("r.text")))
    n = workspace.partitions(spark, docs)
    # merged at every size: the places grow with the corpus, and a small table must not change the plan
    joined = rows.hint("merge").join(where, F.col("h") == F.col("at")).select("r", "position")
    return joined.repartitionByRange(n, "position").sortWithinPartitions("position").select("r.*")
