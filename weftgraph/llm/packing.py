"""Operator 5: packing documents into sequences by dominance reduction, then best fit.

Packing depends on lengths alone, and there are at most ``capacity`` of them. So the lengths are counted over all
pieces, the counts are packed on the driver with exact multiplicities (work and memory bounded by the capacity, not by
the corpus), and each piece finds its place by its rank among the pieces of its length. Where the order of the documents
counts, windows of them are packed in the same way, one after the other, each in a task.

Ids are those of the ``tokenizers`` library; ``bpe`` says how they come from it.
"""

from __future__ import annotations

import logging
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import workspace
from .bpe import encoder, gathered, tokenizer_file

CAPACITY = 2048
#: Documents of a window that is packed on its own where their order counts.
WINDOW = 16_384
_log = logging.getLogger(__name__)


class _Lengths:
    """A multiset of lengths with sorted access."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = [0] * (capacity + 2)
        for length, n in counts.items():
            self.n[length] = n
        self.kinds = sorted(x for x, n in counts.items() if n)

    def take(self, items: Counter, times: int) -> None:
        for x, k in items.items():
            self.n[x] -= k * times
            if not self.n[x]:
                self.kinds.remove(x)

    def smallest(self, count: int, above: int = 0, without: Counter | None = None) -> list[int]:
        """The smallest ``count`` items longer than ``above``, leaving out the items ``without``."""
        from bisect import bisect_right

        found: list[int] = []
        for x in self.kinds[bisect_right(self.kinds, above) :]:
            found += [x] * min(count - len(found), self.n[x] - (without or Counter())[x])
            if len(found) >= count:
                break
        return found

    def largest(self, most: int, without: Counter) -> int:
        """The longest item of at most ``most``, leaving out ``without``; 0 if none."""
        from bisect import bisect_right

        for i in range(bisect_right(self.kinds, most) - 1, -1, -1):
            if self.n[self.kinds[i]] > without[self.kinds[i]]:
                return self.kinds[i]
        return 0


def dominating_set(items: _Lengths, j: int, capacity: int) -> Counter | None:
    """A bin with item ``j`` that dominates every other bin with ``j``, of three items at most; None if not provable.

    A bin F dominates a bin G if G's items can be put in groups, each no longer than an own item of F: swapping F in
    never needs another bin.
    """
    rest, alone = capacity - j, Counter([j])
    a = items.largest(rest, alone)
    if not a:
        return alone  # nothing else fits
    small = items.smallest(3, 0, alone)
    if a == rest or len(small) < 2 or small[0] + small[1] > rest:
        return Counter([j, a])  # full, or only one more fits: all that any bin adds to j goes into a's room
    if len(small) == 3 and sum(small) <= rest:
        return None  # four or more items may share a bin
    pair = Counter([j, a])
    b = items.largest(rest - a, pair)
    # the longest sum of two that fits
    top, seen = 0, alone.copy()
    for r in items.kinds:
        if items.n[r] > alone[r] and r < rest:
            s = items.largest(rest - r, seen + Counter([r]))
            top = max(top, r + s if s else 0)
    if top <= a:
        return Counter([j, a])  # any pair goes into a's room
    if b:
        above = items.smallest(2, b, alone)
        if len(above) < 2 or sum(above) > rest:
            return Counter([j, a, b])  # in any pair one is at most b, the other at most a
    return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], int]:
    """Counts of lengths -> ([(bin as ((length, how many), ...), number of such bins)], bins fixed by dominance)."""
    items = _Lengths(counts, capacity)
    bins: list[tuple[tuple[tuple[int, int], ...], int]] = []
    fixed, changed = 0, True
    while changed and items.kinds:
        changed = False
        for j in sorted(items.kinds, reverse=True):
            while j <= capacity and items.n[j]:
                found = dominating_set(items, j, capacity)
                if found is None:
                    break
                # the proof holds until a length runs out: taking items only leaves longer smallest ones
                times = min(items.n[x] // k for x, k in found.items())
                items.take(found, times)
                bins.append((tuple(sorted(found.items(), reverse=True)), times))
                fixed, changed = fixed + times, True
    # best fit, longest first, on what is left: alike bins move together
    rooms: dict[int, list[list]] = {}  # room left -> [[contents, number of bins]]
    filled: list[tuple[tuple[tuple[int, int], ...], int]] = []
    for x in sorted(items.kinds, reverse=True):
        left = items.n[x]
        for room in sorted(r for r in rooms if r >= x):
            fit = room // x
            groups, keep = rooms.pop(room), []
            while groups and left:
                contents, n = groups.pop()
                whole = min(n, left // fit)
                if whole:
                    rooms.setdefault(room - fit * x, []).append([[*contents, (x, fit)], whole])
                    left, n = left - whole * fit, n - whole
                if n and left:
                    rooms.setdefault(room - left * x, []).append([[*contents, (x, left)], 1])
                    left, n = 0, n - 1
                if n:
                    keep.append([contents, n])
            if groups or keep:
                rooms.setdefault(room, []).extend([*groups, *keep])
            if not left:
                break
        fit = capacity // x
        if left // fit:
            rooms.setdefault(capacity - fit * x, []).append([[(x, fit)], left // fit])
        if left % fit:
            rooms.setdefault(capacity - left % fit * x, []).append([[(x, left % fit)], 1])
    for groups in rooms.values():
        filled += [(tuple(contents), n) for contents, n in groups]
    return bins + filled, fixed


def _places(bins, capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, items a bin, first sequence, and offset of the first item, of each run of bins."""
    places: dict[int, list] = {}
    used, sequence = Counter(), 0
    for contents, n in bins:
        offset = 0
        for x, k in contents:
            places.setdefault(x, []).append((used[x], k, sequence, offset))
            used[x] += k * n
            offset += k * x
        sequence += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*runs)) for x, runs in places.items()}


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECE}, sequence_id long, offset long"


def pieces(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Tokenised pieces of ``docs`` (doc_id, text, file, row): doc_id, piece, start, length, ids_crc32, file, row, and
    the rank of a piece among those of its length in its task."""
    workspace.prepare(spark)
    shared = spark.sparkContext.broadcast(tokenizer_file(tokenizer_path))
    stop = struct.pack("<I", end_id)

    def cut(batches):
        from pyspark import TaskContext

        enc, task, ranks = encoder(shared.value), TaskContext.get().partitionId(), Counter()
        for batch in gathered(batches):
            rows = []
            for d, file, row, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "file", "row")), enc.encode(batch.column("text"))):
                ids += stop
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((d, i, at // 4, n, zlib.crc32(own), file, row, task, ranks[n]))
                    ranks[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "file", "row", "task", "local_rank"]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select("doc_id", "text", "file", "row").mapInArrow(workspace.giving_back(cut), f"{PIECE}, file string, row long, task long, local_rank long")


def _placed(batch: pa.RecordBatch, places: dict, rank: np.ndarray) -> pa.RecordBatch:
    """Pieces with sequence_id and offset, by their ranks among those of their lengths."""
    length = batch.column("length").to_numpy()
    sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(length[order]) != 0)) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(edges, np.append(edges[1:], len(order))):
        own = order[a:b]
        x = int(length[own[0]])
        first, each, at, shift = places[x]
        run = np.searchsorted(first, rank[own], "right") - 1
        r = rank[own] - first[run]
        sequence[own] = at[run] + r // each[run]
        offset[own] = shift[run] + r % each[run] * x
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> one row per piece with its sequence_id and offset.

    Documents longer than ``capacity`` are cut into whole sequences and a rest; all others stay whole. Columns: doc_id,
    piece, start, length, ids_crc32, sequence_id, offset.

    Nulls: a null text is the end id alone; a null doc_id is carried. Empty texts: one piece of one id. Very long texts
    give many pieces. Ties and repeated rows are packed each on its own; which of two pieces of one length gets which
    place is arbitrary. An empty table gives an empty result. Further columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("file"), F.lit(0).cast("long").alias("row"))
    cut = workspace.written(spark, pieces(spark, rows, tokenizer_path, capacity, end_id).drop("file", "row"), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    bins, fixed = plan(counts, capacity)
    _log.info("%d of %d sequences are fixed by dominance", fixed, sum(n for _, n in bins))
    places = spark.sparkContext.broadcast(_places(bins, capacity))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = by_task.select("length", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def place(batches):
        for batch in batches:
            yield _placed(batch, places.value, batch.column("rank").to_numpy())

    ranked = cut.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank"))
    return ranked.mapInArrow(workspace.giving_back(place), PLACED)


def _window(batch: pa.RecordBatch, capacity: int, first: int) -> pa.RecordBatch:
    """A window's pieces, in order, packed; its sequences are numbered from ``first`` in the order of their first pieces."""
    length = batch.column("length").to_numpy()
    order = np.argsort(length, kind="stable")
    kinds, starts, n = np.unique(length[order], return_index=True, return_counts=True)
    rank = np.empty(len(length), np.int64)
    rank[order] = np.arange(len(length)) - np.repeat(starts, n)
    out = _placed(batch, _places(plan(dict(zip(kinds.tolist(), n.tolist())), capacity)[0], capacity), rank)
    found, at, which = np.unique(out.column("sequence_id").to_numpy(), return_index=True, return_inverse=True)
    number = np.empty(len(found), np.int64)
    number[np.argsort(at, kind="stable")] = first + np.arange(len(found))
    return out.set_column(5, "sequence_id", pa.array(number[which]))


def pack_in_order(spark: SparkSession, docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, window: int = WINDOW) -> DataFrame:
    """Like ``pack``, where the order of ``docs`` counts: each ``window`` documents are packed on their own, in order.

    So any run of sequences has the sources in the proportions of its documents' order. The order is that of the rows in
    the files that ``docs`` is read from, by number of the file and place in it; a table that comes from no files is
    taken as its partitions stand. Sequences of a window are numbered in the order of their first pieces, those of a
    later window are numbered higher. A task holds one window's last pieces; whole sequences pass through.

    Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns are as in ``pack``.
    """
    workspace.prepare(spark)
    own = [F.col("doc_id").cast("long").alias("doc_id"), "text"]
    try:
        meta = docs.metadataColumn("_metadata")
        rows = docs.select(*own, meta["file_name"].alias("file"), meta["row_index"].alias("row"))
        rows.schema  # noqa: B018  resolves the columns
    except AnalysisException:  # not read from Parquet files
        rows = docs.select(*own, F.lit("").alias("file"), F.monotonically_increasing_id().alias("row"))
    cut = workspace.written(spark, pieces(spark, rows, tokenizer_path, capacity, end_id).drop("task", "local_rank"), "pieces")
    sizes = cut.groupBy("file").agg(F.max("row").alias("n"))  # one row a file
    earlier = W.orderBy(F.length("file"), "file").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("file", F.coalesce(F.sum(F.col("n") + 1).over(earlier), F.lit(0)).alias("before"))
    at = cut.join(before, "file").select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("row")).alias("at"))
    at = at.withColumn("window", F.floor(F.col("at") / window))
    dealt = at.repartition("window").sortWithinPartitions("window", "at", "piece")

    def place(batches):
        held, parts, first = None, [], 0
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]

        def close():
            return _window(pa.concat_batches(parts), capacity, first)

        for batch in batches:
            windows = batch.column("window").to_numpy()
            edges = np.flatnonzero(np.append(True, windows[1:] != windows[:-1])) if len(windows) else []
            for a, b in zip(edges, [*edges[1:], len(windows)]):
                if windows[a] != held:
                    if parts:
                        yield close()
                    held, parts, first = windows[a], [], int(windows[a]) << 32
                part = batch.slice(int(a), int(b - a)).select(names)
                full = part.column("length").to_numpy() == capacity
                whole = part.filter(pa.array(full))
                yield pa.RecordBatch.from_arrays([*whole.columns, pa.array(first + np.arange(len(whole))), pa.array(np.zeros(len(whole), np.int64))], names=[*names, "sequence_id", "offset"])
                first += len(whole)
                if not full.all():
                    parts.append(part.filter(pa.array(~full)))
        if parts:
            yield close()

    return dealt.mapInArrow(workspace.giving_back(place), PLACED)
