"""Operator 4: exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has one bit a dimension, its sign, in words of 64 bits, and is cut into segments of 16. By the pigeonhole
rule two codes at distance d agree in some of n segments to d // n bits. So a search looks up, in an index of each
segment, the segment values at radius 0, then 1, and so on, verifies what it finds on whole codes, and stops when the
k-th distance is provably covered: all segments have been searched to radius r, so every code nearer than n (r + 1) has
been seen.

The codes are cut into shards by a hash of the id. A task builds a shard's index once; the queries stream past it in
blocks; a shard hands on k rows a query, and the least k over all shards are the result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import workspace

BITS, WORD = 16, 64
#: Mean rows of a shard, and rows of a block of queries; pairs that are verified at a time.
SHARD, BLOCK, AT_ONCE = 16_384, 4_096, 1_000_000
K = 10
_MASKS = [np.array([sum(1 << b for b in c) for c in combinations(range(BITS), r)], np.int64) for r in range(BITS + 1)]


class Index:
    """Multi-index over distinct codes (rows of 64-bit words); each keeps the ids of its ``k`` least rows."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, k: int):
        order = np.lexsort((ids, *codes.T))
        ids, codes = ids[order], codes[order]
        first = np.ones(len(codes), bool)
        first[1:] = (codes[1:] != codes[:-1]).any(axis=1)
        rank = np.arange(len(codes)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(codes) else np.zeros(0, np.int64)
        keep = rank < k  # of rows with one code only the k least ids can be among the k nearest
        self.ids, own = ids[keep], first[keep]
        self.starts = np.append(np.flatnonzero(own), len(self.ids))
        self.codes = codes[first]
        self.segments = codes.shape[1] * WORD // BITS
        self.parts, self.heads, self.order = [], [], []
        for s in range(self.segments):
            part = _segment(self.codes, s)
            by = np.argsort(part, kind="stable")
            self.parts.append(part)
            self.order.append(by)
            self.heads.append(np.searchsorted(part[by], np.arange((1 << BITS) + 1)))

    def _found(self, q: np.ndarray, radius: int):
        """(query, code) pairs first seen at this radius: the segment that finds a pair is the first of its nearest ones."""
        own = [_segment(q, s) for s in range(self.segments)]
        for s in range(self.segments):
            step = max(1, 500_000 // len(_MASKS[radius]))
            for at in range(0, len(q), step):
                probes = own[s][at : at + step, None] ^ _MASKS[radius]
                low, high = self.heads[s][probes], self.heads[s][probes + 1]
                sizes = (high - low).sum(axis=1)
                cut = np.searchsorted(np.cumsum(sizes), np.arange(AT_ONCE, sizes.sum() + AT_ONCE, AT_ONCE))
                begin = 0
                for end in np.unique(np.append(cut + 1, len(sizes))):
                    end = min(int(end), len(sizes))
                    if end <= begin:
                        continue
                    lo, n = low[begin:end].ravel(), (high - low)[begin:end].ravel()
                    total = int(n.sum())
                    if total:
                        query = np.repeat(np.arange(at + begin, at + end), sizes[begin:end])
                        offset = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                        code = self.order[s][np.repeat(lo, n) + offset]
                        new = np.ones(total, bool)
                        for other in range(self.segments):
                            if other != s:
                                d = np.bitwise_count(own[other][query] ^ self.parts[other][code])
                                new &= d >= radius + (other < s)
                        yield query[new], code[new]
                    begin = end

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, distance) of the ``k`` nearest rows of each query code, by distance, then id."""
        best = [np.zeros(0, np.int64) for _ in range(3)]
        active = np.arange(len(q))
        for radius in range(BITS + 1):
            parts = [[best[0]], [best[1]], [best[2]]]
            for query, code in self._found(q[active], radius):
                d = np.bitwise_count(q[active[query]] ^ self.codes[code]).sum(axis=1, dtype=np.int64)
                n = (self.starts[code + 1] - self.starts[code])
                at = np.repeat(self.starts[code], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                found = [np.repeat(active[query], n), self.ids[at], np.repeat(d, n)]
                if len(at) > 200_000:
                    found = _least(*found, k)
                for p, x in zip(parts, found):
                    p.append(x)
            best = list(_least(*(np.concatenate(p) for p in parts), k))
            covered = self.segments * (radius + 1) - 1
            count = np.bincount(best[0], minlength=len(q))
            worst = np.full(len(q), -1, np.int64)
            np.maximum.at(worst, best[0], best[2])
            done = (count >= min(k, len(self.ids))) & (worst <= covered)
            active = active[~done[active]]
            if not len(active):
                break
        return tuple(best)


def _least(query: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` rows of each query with the least (distance, id)."""
    order = np.lexsort((ids, d, query))
    query, ids, d = query[order], ids[order], d[order]
    first = np.ones(len(query), bool)
    first[1:] = query[1:] != query[:-1]
    rank = np.arange(len(query)) - (np.flatnonzero(first)[np.cumsum(first) - 1] if len(query) else 0)
    keep = rank < k
    return query[keep], ids[keep], d[keep]


def _segment(codes: np.ndarray, s: int) -> np.ndarray:
    word, shift = divmod(s * BITS, WORD)
    return ((codes[:, word] >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64)


def _code(vector: str, words: int) -> str:
    """SQL: the signs of a vector as ``words`` numbers of 64 bits."""
    own = lambda w: f"aggregate(transform(slice({vector}, {w * WORD + 1}, {WORD}), (x, i) -> CASE WHEN x > 0 THEN shiftleft(1L, i) ELSE 0L END), 0L, (a, b) -> a | b)"
    return "array(" + ", ".join(f"coalesce({own(w)}, 0L)" for w in range(words)) + ")"


def _words(batch: pa.RecordBatch, words: int) -> np.ndarray:
    return batch.column("code").flatten().to_numpy().view(np.uint64).reshape(-1, words)


def _search(k: int, words: int):
    """Rows sorted by shard, the shard's own rows before the queries -> (query_id, vec_id, distance) of each shard."""

    def run(batches):
        held, own, asked, index = None, [], [], None

        def answer():
            nonlocal asked
            ids, q = (np.concatenate(x) for x in zip(*asked))
            asked = []
            which, found, d = index.search(q, k)
            return pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array(found), pa.array(d)], names=["query_id", "vec_id", "distance"])

        for batch in batches:
            shard, query = batch.column("shard").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            ids, codes = batch.column("id").to_numpy(), _words(batch, words)
            edges = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (query[1:] != query[:-1]))) if len(shard) else []
            for a, b in zip(edges, [*edges[1:], len(shard)]):
                if shard[a] != held:
                    if asked:
                        yield answer()
                    held, own, asked, index = shard[a], [], [], None
                if not query[a]:
                    own.append((ids[a:b], codes[a:b]))
                elif own or index:
                    if index is None:
                        index, own = Index(*(np.concatenate(x) for x in zip(*own)), k), []
                    asked.append((ids[a:b], codes[a:b]))
                    if sum(len(x[0]) for x in asked) >= BLOCK:
                        yield answer()
        if asked:
            yield answer()

    return run


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``vectors`` and ``queries`` (vec_id, embedding, ...) -> (query_id, rank, vec_id, distance): the exact ``k`` nearest codes.

    Distances are Hamming distances of sign codes, of as many bits as the longest vector has dimensions; a shorter one
    is filled up with zeros. Ties go to the least vec_id. A query that is itself among the vectors finds itself.

    Nulls: a null vector, like an empty one, has the code 0, as has a null dimension; rows with a null vec_id are left
    out, as nothing could name them. Very long vectors count whole. Repeated rows count each; repeated queries are asked
    once. Fewer than ``k`` rows give them all; empty tables give no rows. Further columns, whatever their names, are not
    read.
    """
    workspace.prepare(spark)
    rows, asked = (df.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v")) for df in (vectors, queries))
    longest = max(df.agg(F.max(F.size("v"))).first()[0] or 0 for df in (rows, asked))
    words = max(1, -(-longest // WORD))
    rows, asked = (workspace.written(spark, df.select("id", F.expr(_code("v", words)).alias("code")), name) for df, name in ((rows, "codes"), (asked.dropDuplicates(["id", "v"]), "queries")))
    shards = max(1, -(-rows.count() // SHARD))
    # a shard's rows are dealt once; the queries go to every shard
    left = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("query"), "id", "code")
    right = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("query"), "id", "code")
    n = max(1, min(shards, 100_000))
    dealt = left.unionByName(right).repartition(n, "shard").sortWithinPartitions("shard", "query")
    found = dealt.mapInArrow(_search(k, words), "query_id long, vec_id long, distance long")
    w = W.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
