"""Components, communities and layouts of the graph."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .settle import settle
from .graph import RELATED, common_entities, entity_pages, undirected

#: Distances that a layout holds at a time.
CELLS = 1 << 20
#: Names from which a layout sums far pushes by series of so many terms (each cuts the rest to 0.31), and most cells of a side.
SERIES, TERMS, SIDE = 600, 24, 256
#: Least distance that a push counts with.
CLOSE = 0.01


def components(edges: DataFrame) -> DataFrame:
    """(entity, component): weakly connected components named by their least entity, by label propagation with checkpoints."""
    around = settle(undirected(edges))  # each round reads it
    labels = around.groupBy(F.col("node").alias("entity")).agg(F.min("other").alias("m")).select("entity", F.least("entity", "m").alias("component"))
    labels = settle(labels)
    while True:
        near = around.join(labels.select(F.col("entity").alias("other"), F.col("component").alias("c")), "other").groupBy(F.col("node").alias("entity")).agg(F.min("c").alias("c"))
        far = labels.select(F.col("entity").alias("component"), F.col("component").alias("up"))
        # the least label of the neighbours, and the label of the own label: paths shorten by half each round
        grown = labels.join(near, "entity").join(far, "component").select("entity", "component", F.least("component", "c", "up").alias("new"))
        grown = settle(grown)
        changed = grown.where("new < component").limit(1).count()
        labels = grown.select("entity", F.col("new").alias("component"))
        if not changed:
            return labels


def _greedy(nodes: list[str], pairs: list[tuple[str, str]], total: int | None = None) -> list[list[str]]:
    """Communities by merging, again and again, the two that raise modularity most; ties go to the first by name.

    ``total``: edges of the whole graph, when these are only some of its components. Gains are whole numbers, times
    2 m^2. A pair of linked communities is kept at one of them, the larger by degree as it is put there, in a heap for each
    weight by the other's degree and name. So a merge into a hub leaves the pairs at it as they are: the best of each
    heap is the best at any degree of the hub. What a pair or the queue says of a community is true or too good, as
    degrees only grow and a grown weight puts the pair anew; it is put right when it comes first.
    """
    index = {n: i for i, n in enumerate(nodes)}
    weight: list[dict[int, int]] = [{} for _ in nodes]
    m = total or len(pairs)
    degree, least, members = [0] * len(nodes), list(range(len(nodes))), [[i] for i in range(len(nodes))]
    for a, b in pairs:
        i, j = index[a], index[b]
        degree[i] += 1
        degree[j] += 1
        if i != j:
            weight[i][j] = weight[i].get(j, 0) + 1
            weight[j][i] = weight[j].get(i, 0) + 1
    kept: list[dict[int, list[tuple[int, int, int]]]] = [{} for _ in nodes]  # by weight: (degree, least, other)
    never = (0, 0, 0)
    said = [never] * len(nodes)  # what the queue holds of a community
    queue: list[tuple[tuple[int, int, int], int]] = []

    def key(i: int, d: int, x: int, w: int) -> tuple[int, int, int]:
        y = least[i]
        return (degree[i] * d - 2 * m * w, x, y) if x < y else (degree[i] * d - 2 * m * w, y, x)

    def say(i: int, new: tuple[int, int, int]) -> None:
        if new[0] < 0 and new < said[i]:
            said[i] = new
            heapq.heappush(queue, (new, i))

    def put(i: int, j: int) -> None:
        if degree[i] < degree[j]:
            i, j = j, i
        w = weight[i][j]
        heapq.heappush(kept[i].setdefault(w, []), (degree[j], least[j], j))
        say(i, key(i, degree[j], least[j], w))

    def best(i: int) -> tuple[tuple[int, int, int], int]:
        """The best pair kept at ``i`` and its other community."""
        found = never, i
        for w in list(kept[i]):
            heap = kept[i][w]
            while heap:
                d, x, j = heap[0]
                if weight[i].get(j) == w:
                    if d == degree[j]:
                        found = min(found, (key(i, d, x, w), j))
                        break
                    heapq.heappop(heap)
                    put(i, j)
                else:
                    heapq.heappop(heap)
            if not heap:
                del kept[i][w]
        return found

    for i, near in enumerate(weight):
        for j in near:
            if i < j:
                put(i, j)
    while queue:
        old, i = heapq.heappop(queue)
        if old != said[i]:
            continue
        said[i] = never
        now, j = best(i)
        if now != old:
            say(i, now)
            continue
        if len(weight[i]) < len(weight[j]):
            i, j = j, i
        least[i] = min(least[i], least[j])
        members[i] += members[j]
        degree[i] += degree[j]
        moved, weight[j], kept[j], members[j], said[j] = weight[j], {}, {}, [], never
        for k, w in moved.items():
            del weight[k][j]
            if k != i:
                weight[i][k] = weight[k][i] = weight[i].get(k, 0) + w
        for k in moved:
            if k != i:
                put(i, k)
        say(i, best(i)[0])
    return [[nodes[i] for i in sorted(x)] for x in members if x]


def communities(edges: DataFrame) -> DataFrame:
    """(entity, community, algo): communities by size from 0, of equal ones the first by name; greedy modularity at every size.

    No merge across components raises modularity, and a merge changes no gain in another component: each component meets
    in one task, with the number of edges of the whole graph, and the result is that of the whole graph.
    """
    pairs = settle(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    total = pairs.count()
    parts = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    placed = pairs.join(parts.withColumnRenamed("entity", "a"), "a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _greedy(sorted({*pdf.a, *pdf.b}), sorted(zip(pdf.a, pdf.b)), total)
        return pd.DataFrame([(x, c[0]) for c in found for x in c], columns=["entity", "head"])

    found = settle(placed.groupBy("component").applyInPandas(run, "entity string, head string"))
    sizes = found.groupBy("head").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "head").select("head")
    ranks = edges.sparkSession.createDataFrame(sizes.rdd.zipWithIndex().map(lambda r: (r[0][0], r[1])), "head string, community long")
    return found.join(ranks, "head").select("entity", "community", F.lit("greedy modularity").alias("algo"))


def ranked_communities(found: DataFrame, k: int = 10, palette: int = 10) -> DataFrame:
    """(community, size, rank, colour) of the ``k`` largest."""
    sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), "community").limit(k)
    w = W.orderBy(F.desc("size"), "community")  # k rows
    return sizes.withColumn("rank", F.row_number().over(w)).withColumn("colour", F.pmod(F.col("rank") - 1, F.lit(palette)))


def with_community(nodes: DataFrame, found: DataFrame) -> DataFrame:
    return nodes.join(found.select("entity", "community"), "entity", "left").withColumn("community", F.coalesce("community", F.lit(0)))


def _pushes_all(at, scale: float = 1.0):
    """Sum of ``scale`` d / |d|^2 over all others, with |d| at least ``CLOSE``: pair by pair."""
    import numpy as np

    n, force = len(at), np.empty((len(at), 2))
    for a in range(0, n, step := max(1, CELLS // max(1, n))):
        d = at[a : a + step, None] - at[None]
        far = np.maximum(np.sqrt((d**2).sum(-1)), CLOSE)
        force[a : a + step] = (d * (scale / far**2)[..., None]).sum(1)
    return force


class _Pushes:
    """The same sums for many places, to 1e-11 or so: pair by pair up to two cells of a grid away, by series beyond.

    With places as complex numbers a push is the conjugate of 1 / (z - z_j). A cell's places give a series around its
    middle, Fourier transforms carry the series of all cells to all cells that are three or more away, and a place sums
    the series of its own cell. Two cells' width is ``CLOSE`` at least, so that pushes in the series are never limited.
    """

    def __init__(self, n: int):
        import numpy as np

        self.side = min(SIDE, 1 << max(3, round(math.log2(math.sqrt(n) / 2))))
        g = 2 * self.side
        x = np.fft.fftfreq(g, 1 / g)
        apart = x[:, None] + 1j * x[None]
        near = np.maximum(abs(x)[:, None], abs(x)[None]) < 3
        inverse = np.where(near, 0, 1 / np.where(near, 1, apart))
        self.kernel, power = [], inverse
        for q in range(2 * TERMS - 1):
            self.kernel.append(np.fft.fft2(power))
            power = power * inverse * (q + 1)

    def __call__(self, at, scale: float = 1.0):
        import numpy as np

        n, g, low = len(at), self.side, at.min(0)
        h = max((at - low).max() * (1 + 1e-9) / g, CLOSE / 2)
        cell = np.minimum(((at - low) / h).astype(int), g - 1)
        number = cell[:, 0] * g + cell[:, 1]
        order = np.argsort(number, kind="stable")
        xy, cell, number = at[order], cell[order], number[order]
        off = (xy - low) / h - cell - 0.5
        t = off[:, 0] + 1j * off[:, 1]
        sent, power = [], np.ones(n, complex)
        for m in range(TERMS):
            whole = np.bincount(number, power.real, g * g) + 1j * np.bincount(number, power.imag, g * g)
            sent.append(np.fft.fft2(whole.reshape(g, g), (2 * g, 2 * g)))
            power = power * t / (m + 1)
        far = np.zeros(n, complex)
        for k in reversed(range(TERMS)):
            got = np.zeros((2 * g, 2 * g), complex)
            for m in range(TERMS):
                got += sent[m] * self.kernel[k + m]
            got = np.fft.ifft2(got)[:g, :g].reshape(-1) * ((-1) ** k / math.factorial(k))
            far = far * t + got[number]
        force = np.column_stack([far.real, -far.imag]) / h
        first = np.searchsorted(number, np.arange(g * g + 1))
        for dx in range(-2, 3):  # the five cells of a column stand side by side
            row = cell[:, 0] + dx
            inside = (row >= 0) & (row < g)
            row = np.where(inside, row, 0) * g
            begin, end = first[row + np.maximum(cell[:, 1] - 2, 0)], first[row + np.minimum(cell[:, 1] + 2, g - 1) + 1]
            count = np.where(inside, end - begin, 0)
            upto = np.concatenate([[0], np.cumsum(count)])
            a = 0
            while a < n:
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + CELLS, "right")) - 1)
                c = count[a:b]
                other = np.arange(upto[b] - upto[a]) + np.repeat(begin[a:b] - (upto[a:b] - upto[a]), c)
                one = np.repeat(np.arange(b - a), c)
                x, y = xy[a:b, 0][one] - xy[other, 0], xy[a:b, 1][one] - xy[other, 1]
                w = 1 / np.maximum(x * x + y * y, CLOSE**2)
                force[a:b, 0] += np.bincount(one, x * w, b - a)
                force[a:b, 1] += np.bincount(one, y * w, b - a)
                a = b
        out = np.empty((n, 2))
        out[order] = force * scale
        return out


def _spring(names: list[str], pairs: list[tuple[int, int]], rounds: int = 50, seed: int = 42):
    """Force-directed places: edges pull, all push, steps cool down."""
    import numpy as np

    n = len(names)
    at = np.random.default_rng(seed).random((n, 2))
    k, heat = 2 / math.sqrt(max(1, n)), 0.1
    one, two = np.array(sorted({p for i, j in pairs for p in ((i, j), (j, i))}), int).reshape(-1, 2).T
    pushes = _pushes_all if n < SERIES else _Pushes(n)
    for r in range(rounds):
        force = pushes(at, k * k)
        d = at[one] - at[two]
        far = np.maximum(np.sqrt((d**2).sum(-1)), 0.01)
        np.subtract.at(force, one, d * (far / k)[:, None])
        size = np.maximum(np.sqrt((force**2).sum(-1)), 1e-9)
        at = at + force / size[:, None] * np.minimum(size, heat * (1 - r / rounds))[:, None]
    return at


def page_layout(edges: DataFrame) -> DataFrame:
    """(page_num, entity, raw_x, raw_y): a layout for each page's own entities; a page meets in one task."""
    rows = settle(edges.select(F.coalesce("page_num", F.lit(1)).cast("int").alias("page_num"), "src", "dst"))
    # dealt by ranges, whose number stays: few bytes are much work here, and Spark would put small pages into one task
    rows = rows.repartitionByRange(max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1), "page_num")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf.src, *pdf.dst})
        index = {x: i for i, x in enumerate(names)}
        at = _spring(names, [(index[a], index[b]) for a, b in zip(pdf.src, pdf.dst)])
        return pd.DataFrame({"page_num": pdf.page_num.iloc[0], "entity": names, "raw_x": at[:, 0], "raw_y": at[:, 1]})

    return rows.groupBy("page_num").applyInPandas(run, "page_num int, entity string, raw_x double, raw_y double")


def scaled(layout: DataFrame) -> DataFrame:
    """Raw places to [0, 1] on each page; a page without extent is divided by 1."""
    w = W.partitionBy("page_num")
    unit = lambda c: (F.col(c) - F.min(c).over(w)) / F.when(F.max(c).over(w) == F.min(c).over(w), 1.0).otherwise(F.max(c).over(w) - F.min(c).over(w))
    return layout.withColumn("x", unit("raw_x")).withColumn("y", unit("raw_y")).drop("raw_x", "raw_y")


def layered_nodes(edges: DataFrame, layout: DataFrame | None = None, spacing: float = 1.0) -> DataFrame:
    """(node_id, entity, page_num, x, y, z, is_common): one node for each entity and page; pages are layers."""
    placed = entity_pages(edges, 1).select("entity", F.explode(F.col("pages").cast("array<int>")).alias("page_num"), (F.size("pages") >= 2).alias("is_common"))
    if layout is not None:
        placed = placed.join(scaled(layout), ["page_num", "entity"], "left")
    else:
        placed = placed.withColumn("x", F.lit(None).cast("double")).withColumn("y", F.lit(None).cast("double"))
    half = lambda c: F.coalesce(c, F.lit(0.5)).alias(c)
    return placed.select(F.concat("entity", F.lit("__page"), F.col("page_num").cast("string")).alias("node_id"), "entity", "page_num", half("x"), half("y"), ((F.col("page_num") - 1) * spacing).alias("z"), "is_common")


def layered_edges(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, is_identity, page_num): edges inside a layer, and a chain for each entity on many."""
    page = F.coalesce("page_num", F.lit(1)).cast("int")
    node = lambda e, p: F.concat(e, F.lit("__page"), p.cast("string"))
    inside = edges.select(node(F.col("src"), page).alias("source_id"), node(F.col("dst"), page).alias("target_id"), F.coalesce("relation", F.lit(RELATED)).alias("relation"), F.lit(False).alias("is_identity"), page.alias("page_num"))
    w = W.partitionBy("entity").orderBy("page_num")
    chain = common_entities(edges).select("entity", F.explode(F.col("pages").cast("array<int>")).alias("page_num")).withColumn("next", F.lead("page_num").over(w)).where("next IS NOT NULL")
    same = chain.select(node(F.col("entity"), F.col("page_num")).alias("source_id"), node(F.col("entity"), F.col("next")).alias("target_id"), F.lit("SAME_ENTITY").alias("relation"), F.lit(True).alias("is_identity"), F.lit(None).cast("int").alias("page_num"))
    known = layered_nodes(edges).select("node_id")
    inside = inside.join(known.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    return inside.select(same.columns).unionByName(same)
