"""Operator 9: all pairs of documents with n-gram Jaccard similarity at or over a threshold, by MinHash banding."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloom, workspace
from .components import components
from .hot import join_counted

WORDS, THRESHOLD = 5, 0.8
#: Share of pairs at the threshold that banding has to find, and the most hashes a signature may take.
RECALL, HASHES = 0.9995, 128
#: Mean documents, and shingles, of a block; a task compares two blocks at a time, and larger groups have more blocks.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 250_000
#: Rows of a block whose similarities are held at a time.
ROWS = 256
SEED = 11
CACHED = 300_000
_words: dict[bytes, int] = {}


def bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = HASHES) -> tuple[int, int]:
    """(bands, rows a band): the most rows, and so the fewest false candidates, that reach the recall at the threshold."""
    for rows in range(most, 0, -1):
        if (p := threshold**rows) > 1e-12:
            n = max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)))
            if n * rows <= most:
                return n, rows
    return most, 1


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of ``n`` words; a shorter text is one run, an empty one none."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_words) > CACHED:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w)
    a = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(n, len(a))
    h = np.zeros(len(a) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + a[i : len(a) - n + 1 + i])
    return np.unique(h)


def _signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least values of the hash functions over a set, in slices of bounded size."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 4096):
            x = s[at : at + 4096, None] * a + b
            out = np.minimum(out, (x ^ (x >> np.uint64(32))).min(axis=0))
    return out


def signatures(spark: SparkSession, docs: DataFrame, words: int, n: int, rows: int) -> DataFrame:
    """(doc_id, h, s, size, bands): hash of the text, key of the shingle set, its size and its band hashes."""
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, n * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, n * rows, dtype=np.uint64)

    def run(batches):
        for batch in batches:
            keys, sizes, bands = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, words)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                if len(s):
                    x = _signature(s, a, b).reshape(n, rows)
                    h = np.arange(1, n + 1, dtype=np.uint64)
                    for i in range(rows):
                        with np.errstate(over="ignore"):
                            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + x[:, i])
                    bands.append(h.view(np.int64))
                else:
                    bands.append([])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "h", "s", "size", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInArrow(workspace.giving_back(run), "doc_id long, h long, s binary, size int, bands array<long>")


def strips(sets: list[np.ndarray], threshold: float, split: int | None = None):
    """(rows, columns, linked) of sets with Jaccard similarity at or over the threshold, some rows at a time; exact.

    ``split``: only rows before that place against columns from it on; else all against all, but for itself. Shingles
    that the very same sets have are one column with a weight, and those of one set alone are in no intersection.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    left, right = (np.arange(n), np.arange(n)) if split is None else (np.arange(split), np.arange(split, n))
    doc = np.repeat(np.arange(n), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    doc, column = doc[shared], column[shared]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    first = np.flatnonzero(np.append(True, column[1:] != column[:-1])) if len(column) else np.zeros(0, np.int64)
    ends = np.append(first[1:], len(column))
    x, weights = np.zeros((n, 0), np.float32), np.zeros(0)
    if len(first):
        draw = np.random.default_rng(SEED).integers(0, 1 << 63, (2, n), dtype=np.uint64)
        a, b = (np.add.reduceat(d[doc], first) for d in draw)  # a sum over the sets that have a shingle, twice: 128 bits
        by = np.lexsort((b, a))
        new = np.append(True, (a[by][1:] != a[by][:-1]) | (b[by][1:] != b[by][:-1]))
        weights = np.diff(np.append(np.flatnonzero(new), len(by)))
        first, ends = first[by[new]], ends[by[new]]
    p, q = Fraction(str(threshold)).as_integer_ratio()
    kind = np.float32 if not len(sizes) or sizes.max() < 1 << 24 else np.float64
    for at in range(0, len(left), ROWS):
        rows = left[at : at + ROWS]
        common = np.zeros((len(rows), len(right)), kind)
        for c in range(0, len(first), 1024):
            many = (ends - first)[c : c + 1024]
            x = np.zeros((n, len(many)), kind)
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            x[doc[np.repeat(first[c : c + 1024], many) + inside], np.repeat(np.arange(len(many)), many)] = 1
            common += (x[rows] * weights[c : c + 1024].astype(kind)) @ x[right].T
        common = common.astype(np.int64)
        hit = common * q >= p * (sizes[rows][:, None] + sizes[right][None, :] - common)
        if split is None:
            hit[np.arange(len(rows)), rows] = False
        yield rows, right, hit


def folded(sets: list[np.ndarray], copies: np.ndarray, threshold: float, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of each set: the documents it is linked to, and the first place that links lead to. No pair is kept."""
    links, root = np.zeros(len(sets), np.int64), np.arange(len(sets))
    for rows, right, hit in strips(sets, threshold, split):
        links[rows] += hit @ copies[right]
        if split is not None:
            links[right] += copies[rows] @ hit
        for i, own in zip(rows.tolist(), hit):
            others = right[own]
            if len(others) and (root[others] != root[i]).any():
                old = np.zeros(len(sets), bool)
                old[root[others]] = old[root[i]] = True
                root[old[root]] = old.argmax()
    return links, root


def _verify(threshold: float):
    """Shingle sets of a part of a group, sorted by part -> (rep, root, links): a member that it reaches, and its links."""

    def part(inside: bool, own: list):
        own.sort(key=lambda r: (r[0], r[1]))
        reps, copies = np.array([r[1] for r in own], np.int64), np.array([r[2] for r in own], np.int64)
        split = None if inside else sum(r[0] == own[0][0] for r in own)
        if inside or split < len(own):  # a part of two blocks may hold only one of them
            links, root = folded([r[3] for r in own], copies, threshold, split)
        else:
            links, root = np.zeros(len(own), np.int64), np.arange(len(own))
        return pa.RecordBatch.from_arrays([pa.array(reps), pa.array(reps[root]), pa.array(links)], names=["rep", "root", "links"])

    def run(batches):
        held, own = None, []
        for batch in batches:
            for *key, side, rep, copies, raw in zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j", "side", "rep", "copies", "shingles"))):
                if key != held:
                    if own:
                        yield part(held[1] == held[2], own)
                    held, own = key, []
                own.append((side, rep, copies, np.frombuffer(raw, np.uint64)))
        if own:
            yield part(held[1] == held[2], own)

    return run


def _sets(words: int):
    """Texts of the candidates -> their shingle sets, checked against the sets' keys."""

    def run(batches):
        for batch in batches:
            raw = [shingles(t, words) for t in batch.column("text").to_pylist()]
            right = np.array([xxhash.xxh3_128_digest(x.tobytes()) == s for x, s in zip(raw, batch.column("s").to_pylist())], bool)
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "rep", "copies", "k")), pa.array([x.tobytes() for x in raw], pa.binary())], names=["component", "rep", "copies", "k", "shingles"])
            yield out.filter(pa.array(right))

    return run


def similar(spark: SparkSession, docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, class_id, n_links, copies, h), one row per input row.

    Two documents are linked when the Jaccard similarity of their sets of ``words``-word runs is ``threshold`` or more.
    ``class_id`` is the least doc_id that links lead to, ``n_links`` the number of documents that a document is linked
    to, ``copies`` how many have its very set. Documents with one set are one node. Nodes that share a band hash form
    candidate groups, found as components over links to each band's least node. A Bloom filter of the candidates keeps
    all other texts where they are; the candidates' shingle sets meet in blocks of bounded size, and all pairs of a
    group are compared, of which only sums and one link a node leave a task.

    Nulls: a null text is empty; a null doc_id is carried, and is a class's id only if no other is there. Empty texts
    have no links, each its own class. Texts under ``words`` words are one run. Ties: of a class's documents the least
    doc_id names it. Repeated rows are copies of each other. Very long texts are compared whole. An empty table gives an
    empty result. Further columns, whatever their names, are not read.
    """
    workspace.prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n, rows = bands(threshold, recall)
    sigs = workspace.written(spark, signatures(spark, docs, words, n, rows), "signatures")
    total = sigs.count()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    nodes = sigs.where("size > 0").groupBy("s").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = workspace.written(spark, nodes.select("s", "first.doc_id", "first.h", "copies", "size", "bands", F.monotonically_increasing_id().alias("rep")), "nodes")
    keys = nodes.select("rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    edges = join_counted(keys, buckets, "key", "n", total * n).where("rep <> least").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    groups = components(spark, edges)
    own = workspace.written(spark, nodes.join(groups, nodes["rep"] == groups["node"]).select("s", "doc_id", "h", "copies", "size", "rep", "component"), "candidates")
    blocks = own.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("k"))
    several = not blocks.where("k > 1").isEmpty()
    placed = join_counted(own, blocks, "component", "n", max(1, total)).select(F.col("doc_id").alias("d"), F.col("h").alias("t"), "s", "copies", "rep", "component", "k")
    maybe = bloom.passes(spark, bloom.bitmap(own.select(F.xxhash64("doc_id", "h").alias("h")), bloom.bits_for(own.count())))
    # a candidate's text is that of its node's first document, and repeated rows of that have one text
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text")).where(maybe(F.xxhash64("doc_id", "h")))
    texts = texts.groupBy("doc_id", "h").agg(F.first("text").alias("text"))
    # merged at every size: the candidates grow with the corpus, and small ones must not change the plan
    met = texts.hint("merge").join(placed, (F.col("h") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("s", "copies", "rep", "component", "k", "text")
    sets = met.mapInArrow(workspace.giving_back(_sets(words)), "component long, rep long, copies long, k int, shingles binary")
    sets = workspace.written(spark, sets, "sets").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
    parts = sets.select("component", "rep", "copies", "shingles", F.col("block").alias("side"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    parts = parts.select("component", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "copies", "shingles")
    dealt = parts.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    found = workspace.written(spark, dealt.mapInArrow(workspace.giving_back(_verify(threshold)), "rep long, root long, links long"), "found")
    if several:
        roots = components(spark, found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("rep"), F.col("component").alias("root"))
        found = found.groupBy("rep").agg(F.sum("links").alias("links")).join(roots, "rep", "left").select("rep", F.coalesce("root", "rep").alias("root"), "links")
    known = nodes.select("s", "doc_id", "copies", "rep").join(found, "rep", "left").select("s", "copies", F.coalesce("root", "rep").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), "doc_id")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("head")
    heads = known.groupBy("root").agg(head, F.count(F.lit(1)).alias("m"))
    known = join_counted(known, heads, "root", "m", max(1, total)).select("s", "copies", "links", F.col("head.doc_id").alias("class_id"))
    full = join_counted(sigs.where("size > 0").select("doc_id", "h", "s"), known, "s", "copies", total)
    full = full.select("doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "copies", "h")
    none = sigs.where("size = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("copies"), "h")
    return full.unionByName(none)


def keep_one(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """``docs``, whole rows with all their columns, but of each class only the document with the class's doc_id.

    Rows whose key a Bloom filter of those to go lacks pass straight through; only the others meet by key.

    Nulls: empty texts and null texts have a class each and stay; a null doc_id stays only if its class has no other.
    Ties: rows alike in doc_id and text are one document, and stay or go together. Very long texts are compared whole.
    An empty table stays empty. Further columns may have any name and type.
    """
    workspace.prepare(spark)
    gone = similar(spark, docs, **options).where(~F.col("doc_id").eqNullSafe(F.col("class_id")))
    gone = workspace.written(spark, gone.select(F.xxhash64("doc_id", "h").alias("h"), F.col("doc_id").alias("d"), F.col("h").alias("t")).distinct(), "gone")
    maybe = bloom.passes(spark, bloom.bitmap(gone, bloom.bits_for(gone.count())))
    rows = workspace.packed(docs).withColumn("t", F.xxhash64("r.text")).withColumn("d", F.col("r.doc_id").cast("long"))
    rows = rows.withColumn("maybe", maybe(F.xxhash64("d", "t")))
    some = rows.where("maybe").alias("x").join(gone.alias("y"), F.col("x.d").eqNullSafe(F.col("y.d")) & (F.col("x.t") == F.col("y.t")), "left_anti")
    return rows.where("not maybe").select("r").unionByName(some.select("r")).select("r.*")
