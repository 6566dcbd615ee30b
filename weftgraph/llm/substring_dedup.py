"""Operator 6: repeated word sequences, found by doubling the length of windows that still repeat.

Windows of 5 words come first. A window of 20 words holds sixteen of them; the one with the least hash is its anchor,
so that equal windows of 20 have equal anchors in the same place, and only anchors are compared (about one word in
eight). Where an anchor repeats, the windows of 10 words around it are compared; where those repeat, the windows of 20.
A window that is alone at one length is never extended, and the levels end when none is left.

A level compares hashes in one exchange. Before it, a task compares its own: a hash that it holds many times leaves
once, so that a passage in a third of all documents does not meet row by row in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workspace

#: Words of the shortest windows, and of a window that counts as repeated: doubled twice.
BASE, WINDOW = 5, 20
#: Positions that a task gathers before it compares them, and cached word hashes of a worker.
GATHER, CACHED = 400_000, 300_000
#: A null doc_id sorts as this one.
LAST = (1 << 63) - 1
_ANCHORS = WINDOW - BASE + 1
_words: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93)))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; ``bytes.split`` cuts at exactly the blanks of the operator."""
    if len(_words) > CACHED:
        _words.clear()
    for w in set(words).difference(_words):
        _words[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def _fives(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of 5 words by start, and the anchor of each window of 20: its least one, the first if equal."""
    two = _pair(a[:-1], a[1:])
    five = _pair(_pair(two[:-3], two[2:-1]), a[4:])
    # place of the least hash in runs of 1, 2, 4, 8 and 16, each from two of the half
    best = np.arange(len(five))
    for step in (1, 2, 4, 8):
        left, right = best[:-step], best[step:]
        best = np.where(five[right] < five[left], right, left)
    return five, best


def _inner(starts: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Start of the window of 10 words inside each window of 20: from its anchor on, or from 5 before a late anchor.

    The choice hangs on the anchor's place alone, so equal windows of 20 have equal inner windows in the same place.
    """
    return np.where(anchors - starts <= WINDOW // 2, anchors, anchors - BASE)


def _candidates(level: int, words: np.ndarray, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(hashes, check hashes, starts) of a document's windows at a level, given the starts that repeat at the one before."""
    five, anchors = _fives(words)
    if level == BASE:
        at = np.unique(anchors)
        return five[at], None, at
    starts = np.arange(len(anchors))
    if level == 2 * BASE:
        at = np.unique(_inner(starts, anchors)[_has(len(words), known)[anchors]])
        return _pair(five[at], five[at + 5]), None, at
    at = starts[_has(len(words), known)[_inner(starts, anchors)]]
    ten = _pair(five[:-5], five[5:])
    check = _mix(_pair(five[at], five[at + 15]) ^ _pair(ten[at + 5], five[at + 7]))
    return _pair(ten[at], ten[at + 10]), check >> np.uint64(33), at


def _has(n: int, known: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[known] = True
    return out


def _emit(level: int):
    """Rows of a level: hashes to compare, once a task and hash, and starts that already repeat in the task.

    ``pack`` holds, from low to high, whether a row asks, whether its hash came more than once, the start (30 bits), and
    on the last level 31 bits to be sure of the hash.
    """
    final = level == WINDOW

    def flush(parts):
        h = np.concatenate([p[0] for p in parts])
        at = np.concatenate([p[2] for p in parts]).astype(np.int64)
        row = np.repeat([p[4] for p in parts], [len(p[2]) for p in parts])
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        same = ranked[1:] == ranked[:-1]
        if final:
            c = np.concatenate([p[1] for p in parts]).astype(np.int64)
            doc = np.repeat([p[3] for p in parts], [len(p[2]) for p in parts])
            shared = np.flatnonzero(np.append(same, False) | np.append(False, same))
            own = order[shared]  # only rows with a hash in common need an order of their own
            order[shared] = own[np.lexsort((at[own], row[own], doc[own], c[own], h[own]))]
            same &= c[order][1:] == c[order][:-1]
        first, many = np.ones(len(h), bool), np.zeros(len(h), bool)
        first[order[1:]] = ~same
        many[order[1:]] = same
        many[order[:-1]] |= same
        # rows stay in the order of their documents, and those that don't ask go with their document: both compress well
        key = h.view(np.int64).copy()
        key[~first] = _mix(row[~first].astype(np.uint64)).view(np.int64)
        pack = at << 2 | many.astype(np.int64) << 1 | first
        if final:
            pack |= np.where(first, c, 0) << 32
        columns = {"key": key, "row": row, "pack": pack} | ({"doc": doc} if final else {})
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))

    def run(batches):
        parts, size = [], 0
        for batch in batches:
            lists = batch.column("at").to_pylist() if level > BASE else [None] * batch.num_rows
            for doc, row, text, known in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text").to_pylist(), lists):
                words = text.encode("utf-8", "surrogatepass").split()
                if len(words) < WINDOW:
                    continue
                h, c, at = _candidates(level, word_hashes(words), None if known is None else np.array(known, np.int64))
                if len(at):
                    parts.append((h, c, at, LAST if doc is None else doc, row))
                    size += len(at)
                if size >= GATHER:
                    yield flush(parts)
                    parts, size = [], 0
        if parts:
            yield flush(parts)

    return run


def _repeats(final: bool):
    """Sorted rows of a level -> (row, at) of the starts that repeat; on the last level, of all but the earliest.

    Rows of one hash stream by; no group is held.
    """

    def run(batches):
        held = None  # the last row, until the next tells whether its hash repeats
        for batch in batches:
            key, row, pack = (batch.column(n).to_numpy() for n in ("key", "row", "pack"))
            before = False
            if held is not None:
                key, row, pack = (np.concatenate([[h], x]) for h, x in zip(held[:3], (key, row, pack)))
                before = held[3]
            if not len(key):
                continue
            ask = (pack & 1).astype(bool)
            same = ask[1:] & ask[:-1] & (key[1:] == key[:-1]) & (pack[1:] >> 32 == pack[:-1] >> 32)
            earlier = np.concatenate([[before], same])
            hit = earlier | ~ask if final else earlier | np.append(same, False) | (pack & 2).astype(bool)
            out = hit[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(row[:-1][out]), pa.array(((pack[:-1][out] & 0xFFFFFFFF) >> 2).astype(np.int32))], names=["row", "at"])
            held = (key[-1], row[-1], pack[-1], bool(earlier[-1]))
        if held is not None and (held[3] or (not held[2] & 1 if final else held[2] & 2)):
            yield pa.RecordBatch.from_arrays([pa.array([held[1]], pa.int64()), pa.array([(held[2] & 0xFFFFFFFF) >> 2], pa.int32())], names=["row", "at"])

    return run


def _level(docs: DataFrame, level: int, known: DataFrame | None) -> DataFrame:
    """(row, at) of the starts that repeat at a level; ``docs``: row, doc_id, text, dealt by row."""
    final = level == WINDOW
    rows = docs if known is None else docs.join(_lists(known), "row")
    asked = rows.mapInArrow(_emit(level), "key long, row long, pack long" + ", doc long" * final)
    order = [F.col("key"), F.expr("pack & 1")] + [F.expr("shiftright(pack, 32)"), F.col("doc"), F.col("row"), F.col("pack")] * final
    dealt = asked.repartition("key").sortWithinPartitions(*order)
    return dealt.select("key", "row", "pack").mapInArrow(_repeats(final), "row long, at int")


def _lists(found: DataFrame) -> DataFrame:
    """The starts of each row as one list: never longer than the document. A task's lists are those of a partition of
    bounded size, and so fit into its memory."""
    return found.groupBy("row").agg(F.collect_list("at").alias("at")).hint("shuffle_hash")


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, n_words, n_removed, kept_sha256, kept_text), one row per input row.

    Removes each word that a window of 20 words covers whose sequence also starts earlier: in a smaller doc_id, or
    earlier in the same document. Windows are judged on the input. Equality is by 95-bit hashes.

    Nulls: a null text has no words; a null doc_id comes after all others. Empty texts, and texts under 20 words, keep
    all they have. Ties: rows with the same doc_id come one after the other in the order in which they are read. Very
    long texts are read whole. An empty table gives an empty result. Further columns are not read.
    """
    workspace.prepare(spark)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # every level reads this one exchange: the columns must stay the same for Spark to reuse it
    dealt = rows.repartition(workspace.partitions(spark, rows), "row")
    level, known = BASE, None
    while level <= WINDOW:
        known = _level(dealt, level, known)
        level *= 2

    def cut(batches):
        for batch in batches:
            out = []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("at").to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                if starts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    s = np.array(starts)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + WINDOW, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    kept = words
                whole = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode("utf-8", "surrogatepass")))
            columns = list(zip(*out)) if out else [()] * 4
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    marked = dealt.join(_lists(known), "row", "left").select("doc_id", "text", "at")
    return marked.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
