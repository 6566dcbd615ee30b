"""Operator 3: token ids in binary shard files with a minimal perfect hash index.

File format (little-endian), one shard a file, shards in ascending doc_id order:
``WIDS`` magic, version u32, part u32, number u32, entries u64, keys u64, ids u64, id width u8, three zero bytes, then
pilots u32[buckets] (their count first, u64), fingerprints u32[keys], slots' first entry u32[keys], entry offsets
u64[entries + 1], keys i64[keys] ascending (the null key, if any, is first and flagged by one byte before them), and
the raw ids. A line feed that Spark's writer adds ends the file.

A key hashes to a bucket; the bucket's pilot sends it to its slot; the slot's fingerprint tells a key that the file
lacks (with 2^-32 error); the slot gives the first entry of the key, and offsets give the ids. Two reads, no search.
A folder's manifest, a Parquet table of one row a file, leads from a key to its file by the files' least and last keys.

Ids are those of the ``tokenizers`` library; ``bpe`` says how they come from it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import workspace
from .bpe import encoder, gathered, tokenizer_file

MAGIC, VERSION = b"WIDS", 1
#: Ids after which a shard is closed (a single longer document has a longer shard of its own).
SHARD_IDS = 2_000_000
#: Mean keys of a bucket of the hash.
BUCKET = 4
#: Pilots tried at first, and how many times more when none of them fits.
TRIED, MORE = 8, 4
NULL_KEY = -(1 << 63) + 12345
_HEAD = struct.Struct("<4sIIIQQQB3x")


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))


def build_index(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys -> (pilots, slot of each key, fingerprints by slot): hash and displace, largest buckets first."""
    n = len(keys)
    buckets = max(1, -(-n // BUCKET))
    pilots = np.zeros(buckets, np.uint32)
    slots = np.zeros(n, np.int64)
    if n:
        bucket = (_hash(keys, 1) % np.uint64(buckets)).astype(np.int64)
        base = _hash(keys, 2)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        free = np.ones(n, bool)
        for b in sorted(range(buckets), key=lambda b: starts[b] - starts[b + 1]):
            own = order[starts[b] : starts[b + 1]]
            if not len(own):
                break
            pilot, found, many = 0, None, TRIED
            while found is None:  # pilots are tried many at a time
                tried = np.arange(pilot, pilot + many)
                spots = (_mix(base[own] ^ _hash(tried, 3)[:, None]) % np.uint64(n)).astype(np.int64)
                fits = free[spots].all(axis=1)
                if len(own) > 1 and fits.any():
                    rows = np.flatnonzero(fits)
                    apart = np.sort(spots[rows], axis=1)
                    fits[rows] = (apart[:, 1:] != apart[:, :-1]).all(axis=1)
                if fits.any():
                    found = int(fits.argmax())
                pilot, many = pilot + many, many * MORE
            pilot, p = int(tried[found]), spots[found]
            free[p] = False
            slots[own], pilots[b] = p, pilot
    prints = np.zeros(n, np.uint32)
    prints[slots] = (_hash(keys, 4) >> np.uint64(32)).astype(np.uint32)
    return pilots, slots, prints


def make_shard(part: int, number: int, doc_ids: list[int | None], payloads: list[bytes], width: int = 4) -> bytes:
    """A shard file's bytes. ``doc_ids`` ascending, nulls first; ``payloads``: unsigned ids of ``width`` bytes of each entry."""
    lengths = np.array([len(p) // width for p in payloads], np.uint64)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    all_keys = np.array([NULL_KEY if d is None else d for d in doc_ids], np.int64)
    first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]])) if len(all_keys) else np.zeros(0, np.int64)
    keys = all_keys[first]
    pilots, slots, prints = build_index(keys)
    entry = np.zeros(len(keys), "<u4")
    entry[slots] = first
    head = _HEAD.pack(MAGIC, VERSION, part, number, len(doc_ids), len(keys), int(offsets[-1]), width)
    has_null = bytes([bool(doc_ids) and doc_ids[0] is None])
    return b"".join([head, struct.pack("<Q", len(pilots)), pilots.astype("<u4").tobytes(), prints.astype("<u4").tobytes(), entry.tobytes(), offsets.tobytes(), has_null, keys.astype("<i8").tobytes(), *payloads])


class Shard:
    """Keyed access to the bytes of a shard file, which are not copied."""

    def __init__(self, data):
        magic, version, self.part, self.number, self.entries, n, self.n_ids, self.width = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a shard file")
        at = _HEAD.size
        (buckets,) = struct.unpack_from("<Q", data, at)
        at += 8

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        self.pilots, self.prints, self.entry = take("<u4", buckets), take("<u4", n), take("<u4", n)
        self.offsets = take("<u8", self.entries + 1)
        self.has_null = bool(take("u1", 1)[0])
        self.keys = take("<i8", n)
        self.firsts = np.sort(self.entry)
        self.ids = take(f"<u{self.width}", self.n_ids)

    def entries_of(self, keys: np.ndarray) -> np.ndarray:
        """First entry of each key, -1 where the file has none: one hash, one pilot, one slot."""
        keys = np.asarray(keys, np.int64)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        pilot = self.pilots[(_hash(keys, 1) % np.uint64(len(self.pilots))).astype(np.int64)]
        slot = (_mix(_hash(keys, 2) ^ _hash(pilot.astype(np.int64), 3)) % np.uint64(len(self.keys))).astype(np.int64)
        known = self.prints[slot] == (_hash(keys, 4) >> np.uint64(32)).astype(np.uint32)
        return np.where(known, self.entry[slot].astype(np.int64), -1)

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of a document, or None."""
        e = int(self.entries_of(np.array([NULL_KEY if doc_id is None else doc_id]))[0])
        return None if e < 0 else self.ids[int(self.offsets[e]) : int(self.offsets[e + 1])]

    def all(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of a document: repeated keys are neighbours."""
        e = int(self.entries_of(np.array([NULL_KEY if doc_id is None else doc_id]))[0])
        if e < 0:
            return []
        i = int(np.searchsorted(self.firsts, e, "right"))
        end = int(self.firsts[i]) if i < len(self.firsts) else self.entries
        return [self.ids[int(self.offsets[x]) : int(self.offsets[x + 1])] for x in range(e, end)]

    def rows(self):
        """(doc_id, start in the shard, ids as unsigned 32-bit) of every entry, each found by its key."""
        firsts = self.entries_of(self.keys)
        ends = np.append(firsts[1:], self.entries)
        ids, offsets = self.ids.astype("<u4"), self.offsets.astype(np.int64).tolist()
        for i, (e, end) in enumerate(zip(firsts.tolist(), ends.tolist())):
            key = None if i == 0 and self.has_null else int(self.keys[i])
            for x in range(e, end):
                yield key, offsets[x], ids[offsets[x] : offsets[x + 1]]


def _width(tokenizer: str) -> int:
    """Bytes of an id in the files: two where the whole vocabulary fits."""
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_str(tokenizer).get_vocab_size() <= 1 << 16 else 4


def _key(doc_id: str = "doc_id"):
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))


def bounds(docs: DataFrame, n: int) -> np.ndarray:
    """The last key of each of ``n`` ranges of about as many rows, but for the last range; ids alone move for them.

    A key with many rows bounds several ranges, over which its rows are dealt.
    """
    keys = docs.select(_key().alias("k"), F.monotonically_increasing_id().alias("row")).repartitionByRange(n, "k", "row")
    last = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.max("k").alias("k")).collect()  # a row a range
    return np.sort(np.array([r["k"] for r in last], np.int64))[:-1]


def encoded(spark: SparkSession, docs: DataFrame, tokenizer_path: str, ends: np.ndarray, end_id: int = 0) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> (doc_id, row, range, ids): whole texts' ids with the end id, 2 or 4 bytes each."""
    file = tokenizer_file(tokenizer_path)
    width = _width(file)
    if end_id >= 1 << 8 * width:
        raise ValueError("the end id does not fit")
    shared = spark.sparkContext.broadcast((file, ends))  # a bound a range

    def encode(batches):
        file, ends = shared.value
        enc = encoder(file)
        for batch in gathered(batches):
            keys = batch.column("k").to_numpy()
            low, high = np.searchsorted(ends, keys, "left"), np.searchsorted(ends, keys, "right")
            to = low + (_mix(batch.column("row").to_numpy().view(np.uint64)) % (high - low + 1).astype(np.uint64)).astype(np.int64)
            own = [np.append(np.frombuffer(x, "<u4"), np.uint32(end_id)).astype(f"<u{width}").tobytes() for x in enc.encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(to.astype(np.int32)), pa.array(own, pa.binary())], names=["doc_id", "row", "range", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("k"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(encode, "doc_id long, row long, range int, ids binary")


def write_id_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Encode ``docs`` (doc_id, text, ...) and write the shard files into the folder ``path`` of any Hadoop store.

    Texts are encoded where they are, and their ids alone move, once, by ranges of doc_id, so that files are in
    ascending doc_id order; rows of a doc_id that fills several ranges are dealt over them. A task holds one shard at a time. The
    writer is Spark's own, whose commit protocol keeps half-written files of lost executors out.
    """
    workspace.prepare(spark)
    width = _width(tokenizer_file(tokenizer_path))
    n = workspace.partitions(spark, docs)
    rows = encoded(spark, docs, tokenizer_path, bounds(docs, n), end_id)

    def shards(batches):
        from pyspark import TaskContext

        part, number, ids, payloads, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close():
            return pa.RecordBatch.from_arrays([pa.array([make_shard(part, number, ids, payloads, width)], pa.binary())], names=["shard"])

        for batch in batches:
            for d, own in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                payloads.append(own)
                ids.append(d)
                size += len(own) // width
                if size >= shard_ids:
                    yield close()
                    number, ids, payloads, size = number + 1, [], [], 0
        if ids:
            yield close()

    order = [F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    ordered = rows.repartitionById(n, F.col("range")).sortWithinPartitions(*order).select("doc_id", "ids")
    ordered.mapInArrow(shards, "shard binary").select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read_id_files(spark: SparkSession, path: str) -> DataFrame:
    """The shard files of a folder -> (doc_id, file, part, number, start_in_shard, n_tokens, ids_crc32) for every entry."""
    workspace.prepare(spark)

    def entries(batches):
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                shard = Shard(data.as_buffer())
                rows = [(d, at, len(ids), zlib.crc32(ids)) for d, at, ids in shard.rows()]
                n = len(rows)
                columns = list(zip(*rows)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array([file] * n, pa.string()), *(pa.array(np.full(n, x)) for x in (shard.part, shard.number)), *(pa.array(c, pa.int64()) for c in columns[1:])],
                    names=["doc_id", "file", "part", "number", "start_in_shard", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(entries, "doc_id long, file string, part long, number long, start_in_shard long, n_tokens long, ids_crc32 long")


def write_manifest(entries: DataFrame, path: str) -> None:
    """One row a shard file: (file, part, number, least, last, nulls, n_tokens), in the order of the keys."""
    by = entries.groupBy("file", "part", "number").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("nulls"), F.sum("n_tokens").alias("n_tokens"))
    by.sort("part", "number").write.parquet(path)


def look_up(spark: SparkSession, manifest: str, doc_ids: list[int | None]) -> DataFrame:
    """(doc_id, ids) of documents by key: the manifest's rows are filtered in the scan, and only their files are read."""
    known = sorted(d for d in doc_ids if d is not None)
    hit = F.lit(False)
    for d in known:
        hit = hit | ((F.col("least") <= d) & (F.col("last") >= d))
    if len(known) < len(doc_ids):
        hit = hit | F.col("nulls")
    files = [r["file"] for r in spark.read.parquet(manifest).where(hit).select("file").collect()]  # a few files a key
    if not files:
        return spark.createDataFrame([], "doc_id long, ids array<long>")

    def get(batches):
        for batch in batches:
            for data in batch.column("content"):
                shard = Shard(data.as_buffer())
                found = [(d, x.tolist()) for d in doc_ids for x in shard.all(d)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(get, "doc_id long, ids array<long>")


def with_starts(spark: SparkSession, entries: DataFrame) -> DataFrame:
    """Adds ``start``, the number of ids before an entry over all shards: a running sum over shard totals in two levels."""
    from pyspark.sql import Window as W

    totals = entries.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    parts = totals.groupBy("part").agg(F.sum("n").alias("n"))
    blocks = parts.groupBy(F.floor(F.col("part") / 1024).alias("block")).agg(F.sum("n").alias("n"))
    before = F.sum("n")
    far = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one row for 1,024 tasks of the writer
    blocks = blocks.select("block", F.coalesce(before.over(far), F.lit(0)).alias("b0"))
    mid = W.partitionBy("block").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("block", F.floor(F.col("part") / 1024)).withColumn("b1", F.coalesce(before.over(mid), F.lit(0))).join(blocks, "block").select("part", (F.col("b0") + F.col("b1")).alias("b"))
    near = W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.withColumn("b2", F.coalesce(before.over(near), F.lit(0))).join(parts, "part").select("part", "number", (F.col("b") + F.col("b2")).alias("base"))
    return entries.join(starts, ["part", "number"]).withColumn("start", F.col("base") + F.col("start_in_shard"))


def token_id_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Writes ``docs`` as shard files and their manifest, and returns (doc_id, start, n_tokens, ids_crc32) read back.

    ``path``: folder of the files (``ids``) and of the manifest (``manifest``), by default in the shared folder.

    Nulls: a null text is the end id alone; a null doc_id sorts first and has its own key. Empty texts: the end id.
    Ties: rows with the same doc_id are neighbours in the order in which they are read, each with its own ids, maybe in
    several files; a file's key finds the first and the next key's entry ends them. Very long texts have a longer shard.
    An empty table writes no shard and gives no rows. Further columns are not read.
    """
    path = path or workspace.fresh_dir(spark, "ids")
    write_id_files(spark, docs, tokenizer_path, f"{path}/ids", end_id)
    entries = workspace.written(spark, read_id_files(spark, f"{path}/ids"), "entries")
    write_manifest(entries, f"{path}/manifest")
    return with_starts(spark, entries).select("doc_id", "start", "n_tokens", "ids_crc32")
