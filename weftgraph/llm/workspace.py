"""Intermediate tables in the folder that the whole cluster shares, and session settings the operators rely on."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch. Texts may be long, so batches are kept small.
ARROW_ROWS, ARROW_BYTES = 256, 16 << 20
#: Bytes, as Spark estimates them, of a shuffle partition of texts.
PARTITION = 128 << 20
#: Folders made so far, each with the tag under which it was made.
_live: list[tuple[str, str]] = []
_tag = ""


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for very long texts, in rows and in bytes.

    Plans read these settings when they run, which is after the operator returns; so the session keeps them.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def give_back() -> None:
    """Free memory of this process goes back to the system, which Arrow's pool and the C library keep for later.

    A Python worker outlives its tasks, and what it keeps counts against its executor's memory in all later stages.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def giving_back(run):
    """``run``, a function of Arrow batches, whose worker gives its free memory back at the end of each task."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def small_table(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A table of the driver's own rows as a local relation: from a list Spark would start Python workers to read it."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema))


def partitions(spark: SparkSession, df: DataFrame, size: int = PARTITION) -> int:
    """Shuffle partitions for rows with whole texts: as many as the session's, or as a bounded size of each takes."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = -(-known // size) if known < 1 << 60 else 0  # Spark's size of a plan it knows nothing of is the largest number
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), by_size, 1)


def packed(docs: DataFrame) -> DataFrame:
    """Whole rows as one struct ``r``, so that no name of an operator's own can clash with a column's."""
    return docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("r"))


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset in local mode, as in tests, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = tempfile.mkdtemp(prefix="weft-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the session ends or ``release`` is called."""
    path = f"{shared_root(spark)}/weft-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path).getParent()
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    _live.append((_tag, path.rsplit("/", 1)[0]))
    return path


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = fresh_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tagged(tag: str):
    """Folders made inside belong to ``tag``, under which they can be released."""
    global _tag
    old, _tag = _tag, tag
    try:
        yield
    finally:
        _tag = old


def release(spark: SparkSession, tag: str) -> None:
    """Delete the folders of a tag. Only for when nothing lazy still reads them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for own, path in [x for x in _live if x[0] == tag]:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)
        _live.remove((own, path))
