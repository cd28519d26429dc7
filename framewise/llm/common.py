"""Helpers shared by the operators of this package."""

from __future__ import annotations

import atexit
import ctypes
import pickle
import shutil
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import framewise
import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tasks get this library's functions by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(framewise)

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="framewise-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return _OWN[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/framewise-{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = path or new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def bucketed(df: DataFrame, tag: str, column: str) -> DataFrame:
    """As ``saved``, but rows of one value of ``column`` are read back into one partition, as a shuffle by it would deal them: a table of its own, with
    as many buckets as the session has shuffle partitions."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    name = path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(name)
    return spark.table(name)


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by ``saved`` that no later result reads."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def per_process(key: tuple, make: Callable):
    """``make()``, once in each Python process: what a worker has learned serves its later tasks. The caller bounds what it holds."""
    kept = sys.modules.setdefault("_framewise_worker", types.ModuleType("_framewise_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


class Shared:
    """A value broadcast by value, classes of this library included; ``value`` is read once in each task."""

    def __init__(self, spark: SparkSession, value: object):
        self._held = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if "_value" not in self.__dict__:
            self._value = pickle.loads(self._held.value)
        return self._value


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows without an id of their own get numbers from here on.
NUMBERED = 1 << 62


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """``doc_id, text`` with an id of its own for every row; rows whose id is null or not theirs alone get numbers from ``NUMBERED`` on and are written
    as the second table, ``number, doc_id, text`` (None where there are none)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    twice = saved(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id"), "twice")
    if twice.isEmpty():
        return rows, None
    shared = rows.join(twice, rows["doc_id"].eqNullSafe(twice["doc_id"]), "left_semi")
    shared = saved(shared.select((F.lit(NUMBERED) + F.monotonically_increasing_id()).alias("number"), "doc_id", "text"), "numbered")
    own = rows.join(twice, "doc_id", "left_anti").filter("doc_id IS NOT NULL")
    return own.unionByName(shared.select(F.col("number").alias("doc_id"), "text")), shared


def unused(name: str, df: DataFrame) -> str:
    """``name``, with as many marks after it as make it no column of ``df``."""
    while name in df.columns:
        name += "_"
    return name


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


#: Bytes of an Arrow batch that goes to a Python worker, so that long texts fit it.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by fewer bytes, where the session still has Spark's own bound; no result depends on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == f"{64 << 20}b":
        spark.conf.set(key, BATCH_BYTES)


def release() -> None:
    """Give free memory of this process back to the system: a worker stays for later tasks, its memory needn't."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def in_arrow(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches bounded by bytes; a task that ends gives its memory back."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from make(batches)
        finally:
            release()

    return df.mapInArrow(run, schema)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts[i], starts[i] + 1, ...`` (``sizes[i]`` of them) of all i, one after another."""
    ends = sizes.cumsum()
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
