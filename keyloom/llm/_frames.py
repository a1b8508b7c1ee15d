"""Frame helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside an operator; turned back into null at its end.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one of our own only where none is set and all runs on this machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="keyloom-checkpoint-"))
    return context.getCheckpointDir()


#: By application, the lists of open scratch() blocks that get the folders durable() writes.
_open: dict[str, list[list[str]]] = {}


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the frame into the shared folder and read it again.

    Unlike a checkpoint, the table is compressed, has a known size, and doesn't carry the constraints of its plan on,
    which would grow with each round of a loop.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/durable-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if blocks := _open.get(spark.sparkContext.applicationId):
        blocks[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """At the end of the block, what durable() wrote in it is removed: all that rests on it must have been written by then."""
    blocks = _open.setdefault(spark.sparkContext.applicationId, [])
    blocks.append([])
    try:
        yield
    finally:
        for path in blocks.pop():
            remove(spark, path)


def unused(name: str, *taken: Iterable[str]) -> str:
    """The name, or one like it, that no column has; names differ by more than case."""
    known = {c.lower() for columns in taken for c in columns}
    return next(n for k in itertools.count() if (n := f"_{name}{k or ''}").lower() not in known)


def drawn(rows: DataFrame, total: int, sample: int, *by: str) -> DataFrame:
    """About, and at most, sample of the total rows, the distinct ones of the smallest hashes of the given columns.

    A threshold on the hash leaves little more than the sample, so that no task sends the driver a sample of its own.
    """
    share = min(1.0, 1.25 * sample / max(total, 1))
    hashed = F.xxhash64(F.lit("drawn"), *by)
    some = rows.where(F.shiftrightunsigned(hashed, 32) <= int(share * ((1 << 32) - 1)))
    return some.distinct().orderBy(hashed, *by).limit(sample)


def doc_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def doc_id_of(key: str = "key") -> Column:
    return F.nullif(F.col(key), F.lit(NULL_ID)).alias("doc_id")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lean_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on at most so many rows go to Python at once: a batch holds whole texts, in the JVM's buffers and again in the worker's."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def give_back() -> None:
    """What a task has freed goes back to the system, as its worker stays for later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def pieces(batches: Iterable[pa.RecordBatch], size: int = 1 << 19) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about ``size`` bytes of text (one document at least) with the texts as UTF-8; null is empty."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        texts = texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        low = done = 0
        while low < len(ends):
            high = min(len(ends), int(np.searchsorted(ends, done + size)) + 1)
            yield batch.slice(low, high - low), [t or b"" for t in texts.slice(low, high - low).to_pylist()]
            low, done = high, int(ends[high - 1])
        del batch, texts
    give_back()
