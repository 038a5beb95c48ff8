"""Session helpers: reading inputs, writing intermediate tables into the shared folder, row batches."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from colform.session import ship_package


#: Bytes of a batch between the JVM and a Python worker; both sides hold some at once.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Ships the package, and bounds Arrow batches by bytes: texts and packed rows vary too much for a row count."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A temporary folder of this machine stands in only where the setting is unset and the session is
    local (tests); on a cluster without the setting this raises.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="colform-")
    return own


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps, and executors give back the heap that these needed.

    It deletes them behind the driver's garbage collection, on a thread of its own that needs a moment. An executor's heap grows
    to what the largest step so far took and stays so, beside the Python workers of the next one, until a whole collection there.
    In a local session neither is worth the wait.
    """
    gc.collect()
    context = spark.sparkContext
    if context.master.startswith("local[") or context.master == "local":
        return
    for _ in range(2):
        context._jvm.System.gc()
        time.sleep(0.5)
    # Tasks are dealt in turn, so that of as many as there are executors each gets one.
    executors = max(1, context._jsc.sc().getExecutorMemoryStatus().size() - 1)
    spark.range(0, executors, 1, executors).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


class Workspace:
    """Tables that one operator call writes into the shared folder to cut lineage.

    ``put`` writes a DataFrame as Parquet and returns the reread table; a lost executor then costs a
    reread, not a recomputation. ``drop`` deletes one that is no longer needed.
    """

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str, small: bool = False) -> DataFrame:
        """``small`` says that rows of a few numbers are written, a table much smaller than the texts.

        They go into one file a core of the cluster, not one a shuffle partition, and nothing is worth cleaning up before.
        """
        if small:
            df = df.coalesce(max(1, self.spark.sparkContext.defaultParallelism))
        else:
            self.release()
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def release(self) -> None:
        release(self.spark)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def side_by_side(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one task, one behind the other, for a function that runs over whole partitions.

    The rows are dealt by a hash of the keys, not by the keys: behind a join or an aggregate on the same keys Spark would leave
    the shuffle out, and adaptive execution may then read that join's rows in another order of partitions.
    """
    from pyspark.sql import functions as F

    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


try:
    _RELEASE = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _RELEASE = None


def trim() -> None:
    """Gives freed memory of a Python worker back: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _RELEASE is not None:
        _RELEASE(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", max_bytes: int = 2 << 20, max_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cuts incoming batches so that each holds about ``max_bytes`` of text, or one longer row: bounded memory."""
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        _, offsets = text_buffers(column)
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
            end = min(max(end, at + 1), at + max_rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
            count += 1
            if count % 32 == 0:
                trim()
    trim()


def binary_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over one buffer; offsets in bytes."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def append_columns(df: DataFrame, fn, fields: str, text: str = "text", max_bytes: int = 1 << 19) -> DataFrame:
    """Every row of ``df`` with further columns that ``fn(batch)`` returns as a list of Arrow arrays.

    Batches are cut by text bytes. Columns of ``df`` with the new names are replaced.
    """
    from pyspark.sql import functions as F

    added = df.sparkSession.createDataFrame([], fields).schema
    names = added.fieldNames()
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in names])
    schema = StructType([*kept.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, max_bytes):
            yield pa.RecordBatch.from_arrays([*batch.columns, *fn(batch)], names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


def id_remainder(column: str, divisor: int):
    """crc32 of the id as text modulo ``divisor``; a null id counts as the empty text."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor


def sample_rate(wanted: int, there: int) -> int:
    """Share of rows to keep, in 2^-20, so that about ``wanted`` of ``there`` stay."""
    return 1 << 20 if there <= wanted else max(1, (wanted << 20) // there)


def hash_share(column: str, seed: int):
    """A number below 2^20 drawn from a row's id: the same in every run and partitioning."""
    from pyspark.sql import functions as F

    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(1 << 20))
