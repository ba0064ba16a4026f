"""What the operators share: intermediate tables, Arrow batches and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField

#: Bytes of a side that may be broadcast; beyond it the join shuffles both sides.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that a numpy pass looks at together (a single longer text is its own pass).
PASS_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that all machines share. Where none is named, one of our own, but only on a
    single machine (tests)."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not named and context._jsc.sc().getCheckpointDir().isDefined():
        named = context._jsc.sc().getCheckpointDir().get()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        named = f"file://{os.path.join(tempfile.gettempdir(), 'lodeframe-shared')}"
    return f"{named}/{context.applicationId}"


#: Folders of the intermediate tables that are there, in the order they were made.
_KEPT: dict[str, None] = {}
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Whether shuffle files go when the query that made them ends; else they stay until the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def clear_kept(spark: SparkSession) -> None:
    """Remove the intermediate tables that this process has written and not removed yet. Only once no result that reads
    them is needed any more."""
    for path in list(_KEPT):
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    files, place = file_system(spark, path)
    files.delete(place, True)
    _KEPT.pop(path, None)


class Scope:
    """At the end of `with`, intermediate tables made inside are removed, but for spared ones, and the session's batch size
    is what it was. Results must be written before that."""

    def __init__(self, spark: SparkSession):
        self.spark, self.spared = spark, set()

    def __enter__(self) -> Scope:
        self.before, self.rows = set(_KEPT), self.spark.conf.get(BATCH_ROWS)
        return self

    def spare(self, kept: Kept) -> Kept:
        self.spared.add(kept.path)
        return kept

    def __exit__(self, *_) -> None:
        for path in [p for p in _KEPT if p not in self.before | self.spared]:
            remove(self.spark, path)
        self.spark.conf.set(BATCH_ROWS, self.rows)


class Kept:
    """An intermediate table written to the shared folder: cuts lineage, survives lost executors, and is computed once.

    What a lazy result still reads can't be dropped by its maker; the application's folder goes when the driver ends."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        folder = shared_dir(self.spark)
        self.path = f"{folder}/{tag}-{uuid.uuid4().hex}"
        if not _KEPT:
            files, place = file_system(self.spark, folder)
            files.mkdirs(place)
            files.deleteOnExit(place)
        _KEPT[self.path] = None
        before = self.spark.conf.get(CLEAN_UP, "false")
        self.spark.conf.set(CLEAN_UP, "true")  # nothing reads them once the table is written
        try:
            df.write.option("compression", "zstd").parquet(self.path)
        finally:
            self.spark.conf.set(CLEAN_UP, before)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Remove the files. Only once nothing lazy reads them any more."""
        remove(self.spark, self.path)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, so that long texts don't pile up in a Python worker. Plans read the setting when they run,
    so it stays lowered until a Scope ends or the caller sets it."""
    if not 0 < int(spark.conf.get(BATCH_ROWS)) <= rows:
        spark.conf.set(BATCH_ROWS, str(rows))


#: In a worker: the operator whose tasks it serves, and what empties the memos that they leave for the next ones.
_SERVED: dict[str, Callable[[], None] | None] = {}


def serve(operator: str, forget: Callable[[], None] | None = None) -> None:
    """To be called in a worker when a task of operator begins. Workers outlive stages: at the first task of another operator,
    the last one's memos and the memory that it has freed go back to the system, else they lie beside the new one's."""
    if operator not in _SERVED:
        for last in _SERVED.values():
            if last:
                last()
        give_back()
        _SERVED.clear()
    _SERVED[operator] = forget


def give_back() -> None:
    """Memory that this process has freed goes back to the system (where the C library can do so)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def width(field: StructField) -> Column:
    """Bytes of a value, roughly."""
    name, kind = F.col(field.name), field.dataType
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        inner = F.octet_length(F.array_join(name, "")) + F.size(name) * 16 if isinstance(kind.elementType, StringType) else F.size(name) * (8 * len(getattr(kind.elementType, "fields", "x")) + 8)
        return F.coalesce(inner, F.lit(0)) + 16
    return F.lit(8)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its measured bytes are few enough; else as it is, for a shuffle join. df should be cheap to
    read (a written table)."""
    bytes_ = df.agg(F.sum(sum((width(f) for f in df.schema.fields), F.lit(16)).cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if bytes_ <= limit else df


def passes(column: pa.Array, limit: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column with about limit bytes each."""
    ends = offsets_of(column)
    row, n = 0, len(column)
    while row < n:
        stop = int(np.searchsorted(ends, ends[row] + limit, side="right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, stop
        row = stop


def offsets_of(column: pa.Array) -> np.ndarray:
    """Byte offsets (n + 1) of a string array into its data buffer."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(1, np.int64)
    raw = np.frombuffer(column.buffers()[1], kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def bytes_of(column: pa.Array) -> np.ndarray:
    """The whole data buffer of a string array."""
    data = column.buffers()[2] if len(column) else None
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def texts_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with nulls as empty texts."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.fill_null("") if column.null_count else column


def crc_fold(doc_id, k: int = 3):
    """crc32 of the id's decimal text, modulo k. Null ids count as the text 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % k
