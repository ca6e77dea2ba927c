"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import json
import os
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from loanroll.session import scratch_dir

#: Rows that one Arrow batch brings to a Python worker at most: long texts make few rows large.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size where it is larger or unbounded."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, partition_by: tuple[str, ...] = (), codec: str = "zstd") -> DataFrame:
    """Write a table to the shared scratch folder and read it again: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``staged``, with the folder, for tables that are deleted when nothing reads them any more."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release_shuffles(spark: SparkSession) -> None:
    """Ask the driver to let go of frames that nobody holds: Spark deletes their shuffles, which it would keep for
    half an hour else. A frame's plan is released by one collection, its shuffles are found by a later one."""
    gc.collect()
    for _ in range(3):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def returns_memory(run: Callable) -> Callable:
    """A function of a stream of batches that gives freed memory back to the system when its task ends.

    Workers live on for other tasks, and the C library would keep what a task has freed.
    """
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
        if trim:
            trim(0)
    return wrapped


def texts_as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null counts as the empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def tokenizer_source(spark: SparkSession, path: str, special: tuple[str, ...] = ()) -> Broadcast:
    """The tokenizer file's content (a vocabulary file: a few MB whatever the data), plus control strings to add."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(json.dumps({"file": f.read(), "special": list(special)}))


_TOKENIZERS: dict[int, object] = {}


def load_tokenizer(source: Broadcast):
    """The worker's own copy of a broadcast tokenizer, built once per Python worker."""
    key = hash(source.value)
    if key not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        spec = json.loads(source.value)
        tok = Tokenizer.from_str(spec["file"])
        tok.no_truncation()
        tok.no_padding()
        if spec["special"]:
            tok.add_special_tokens(spec["special"])
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = tok
    return _TOKENIZERS[key]


def list_column(lists: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from NumPy arrays, without a Python object per element."""
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    values = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(kind.to_pandas_dtype(), copy=False), kind))


def list_slices(column: pa.ListArray) -> Iterator[np.ndarray]:
    """NumPy views of each list of an Arrow list column; a null counts as the empty list."""
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    for i in range(len(column)):
        yield values[offsets[i]:offsets[i + 1]]


def ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... (sizes[0] numbers), then those of begins[1], and so on."""
    sizes = sizes.astype(np.int64)
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(begins.astype(np.int64) - (np.cumsum(sizes) - sizes), sizes)
