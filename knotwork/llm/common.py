"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.session import cut, shared_dir, ship_package

__all__ = ["WHITE", "cut", "digest_input", "folds", "prepare", "shared_dir", "slices", "strip_white", "table", "tidy", "unlike", "utf8_buffers"]

#: The white space of every contract here: space and tab to carriage return.
WHITE = " \t\n\x0b\x0c\r"
#: Bytes of text that one Arrow batch sent to Python may hold; with whole texts, a batch is bounded by bytes and not by rows.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that bound the memory of Python workers; the package goes to the executors."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    shared_dir(spark)
    ship_package(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest_input(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id long, text string)`` alone: other columns, also ones with clashing names, never travel. Null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _tidy(batches, f):
    try:
        yield from f(batches)
    finally:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library: it keeps what it freed
            return


def tidy(f):
    """``f`` for ``mapInArrow``; Python workers live on after a task, so what it freed goes back to the system at its end."""
    return partial(_tidy, f=f)


def unlike(df: DataFrame, *names: str) -> list[str]:
    """Names for own columns beside those of ``df``, whatever these are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def strip_white(c: Column) -> Column:
    return F.translate(c, WHITE, "")


def folds(c: Column) -> Column:
    """crc32 of the id written as text, modulo 5; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def utf8_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rebased to 0) of a string or binary array; nulls are empty."""
    if arr.null_count:
        arr = arr.fill_null(b"" if pa.types.is_binary(arr.type) or pa.types.is_large_binary(arr.type) else "")
    large = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    n = len(arr)
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64 if large else np.int32)[arr.offset : arr.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20):
    """Cut a batch so that each part holds about ``most`` bytes of ``column`` (a longer single text is a part of its own)."""
    _, offs = utf8_buffers(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
