"""Helpers shared by the training-data operators: written tables, text batches, hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from souk.session import scratch_dir

#: Text bytes that one vectorised step works on; documents are never cut, so one long document may exceed it.
STEP_BYTES = 1 << 20

_U64 = np.uint64


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts the lineage (later jobs reread files, not Python), survives lost
    executors, and is compressed and column-wise, unlike an RDD checkpoint.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a ``materialise``d table that no later result reads."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_steps(batches: Iterator[pa.RecordBatch], column: str = "text",
               step_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slice record batches so that each slice holds about ``step_bytes`` of text; nulls become ''."""
    for batch in batches:
        i = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(i).cast(pa.large_string()), "")
        batch = batch.set_column(i, column, text)
        n = batch.num_rows
        if n == 0:
            continue
        ends = np.cumsum(np.asarray(pc.binary_length(text)).astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + step_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a non-null large_string array and its n + 1 offsets into them."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if len(column) == 0 or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over the whole range (a bijection)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U64(27))) * _U64(0x94D049BB133111EB)
        return h ^ (h >> _U64(31))


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    return out + np.repeat(starts - (ends - lengths), lengths)
