"""Replay a batch feed through a stream: the registered ``stream_*`` queries.

The feed is written once, by as many tasks as it has, and the stream takes a third of the files per micro-batch until it is
through. A live job uses the ``start_*`` functions of ``streams`` on its own source instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from souk.session import scratch_dir


def replay(spark: SparkSession, name: str, feed: DataFrame, start: Callable[[DataFrame, str, str], StreamingQuery],
           files: int = 3) -> str:
    """Run ``start(stream, out, checkpoint)`` over the whole feed in ``files`` batches; returns the output folder."""
    base = scratch_dir(spark, name)
    feed.write.parquet(f"{base}/feed")
    written = spark.read.schema(feed.schema).parquet(f"{base}/feed")
    source, n = f"{base}/feed", len(written.inputFiles())
    if n < files:  # a small feed still comes in several batches
        source, n = f"{base}/source", files
        written.repartition(files).write.parquet(source)
    stream = spark.readStream.schema(feed.schema).option("maxFilesPerTrigger", -(-n // files)).parquet(source)
    query = start(stream, f"{base}/output", f"{base}/checkpoint")
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(f"stream {name} failed: {query.exception()}")
    return f"{base}/output"
