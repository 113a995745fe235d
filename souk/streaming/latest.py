"""A keyed table that a stream keeps current: the newest row per key, in bounded files.

Every micro-batch writes its changed rows under its batch id (a replayed batch overwrites its own files).
Every ``compact_every`` batches the rows of all earlier batches are merged into one base and their files deleted, so a reader opens
one base and a few deltas, however long the stream has run, and a replayed batch can read the state before it. One stream writes one table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LatestTable:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], partition_by: list[str] | None = None,
                 compact_every: int = 20):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), keys
        self.partition_by, self.compact_every = partition_by or [], compact_every
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _finished(self, kind: str) -> list[int]:
        """Ids of complete ``base`` or ``delta`` folders; a folder counts once its _SUCCESS file is there."""
        folder = self._path(f"{self.root}/{kind}")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        ids = [int(m[1]) for m in map(re.compile(r"b(\d+)$").match, names) if m]
        return sorted(i for i in ids if self._fs.exists(self._path(f"{self.root}/{kind}/b{i}/_SUCCESS")))

    def _live(self, upto: int | None = None) -> list[tuple[int, str]]:
        keep = lambda i: upto is None or i <= upto
        base = [i for i in self._finished("base") if keep(i)][-1:]
        deltas = [i for i in self._finished("delta") if keep(i) and (not base or i > base[0])]
        return [(i, f"{self.root}/base/b{i}") for i in base] + [(i, f"{self.root}/delta/b{i}") for i in deltas]

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Take the batch's rows (one per key) as the newest; call it from ``foreachBatch``."""
        rows.write.mode("overwrite").partitionBy(*self.partition_by).parquet(f"{self.root}/delta/b{batch_id}")
        if (batch_id + 1) % self.compact_every == 0 and batch_id > 0:  # a replayed batch still finds the state before it
            last = batch_id - 1
            merged = self.read(rows.schema, last)
            if self.partition_by:
                merged = merged.repartition(*self.partition_by)
            merged.write.mode("overwrite").partitionBy(*self.partition_by).parquet(f"{self.root}/base/b{last}")
            for kind in ("base", "delta"):
                for i in self._finished(kind):
                    if i < last or kind == "delta" and i == last:
                        self._fs.delete(self._path(f"{self.root}/{kind}/b{i}"), True)

    def read(self, schema, upto: int | None = None) -> DataFrame:
        """The newest row of every key, as of batch ``upto`` (the last one by default)."""
        cols = schema.fieldNames()
        parts = [self.spark.read.schema(schema).parquet(path).select(*cols, F.lit(i).alias("__batch"))
                 for i, path in self._live(upto)]
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        others = [c for c in cols if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "__batch").alias("__row"))
        return newest.select(*[F.col(c) if c in self.keys else F.col(f"__row.{c}").alias(c) for c in cols])
