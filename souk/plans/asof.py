"""As-of join: each row with its key's latest version not after it, without one task per key.

Rows and versions are laid on one order axis, cut into ranges (``order_bucket``). Inside a (key, range) chunk a window carries the
last version forward; a row before its chunk's first version takes the last version of the key's earlier chunks, found over the chunk
table (at most as many rows a key as there are ranges).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from souk.plans.numbering import order_bucket


def values_as_of(rows: DataFrame, versions: DataFrame, keys: list[str], order_cols: list[str], value_cols: list[str],
                 buckets: int | None = None) -> DataFrame:
    """``rows`` with ``value_cols`` of the latest version of the same key whose order is not after the row's; NULL before the first.

    A version with a row's own order counts for it. Of versions with one key and order the one with the largest values counts.
    A NULL key meets no version."""
    axis = keys + order_cols
    side = F.struct(*value_cols).alias("__version")
    both = rows.select("*", F.lit(True).alias("__row")).unionByName(
        versions.select(*axis, side, F.lit(False).alias("__row")), allowMissingColumns=True)
    bucket = order_bucket(both.select(*order_cols), order_cols, buckets)
    both = both.withColumn("__chunk", F.lit(0) if bucket is None else bucket)
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order_cols, "__row", "__version").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__here", F.last("__version", ignorenulls=True).over(inside))
    ends = both.groupBy(*keys, "__chunk").agg(
        F.max_by("__version", F.when(~F.col("__row"), F.struct(*order_cols, "__version"))).alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*keys, "__chunk", F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    found = carried.filter("__row").join(before, keys + ["__chunk"], "left")
    version = F.coalesce("__here", "__before")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return found.select(*rows.columns, *[F.when(known, version[v]).alias(v) for v in value_cols])
