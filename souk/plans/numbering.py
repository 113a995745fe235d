"""Distributed running sums and row numbering without a single-partition window.

A window ``partitionBy(k).orderBy(seq)`` puts every row of a key in one
task, and an unpartitioned window puts the whole table in one task. Both
break when one key holds a large share of the rows. Here the order key is
cut into contiguous ranges (quantile buckets), so a running sum becomes:

  running(row) = running sum inside its (key, bucket) chunk
               + sum of the totals of the same key's earlier buckets

The chunk windows are bounded by the bucket size; the chunk-total table has
at most (keys x buckets) rows, and each key's prefix over it is at most
``buckets`` rows long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.session import written

#: Buckets of a keyed running sum at most: every row compares its key with each bucket's bound.
MAX_BUCKETS = 512


def default_buckets(spark) -> int:
    """As many buckets as the session has shuffle partitions, between 8 and ``MAX_BUCKETS``: a hot key uses the whole cluster."""
    return min(MAX_BUCKETS, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _numeric_key(df: DataFrame, col: str) -> Column | None:
    """A double that orders like ``col``, or None for types without one."""
    name = df.schema[col].dataType.typeName()
    if name in ("long", "integer", "short", "byte", "double", "float", "decimal"):
        return F.col(col).cast("double")
    if name in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    if name == "date":
        return F.unix_date(F.col(col)).cast("double")
    return None


def order_bucket(df: DataFrame, order_cols: str | list[str], buckets: int | None = None,
                 rel_error: float = 0.001) -> Column | None:
    """Monotone bucket number of the order key, from approximate quantiles (one numeric column) or a sample (any other key).

    The key may be a tuple of columns of any orderable types: a constant first column or a text key spreads as well.
    The bounds that reach the driver are ``buckets - 1`` keys. Any monotone bucketing gives correct running sums; the
    bounds only balance the work. Returns None when there is nothing to cut (an empty table, one bucket).
    """
    cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    buckets = buckets or default_buckets(df.sparkSession)
    if buckets <= 1:
        return None
    key = _numeric_key(df, cols[0]) if len(cols) == 1 else None
    if key is not None:
        probs = [i / buckets for i in range(1, buckets)]
        bounds = sorted(set(df.select(key.alias("k")).approxQuantile("k", probs, rel_error)))
        if not bounds:
            return None
        arr = F.array(*[F.lit(float(b)) for b in bounds])
        return F.size(F.filter(arr, lambda b: b <= key))
    rows = df.count()
    if rows == 0:
        return None
    keys = df.select(*cols).sample(min(1.0, 20 * buckets / rows), seed=11)
    ranked = keys.orderBy(*cols).limit(40 * buckets).collect()
    picked = ranked[len(ranked) // buckets::max(1, len(ranked) // buckets)][:buckets - 1]
    if not picked:
        return None
    kinds = [df.schema[c].dataType for c in cols]
    row = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(cols)])
    bounds = [F.struct(*[F.lit(v).cast(k).alias(f"_{i}") for i, (v, k) in enumerate(zip(r, kinds))]) for r in picked]
    return F.size(F.filter(F.array(*bounds), lambda b: b <= row))


def running_sums(df: DataFrame, keys: list[str], order_cols: list[str], values: dict[str, Column],
                 inclusive: bool = False, buckets: int | None = None,
                 bucket: Column | None = None) -> DataFrame:
    """Add one running-sum column per ``values`` entry, per ``keys``, in ``order_cols`` order.

    ``order_cols`` must give a total order within each key. ``inclusive``
    includes the current row. Null values count as 0.
    """
    frame = (Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    if bucket is None and buckets != 1:
        bucket = order_bucket(df, order_cols, buckets)
    if bucket is None:
        w = (Window.partitionBy(*keys) if keys else Window).orderBy(*order_cols).rowsBetween(*frame)
        for name, v in values.items():
            df = df.withColumn(name, F.coalesce(F.sum(v).over(w), F.lit(0)))
        return df
    b = "__bucket"
    df = df.withColumn(b, bucket)
    part = keys + [b]
    w = Window.partitionBy(*part).orderBy(*order_cols).rowsBetween(*frame)
    staged = df
    for name, v in values.items():
        staged = staged.withColumn(f"__in_{name}", F.coalesce(F.sum(v).over(w), F.lit(0)))
    totals = df.groupBy(*part).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"__tot_{n}")
                                     for n, v in values.items()])
    wb = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1) if keys else \
        Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, *[F.coalesce(F.sum(f"__tot_{n}").over(wb), F.lit(0)).alias(f"__off_{n}")
                                     for n in values])
    if not keys:
        # The offset table has one row per bucket: its size is the bucket count.
        offsets = F.broadcast(offsets)
    else:
        offsets = offsets.hint("merge")  # a row a key and bucket: too many for the driver to broadcast
    out = staged.join(offsets, part, "left")
    for n in values:
        out = out.withColumn(n, F.col(f"__in_{n}") + F.coalesce(F.col(f"__off_{n}"), F.lit(0)))
    drop = [b] + [f"__in_{n}" for n in values] + [f"__off_{n}" for n in values]
    return out.drop(*drop)


def number_rows(df: DataFrame, order_col: str | list[str], out_col: str, start: int | Column = 1) -> DataFrame:
    """Consecutive numbers ``start, start+1, ...`` in a total order, computed in parallel.

    The rows are range-partitioned on the whole key (any orderable types) and written with their range's number; ranges
    are counted, and each row's number is its place in its range plus the rows of the ranges before. There are as
    many ranges as shuffle partitions. ``out_col`` is null nowhere; equal keys are numbered in any order.
    """
    order_cols = [order_col] if isinstance(order_col, str) else list(order_col)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order_cols).withColumn("__range", F.spark_partition_id())
    dealt = written(dealt, "number-rows")
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = dealt.groupBy("__range").count().select("__range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__off"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order_cols))
    start_col = start if isinstance(start, Column) else F.lit(start)
    return dealt.withColumn("__rn", inside).join(F.broadcast(offsets), "__range") \
        .withColumn(out_col, (F.col("__rn") + F.col("__off") - 1 + start_col).cast("bigint")).drop("__range", "__rn", "__off")


def previous_values(df: DataFrame, keys: list[str], order_cols: list[str], value_cols: list[str],
                    buckets: int | None = None, bucket: Column | None = None,
                    prefix: str = "prev_") -> DataFrame:
    """``lag(value)`` per key in ``order_cols`` order, without one task per key.

    Inside a (key, bucket) chunk the previous row comes from a window; the
    first row of a chunk takes the last row of the key's nearest earlier
    non-empty chunk, found over the chunk table (at most ``buckets`` rows per
    key).
    """
    if bucket is None:
        bucket = order_bucket(df, order_cols, buckets)
    if bucket is None:
        w1 = Window.partitionBy(*keys).orderBy(*order_cols)
        return df.select("*", *[F.lag(v).over(w1).alias(f"{prefix}{v}") for v in value_cols])
    b = "__pb"
    df = df.withColumn(b, bucket)
    w = Window.partitionBy(*keys, b).orderBy(*order_cols)
    staged = df.select("*", F.row_number().over(w).alias("__rn"),
                       *[F.lag(v).over(w).alias(f"__lag_{v}") for v in value_cols])
    last = df.groupBy(*keys, b).agg(F.max_by(F.struct(*value_cols), F.struct(*order_cols)).alias("__last"))
    wb = Window.partitionBy(*keys).orderBy(b)
    prev_chunk = last.select(*keys, b, F.lag("__last").over(wb).alias("__prev"))
    out = staged.join(prev_chunk, keys + [b], "left")
    for v in value_cols:
        out = out.withColumn(f"{prefix}{v}", F.when(F.col("__rn") == 1, F.col(f"__prev.{v}"))
                             .otherwise(F.col(f"__lag_{v}")))
    return out.drop(b, "__rn", "__prev", *[f"__lag_{v}" for v in value_cols])
