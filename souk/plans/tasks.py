"""How many tasks a shuffle of a table gets: enough that a task's sorts and hash maps stay bounded as the table grows.

Without a number the adaptive planner merges shuffle partitions up to a size in compressed bytes, or down to the number of cores.
Narrow rows of whole numbers pack so well that one task then holds many millions of them, and its memory grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that a task sorts or groups, on average; about 100 bytes a row and operator.
TASK_ROWS = 500_000
#: Up to so many times ``TASK_ROWS`` the planner may merge partitions as it likes.
SMALL = 4


def tasks_for(rows: int, task_rows: int = TASK_ROWS) -> int | None:
    """Partitions for ``rows`` rows, or None for a small table, where the planner decides."""
    return -(-rows // task_rows) if rows > SMALL * task_rows else None


def dealt(df: DataFrame, rows: int, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` hash-partitioned by ``keys`` into tasks of about ``task_rows`` rows; ``rows`` is its number of rows or a bound of it."""
    n = tasks_for(rows, task_rows)
    return df.repartition(*keys) if n is None else df.repartition(n, *keys)


def spread(df: DataFrame, rows: int, *keys: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``dealt`` for a large table; a small one is left as it is, for the planner to shuffle where it has to."""
    return df if tasks_for(rows, task_rows) is None else dealt(df, rows, *keys, task_rows=task_rows)


def looked_up(df: DataFrame, keys: DataFrame, column: str, how: str, rows: int, key_rows: int) -> DataFrame:
    """``df`` joined (left, semi or anti) with the ids ``keys``; small tables are left to the planner.

    In a large one each task holds its share of the keys and the rows stream past it: nothing is sorted, whatever the rows of a key,
    and the joins of a chain do not add their sorts up in one task."""
    if tasks_for(max(rows, key_rows)) is None:
        return df.join(keys, column, how)
    return df.join(spread(keys, key_rows, column).hint("shuffle_hash"), column, how)
