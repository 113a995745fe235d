"""Deletes along the foreign keys (M9): the rows that go, the references that become NULL.

The graph of ``FOREIGN_KEYS`` is walked parents first. A table is scanned once, whatever the number of keys that reach it:
each key joins the parent's deleted ids as a mark, and the marks decide what becomes of the row.
"""

from __future__ import annotations

from functools import reduce
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.plans.tasks import looked_up
from souk.sources.schema import CASCADE, FOREIGN_KEYS, SUMMARY_KEY
from souk.sources.tables import Tables

ForeignKey = tuple[str, str, str, str]
DELETED, SET_NULL_EFFECT = "deleted", "set null"


def _frame(t: Tables, name: str) -> DataFrame:
    return t.extras[name] if name in t.extras else getattr(t, name)


def _rows(t: Tables, name: str) -> int:
    return t.rows("products") if name == "rating_summary" else t.rows(name)  # the summary has a row a product


def _id(name: str) -> str:
    return SUMMARY_KEY if name == "rating_summary" else "id"


def _keys(t: Tables) -> tuple[ForeignKey, ...]:
    """The declared keys, and the stored rating summary's where the tables hold one."""
    stored = t.extras.get("rating_summary") is not None
    return FOREIGN_KEYS + ((("rating_summary", SUMMARY_KEY, "products", CASCADE),) if stored else ())


def reached(table: str, keys: tuple[ForeignKey, ...]) -> tuple[list[str], set[str]]:
    """The tables a delete from ``table`` can touch, parents first, and those of them that can lose rows.

    Keys that form a circle have no such order: ``graphlib.CycleError``."""
    losing = {table}
    while grown := {child for child, _, parent, action in keys if parent in losing and action == CASCADE} - losing:
        losing |= grown
    touched = losing | {child for child, _, parent, _ in keys if parent in losing}
    graph = {n: {parent for child, _, parent, _ in keys if child == n and parent in losing} for n in sorted(touched)}
    return list(TopologicalSorter(graph).static_order()), losing


class _Marked:
    """A table's rows with a mark column for each way the delete reaches them (true or null)."""

    def __init__(self, name: str, rows: DataFrame, n_rows: int):
        self.name, self.rows, self.columns, self.n_rows = name, rows, rows.columns, n_rows
        self.delete_marks: list[str] = []
        self.null_marks: dict[str, str] = {}

    def mark(self, column: str, dead: DataFrame, dead_rows: int, deletes: bool) -> None:
        """``dead``: distinct ids, ``dead_rows`` at most."""
        mark = f"__reached_{len(self.delete_marks)}_{len(self.null_marks)}"
        dead = dead.select(F.col("id").alias(column), F.lit(True).alias(mark))
        self.rows = looked_up(self.rows, dead, column, "left", self.n_rows, dead_rows)
        if deletes:
            self.delete_marks.append(mark)
        else:
            self.null_marks[column] = mark

    def gone(self) -> Column:
        return F.coalesce(*[F.col(m) for m in self.delete_marks], F.lit(False))

    def dead_ids(self) -> DataFrame:
        return self.rows.filter(self.gone()).select(F.col(_id(self.name)).alias("id")).distinct()

    def kept(self) -> DataFrame:
        return self.rows.filter(~self.gone()).select(*[
            F.when(F.col(self.null_marks[c]).isNull(), F.col(c)).alias(c) if c in self.null_marks else F.col(c) for c in self.columns])

    def effects(self) -> list[DataFrame]:
        def rows(of: Column, effect: str, column: str | None) -> DataFrame:
            return self.rows.filter(of).select(
                F.lit(self.name).alias("table_name"), F.col(_id(self.name)).cast("bigint").alias("record_id"),
                F.lit(effect).alias("effect"), F.lit(column).cast("string").alias("column_name"))

        deleted = [rows(self.gone(), DELETED, None)] if self.delete_marks else []
        return deleted + [rows(~self.gone() & F.col(m), SET_NULL_EFFECT, c) for c, m in self.null_marks.items()]


def _closure(t: Tables, table: str, ids: DataFrame, keys: tuple[ForeignKey, ...] | None) -> list[_Marked]:
    keys = _keys(t) if keys is None else keys
    order, losing = reached(table, keys)
    dead: dict[str, DataFrame] = {}
    out = []
    for name in order:
        m = _Marked(name, _frame(t, name), _rows(t, name))
        if name == table:
            m.mark(_id(name), ids.select("id").distinct(), _rows(t, name), deletes=True)
        for child, column, parent, action in keys:
            if child == name and parent in dead:
                m.mark(column, dead[parent], _rows(t, parent), deletes=action == CASCADE)
        if name in losing:
            dead[name] = m.dead_ids()
        out.append(m)
    return out


def cascade_delete(t: Tables, table: str, ids: DataFrame, keys: tuple[ForeignKey, ...] | None = None) -> Tables:
    """M9. The tables after the rows of ``table`` with the given ids (column ``id``) are deleted.

    Child rows go with their parents, to any depth; a reference whose key is SET NULL becomes NULL. Ids that are NULL, repeated
    or unknown delete nothing more. Any table and any number of ids; ``keys`` replaces the declared foreign keys."""
    changed = {m.name: m.kept() for m in _closure(t, table, ids, keys)}
    extras = {n: changed.pop(n) for n in list(changed) if n in t.extras}
    return t.with_(extras=extras, **changed)


def cascade_rows(t: Tables, table: str, ids: DataFrame, keys: tuple[ForeignKey, ...] | None = None) -> DataFrame:
    """M9. What ``cascade_delete`` does, one row an effect: (table_name, record_id, effect, column_name).

    ``effect`` is "deleted" (no column) or "set null" (the column that lost its reference). A row that several keys reach is
    deleted once, and one that is deleted has no reference set to NULL."""
    return reduce(DataFrame.unionByName, [e for m in _closure(t, table, ids, keys) for e in m.effects()])
