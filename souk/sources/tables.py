"""The ``Tables`` holder and typed loading of marketplace tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.sources.schema import RETIRED_COLUMNS, SCHEMAS, TABLE_NAMES


class Tables:
    """One DataFrame per marketplace base table. Immutable: jobs return new state.

    A table may be given as a zero-argument builder; it is built on first
    access, so a job that reads three tables never plans the other seven.
    """

    __slots__ = ("_src", "extras")

    def __init__(self, extras: dict | None = None, **tables):
        unknown = set(tables) - set(TABLE_NAMES)
        if unknown:
            raise TypeError(f"unknown tables: {sorted(unknown)}")
        missing = set(TABLE_NAMES) - set(tables)
        if missing:
            raise TypeError(f"missing tables: {sorted(missing)}")
        object.__setattr__(self, "_src", dict(tables))
        object.__setattr__(self, "extras", dict(extras or {}))

    def __getattr__(self, name: str) -> DataFrame:
        src = object.__getattribute__(self, "_src")
        if name not in src:
            raise AttributeError(name)
        value = src[name]
        if not isinstance(value, DataFrame):
            value = value()
            src[name] = value
        return value

    def __setattr__(self, name, value):
        raise AttributeError("Tables is immutable; use with_()")

    def with_(self, extras: dict | None = None, **changes) -> "Tables":
        src = dict(object.__getattribute__(self, "_src"))
        src.update(changes)
        rows = {n: f for n, f in self.extras.get("rows", {}).items() if n not in changes}
        return Tables(extras={**self.extras, "rows": rows, **(extras or {})}, **src)

    def rows(self, name: str) -> int:
        """Rows of a table: a bound that its source knows (``extras["rows"]``), else counted."""
        known = self.extras.get("rows", {}).get(name)
        return known() if known else getattr(self, name).count()

    def items(self):
        for name in TABLE_NAMES:
            yield name, getattr(self, name)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select the declared columns in order, cast to the declared types.

    Retired columns (schema migrations dropped them) and any column not in the
    schema are left out, so a password column is never carried along.
    """
    schema = SCHEMAS[name]
    present = set(df.columns)
    cols = []
    for f in schema.fields:
        if f.name in present:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def load_tables(spark: SparkSession, path: str) -> Tables:
    """Read marketplace tables stored as ``{path}/{table}`` parquet under their declared schemas.

    Nothing is inferred: columns outside the schema (a password, retired ones) are never read, missing ones are NULL,
    and files whose column has a type that does not read as the declared one raise an error when they are read
    (``quality.check_schema`` lists such columns beforehand)."""
    return Tables(**{name: spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}").select(SCHEMAS[name].names)  # no folder columns
                     for name in TABLE_NAMES})


def write_tables(t: Tables, path: str, mode: str = "errorifexists") -> None:
    """Write every table to a new location. State is never overwritten in place (snapshot swap)."""
    for name, df in t.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def register_views(spark: SparkSession, t: Tables) -> None:
    """Expose base tables and the reference's named views as temp views."""
    from souk.operators import catalog, reports

    for name, df in t.items():
        df.createOrReplaceTempView(name)
    reports.order_totals(t).createOrReplaceTempView("order_totals_view")
    catalog.product_catalog(t).createOrReplaceTempView("product_catalog_view")
    catalog.product_catalog_full(t).createOrReplaceTempView("product_catalog_full_view")
    reports.seller_sales(t).createOrReplaceTempView("seller_sales_view")
    reports.seller_revenue(t).createOrReplaceTempView("seller_revenue_view")
    reports.daily_sales(t).createOrReplaceTempView("admin_sales_report_view")


def retired_columns_present(df: DataFrame, name: str) -> list[str]:
    return [c for c in RETIRED_COLUMNS.get(name, ()) if c in df.columns]
