"""Money and rating arithmetic, exact in decimals.

One totals formula serves order totals (A1), cart quotes (A2) and checkout
(M5): subtotal = sum(quantity * price); tax = round(subtotal * rate, 2) with
half-away-from-zero rounding; total = subtotal + fee + tax.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.sources.schema import MONEY, RATING

# Fixed values of the pricing rule and display defaults.
DELIVERY_FEE = Decimal("10.00")
TAX_RATE = Decimal("0.05")
INVOICE_PREFIX = "INV-"
INVOICE_MIN_DIGITS = 4
DEFAULT_IMAGE = "assets/images/products/blue_bow_blouse.jfif"


def money(c: Column) -> Column:
    return c.cast(MONEY)


def line_amount(quantity: Column, price: Column) -> Column:
    """quantity * unit price, exact (int widened to decimal, never float)."""
    return quantity.cast("decimal(12,0)") * price


def line_cents(quantity: Column, price: Column) -> Column:
    """quantity * unit price in whole cents, as a long (exact)."""
    return quantity.cast("long") * (price * 100).cast("long")


def sum_of_lines(quantity: Column, price: Column) -> Column:
    """Exact sum of line amounts for one order or one cart, as MONEY.

    Summed in long cents, which keeps the aggregation buffer a primitive
    instead of a BigDecimal. A long holds 92 quadrillion currency units, far
    above any single order or cart; store-wide sums use ``sum`` on MONEY.
    """
    return money(F.sum(line_cents(quantity, price)).cast("decimal(38,0)") / F.lit(100))


def tax(subtotal: Column, rate: Decimal = TAX_RATE) -> Column:
    return money(F.round(subtotal * F.lit(rate), 2))


def with_totals(df: DataFrame, subtotal_col: str = "subtotal", fee: Decimal = DELIVERY_FEE,
                rate: Decimal = TAX_RATE) -> DataFrame:
    """Add delivery_fee, tax_amount and total_amount from an existing subtotal column.

    The subtotal is computed once (it appears three times in the SQL view).
    """
    return (df.withColumn(subtotal_col, money(F.col(subtotal_col)))
              .withColumn("delivery_fee", money(F.lit(fee)))
              .withColumn("tax_amount", tax(F.col(subtotal_col), rate))
              .withColumn("total_amount",
                          money(F.col(subtotal_col) + F.col("delivery_fee") + F.col("tax_amount"))))


def half_up_quotient(num_sql: str, den_sql: str) -> Column:
    """round(num / den) half up, for non-negative exact operands, as a long.

    Integral ``div`` on decimals is exact, so no intermediate rounding can
    push a value across a half boundary.
    """
    return F.expr(f"(2 * ({num_sql}) + ({den_sql})) div (2 * ({den_sql}))")


def average_rating(sum_col: str, count_col: str) -> Column:
    """Average of integer ratings to 2 places, half up; 0 when there are none."""
    cents = half_up_quotient(f"100 * cast({sum_col} as decimal(38,0))", f"cast({count_col} as decimal(38,0))")
    return F.when(F.expr(count_col) > 0, (cents.cast("decimal(38,0)") / F.lit(100)).cast(RATING)) \
            .otherwise(F.lit(0).cast(RATING))


def average_money(sum_col: str, count_col: str) -> Column:
    """Average of money values to the cent, half up; 0 on empty input."""
    cents = half_up_quotient(f"cast({sum_col} * 100 as decimal(38,0))", f"cast({count_col} as decimal(38,0))")
    return F.when(F.expr(count_col) > 0, money(cents.cast("decimal(38,0)") / F.lit(100))) \
            .otherwise(money(F.lit(0)))


def invoice_number(order_id: Column) -> Column:
    """'INV-' + id left-padded to at least 4 digits; longer ids are not cut."""
    s = order_id.cast("string")
    width = F.greatest(F.lit(INVOICE_MIN_DIGITS), F.length(s))
    return F.concat(F.lit(INVOICE_PREFIX), F.lpad(s, width, "0"))
