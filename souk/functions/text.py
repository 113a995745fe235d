"""Text rules of the reference's form handling, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters PHP's trim() removes, and the field-length limits.
PHP_TRIM_CLASS = r"[ \t\n\r\x00\x0B]"
EMAIL_MAX = 100
PHONE_DIGITS = (10, 15)
CARD_DIGITS = (13, 19)
EMAIL_LOCAL_MAX, EMAIL_LABEL_MAX = 64, 63
# Email shape accepted by the contact check: dot-separated atoms @ dot-separated host labels (no quoted local parts).
_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
_LABEL = rf"[A-Za-z0-9](?:[A-Za-z0-9-]{{0,{EMAIL_LABEL_MAX - 2}}}[A-Za-z0-9])?"
EMAIL_PATTERN = rf"^(?=[^@]{{1,{EMAIL_LOCAL_MAX}}}@){_ATOM}(?:\.{_ATOM})*@{_LABEL}(?:\.{_LABEL})+$"
# Leading number of a text, as an (int) cast reads it.
_LEADING_NUMBER = r"^[ \t\n\r\x0B\f]*([+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def php_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{PHP_TRIM_CLASS}+|{PHP_TRIM_CLASS}+$", "")


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"\D+", "")


def collapse_ws(c: Column) -> Column:
    """Trim, then collapse every whitespace run to one space (phone normalizing)."""
    return F.regexp_replace(php_trim(c), r"\s+", " ")


def php_int(c: Column) -> Column:
    """(int) cast of form text, as a long: the leading number, cut at the decimal point; 0 for NULL and for text without one.

    Numbers beyond 64 bits become the largest or smallest long."""
    text = F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), _LEADING_NUMBER, 1)
    number = text.try_cast("double")
    least, most = -(2**63), 2**63 - 1
    cut = F.when(number >= F.lit(float(2**63)), F.lit(most)).when(number <= F.lit(float(least)), F.lit(least)) \
        .otherwise(number.try_cast("long"))
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("long")), cut, F.lit(0).cast("long"))


def fits_int(c: Column) -> Column:
    """Whether a long fits an INT column."""
    return c.between(-(2**31), 2**31 - 1)


def name_key(c: Column) -> Column:
    """A text as the database compares names: blind to case, accents and trailing blanks. Equality, grouping and joins follow it."""
    return c.cast("string collate UNICODE_CI_AI_RTRIM")


def email_valid(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL_PATTERN) & (F.length(c) <= EMAIL_MAX), F.lit(False))


def phone_valid(c: Column) -> Column:
    n = F.length(digits_only(c))
    return F.coalesce(n.between(*PHONE_DIGITS), F.lit(False))


def luhn_valid(c: Column) -> Column:
    """13-19 digits after stripping non-digits, and the Luhn checksum is 0 mod 10."""
    d = digits_only(c)
    rev = F.split(F.reverse(d), "")

    def weigh(x, i):
        v = x.try_cast("int")
        doubled = v * 2
        return F.when(i % 2 == 1, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(v)

    total = F.aggregate(F.transform(rev, weigh), F.lit(0), lambda acc, x: acc + x)
    return F.coalesce(F.length(d).between(*CARD_DIGITS) & (total % 10 == 0), F.lit(False))


def ts_literal(value) -> Column:
    """A wall-clock timestamp literal, independent of any time zone."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
