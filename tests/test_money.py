"""Exact money and rating arithmetic against Python Decimal (half away from zero)."""

import random
from decimal import ROUND_HALF_UP, Decimal as D

from pyspark.sql import functions as F

from souk.functions.money import average_money, average_rating, sum_of_lines, tax, with_totals


def test_tax_and_totals_half_up(spark):
    rng = random.Random(1)
    vals = [D(rng.randint(0, 10**9)) / 100 for _ in range(3000)] + [D("34.90"), D("69.98"), D("0.10"), D("0.30")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, subtotal decimal(38,2)")
    got = {r["i"]: (r["tax_amount"], r["total_amount"]) for r in with_totals(df).collect()}
    for i, v in enumerate(vals):
        t = (v * D("0.05")).quantize(D("0.01"), rounding=ROUND_HALF_UP)
        assert got[i] == (t, v + D("10.00") + t), v


def test_average_rating_half_up(spark):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        n = rng.randint(0, 400)
        s = sum(rng.randint(1, 5) for _ in range(n))
        rows.append((i, s, n))
    rows += [(10**6, 201, 200), (10**6 + 1, 1, 200)]  # 1.005 -> 1.01 ; 0.005 -> 0.01
    df = spark.createDataFrame(rows, "i long, s long, n long")
    got = {r["i"]: r["a"] for r in df.select("i", average_rating("s", "n").alias("a")).collect()}
    for i, s, n in rows:
        exp = D(0) if n == 0 else (D(s) / D(n)).quantize(D("0.01"), rounding=ROUND_HALF_UP)
        assert got[i] == exp, (s, n)


def test_average_money_and_line_sums(spark):
    rng = random.Random(3)
    lines = [(rng.randint(1, 50), rng.randint(1, 9), D(rng.randint(1, 10**7)) / 100) for _ in range(5000)]
    df = spark.createDataFrame(lines, "o long, q int, p decimal(10,2)")
    sums = {r["o"]: r["s"] for r in df.groupBy("o").agg(sum_of_lines(F.col("q"), F.col("p")).alias("s")).collect()}
    exp = {}
    for o, q, p in lines:
        exp[o] = exp.get(o, D(0)) + q * p
    assert sums == exp
    tot = sum(exp.values())
    n = len(exp)
    avg = spark.createDataFrame([(tot, n)], "s decimal(38,2), n long").select(average_money("s", "n").alias("a"))
    assert avg.collect()[0]["a"] == (tot / n).quantize(D("0.01"), rounding=ROUND_HALF_UP)
    assert spark.createDataFrame([(D("1.745"),)], "x decimal(10,3)").select(
        tax(F.col("x") * 20)).collect()[0][0] == D("1.75")
