"""Trigram table: which texts can match a LIKE pattern at all, found by a few index rows in place of a scan of all texts.

A text that matches holds every three neighbouring code points of every literal run of the pattern, so the ids that hold all of the pattern's
trigrams are a superset of the matches; the caller applies the exact LIKE to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N = 3


def trigrams(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(gram, id): every distinct trigram of each lower-cased text. NULL texts and texts under three code points have none."""
    text = F.lower(F.col(text_col))
    starts = F.sequence(F.lit(1), F.length(text) - F.lit(N - 1))
    grams = F.when(F.length(text) >= N, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(N)))))
    return texts.select(F.explode(grams).alias("gram"), F.col(id_col).alias("id"))


def write_trigrams(table: DataFrame, path: str) -> None:
    """Store a trigram table in gram order: a search reads the few row groups of its grams, and a common gram fills many files."""
    table.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(path)


def literal_runs(pattern: str) -> list[str]:
    """The runs of a LIKE pattern between wildcards, backslashes resolved."""
    runs, at = [""], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            at += 1
            runs[-1] += pattern[at]
        elif c in "%_":
            runs.append("")
        else:
            runs[-1] += c
        at += 1
    return [r for r in runs if r]


def needed_grams(spark: SparkSession, pattern: str) -> list[str]:
    """The trigrams that every match of the case-blind ``pattern`` holds; none where no literal run has three code points."""
    lowered = spark.range(1).select(F.lower(F.lit(pattern)).alias("p")).first()[0]  # as the texts are lower-cased
    return sorted({r[i:i + N] for r in literal_runs(lowered) for i in range(len(r) - N + 1)})


def candidates(table: DataFrame, pattern: str) -> DataFrame | None:
    """Ids whose texts can match ``pattern``; None where the pattern needs no trigram, so that every text can."""
    grams = needed_grams(table.sparkSession, pattern)
    if not grams:
        return None
    held: Column = F.count_distinct("gram") if len(grams) > 1 else F.lit(1)
    found = table.filter(F.col("gram").isin(grams)).groupBy("id").agg(held.alias("held"))
    return found.filter(F.col("held") == len(grams)).select("id")
