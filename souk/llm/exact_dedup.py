"""Operator 9: exact deduplication in two Bloom passes.

Texts are equal when identical after each run of space, tab, LF, VT, FF, CR is
replaced by one space. Pass 1 puts every row's text hash into a fixed-size
two-level Bloom filter ("met once", "met again"), built slice by slice in
tasks. Pass 2 asks the filter: rows whose hash was surely met once pass straight
through; only the others are shuffled and grouped by their exact SHA-256. A full
filter only sends more rows through the shuffle, it never changes a result.

Defined results: null text counts as ''; of equal texts the row with the
smallest doc_id stays, a null doc_id comes after all others; repeated rows (same
doc_id and text) all carry the group's decision, and ``deduplicate`` keeps one of
them. Extra columns, whatever their names, stay untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.bloom import MAX_BITS, build_filter, membership
from souk.llm.common import drop_table, materialise


def text_digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with white space runs made one space; null counts as ''."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.unhex(F.sha2(plain, 256))


def _groups(maybe: DataFrame) -> DataFrame:
    """(sha, keep_id, group_size) of the rows that may have copies; partial aggregation absorbs hot groups."""
    return maybe.groupBy("sha").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = materialise(docs.select(docs[id_col].alias("doc_id"), text_digest(docs[text_col]).alias("sha"))
                         .withColumn("key", F.xxhash64("sha")), "op9-hashes")
    bloom = build_filter(hashed, repeated=True, max_bits=max_bits)
    hashed = hashed.withColumn("maybe", membership(hashed, F.col("key"), bloom)).drop("key")
    single = hashed.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"),
                                                   F.lit(1).cast("long").alias("group_size"), "sha")
    maybe = hashed.filter("maybe").select("doc_id", "sha")
    grouped = maybe.join(_groups(maybe), "sha").select("doc_id", "keep_id", "group_size", "sha")
    return single.unionByName(grouped).select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without the rows whose text another row has; one row of each group stays.

    Rows surely met once never leave their partition. Of the others a task sends on one row a text
    at most, its first, so a text that fills a third of the table is one row a task in the shuffle."""
    keys = materialise(docs.select(F.xxhash64(text_digest(docs[text_col])).alias("key")), "op9-keys")
    bloom = build_filter(keys, repeated=True, max_bits=max_bits)
    drop_table(keys)
    cols = [docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]
    at = F.col(f"c{docs.columns.index(id_col)}")
    rows = docs.select(*cols, text_digest(docs[text_col]).alias("sha"))
    rows = rows.withColumn("maybe", membership(rows, F.xxhash64("sha"), bloom))
    names = [f"c{i}" for i in range(len(docs.columns))]
    first = F.min_by(F.struct(*names), F.struct(at.isNull(), at))
    stay = rows.filter("maybe").groupBy("sha").agg(first.alias("row")).select("row.*")
    return rows.filter(~F.col("maybe")).select(*names).unionByName(stay).toDF(*docs.columns)
