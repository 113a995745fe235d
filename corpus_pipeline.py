"""The corpus pipeline: quality classifier, exact dedup, MinHash near-dedup, source mixing, BPE tokens.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; its result is written as Parquet and
reread as the next one's ``docs``. All stages but the last return the columns of ``docs``.

Defined results of every stage are those of its operator: null and empty texts count as '', very long texts are read whole,
repeated rows and ids and ties are settled by text and id, an empty table gives an empty one, extra columns pass through.

* ``quality``: documents with a score below 0.3 go (learnt from ``labels``, held-out rows left aside).
* ``exact_dedup``: of equal texts (white space runs are one space) the one with the smallest doc_id stays.
* ``near_dedup``: of documents linked by 5-word shingle similarity of 0.8 or more the smallest doc_id stays.
* ``mixing``: sources get shares proportional to rows ** 0.8. The stream lasts until every source was used up once, so no
  document is lost and rows of small sources come again; partitions hold the stream in order.
* ``bpe``: one row per row of the stream: doc_id, n_tokens, ids_sha256, decoded_sha256.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from souk.llm import bpe, exact_dedup, minhash, mixing, quality
from souk.llm.common import drop_table, materialise, table
from souk.llm.queries import word_bpe_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), least=0.3)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, exponent=0.8, until="all_exhausted")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs, word_bpe_path(), bpe.digests, bpe.DIGEST_SCHEMA)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_dedup_stage), ("near_dedup", near_dedup_stage),
          ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: A trained classifier, a hash-ordered schedule and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:  # the stage before is read no more; the input stays
            drop_table(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
