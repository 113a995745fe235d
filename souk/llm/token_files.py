"""Operator 3: token ids as Parquet list columns.

One row per document, ascending by doc_id over the part files: ``doc_id``
(delta coded), ``n_tokens`` and ``ids`` (list<int32>, dictionary coded: a
vocabulary fits one dictionary page). Row groups and pages are small and every
page is indexed, so a reader that asks for some documents or for ``n_tokens`` only
reads those pages. Token offsets are not stored: they follow from the files'
own counts, read without touching the ids.

Defined results: null or empty text holds the end id alone; repeated ids lie
side by side, ordered by text hash; null ids come first; other columns are not read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.llm.common import text_steps
from souk.llm.words import WordSplitter, WordTable, encode_texts, load

#: Row group and page sizes in bytes, and rows a page at most.
FORMAT = {
    "compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000", "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false",
    "parquet.dictionary.page.size": str(1 << 20),
}


#: Text bytes encoded at once: a word that is new to a step costs several times one that is known, and larger steps meet fewer.
STEP_BYTES = 4 << 20


class LibraryWords:
    """Encodes distinct words with the tokenizers library, many at a time."""

    def __init__(self, path: str, chunk: int = 20_000):
        self.tok, self.chunk = load(path), chunk
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def __call__(self, words: list[str]) -> tuple[list[int], list[int]]:
        flat, counts = [], []
        for at in range(0, len(words), self.chunk):
            part = words[at:at + self.chunk]
            ids = self.tok.encode(" ".join(part), add_special_tokens=False).ids
            last = np.flatnonzero(self.ends[np.array(ids, np.int64)])
            if len(last) == len(part):  # every word ends in exactly one word-end token
                flat += ids
                counts += np.diff(last, prepend=-1).tolist()
            else:
                for e in self.tok.encode_batch(part, add_special_tokens=False):
                    flat += e.ids
                    counts.append(len(e.ids))
        return flat, counts


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> tuple[WordSplitter, WordTable]:
    return WordSplitter(load(path)), WordTable(LibraryWords(path))


def write_tokens(docs: DataFrame, out: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", options: dict[str, str] = FORMAT) -> None:
    """Encode every row's whole text, append ``end_id`` and write the files.

    Documents are dealt by ranges of doc_id before they are encoded, so the range
    sampling reads plain columns and the encoding runs once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, words = _encoder(tokenizer_path)
        for b in text_steps(batches, step_bytes=STEP_BYTES):
            ids, offsets = encode_texts(b.column(1).to_pylist(), splitter, words)
            ids = np.insert(ids, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(offsets), pa.int32()), pa.ListArray.from_arrays(offsets.astype(np.int32), ids)],
                ["doc_id", "n_tokens", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    tokens = rows.mapInArrow(run, f"doc_id {kind}, n_tokens int, ids array<int>")
    tokens.write.options(**options).parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, file, row): the files' rows and their places."""
    return spark.read.parquet(path).select("doc_id", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"),
                                           F.col("_metadata.row_index").alias("row"))


def token_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(file, base): ids in all files before each file; the numbers in file names ascend with doc_id.

    Names are zero-filled to five digits only, so tasks, then a task's files, are ordered as numbers."""
    totals = read_tokens(spark, path).groupBy("file").agg(F.sum("n_tokens").alias("n"))
    number = lambda pattern: F.regexp_extract("file", pattern, 1).try_cast("long")
    before = Window.orderBy(number(r"^part-(\d+)"), number(r"-c(\d+)\."), "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return totals.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(4)
            offsets, flat = np.asarray(ids.offsets).astype(np.int64), np.asarray(ids.values).astype("<u4", copy=False)
            raw, base = memoryview(flat.tobytes()), 0
            crc = [zlib.crc32(raw[4 * (s - base):4 * (e - base)]) for s, e in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "file", "row", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", F.col("n_tokens").cast("long"), "file", "row", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, file string, row bigint, ids_crc32 bigint")
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(token_offsets(spark, path), "file").select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
