"""Operator 11: ranked lexical search on K2-treaps over the term-document grid.

Documents are indexed in blocks. A block's grid has a row a term (in sorted order, rows spread so that small
cells hold one term only) and a column a document (ascending id); a point is a term's occurrence in a document, its value the
integer impact (10^9 tf) div (1000 tf + 20 m). The grid is a compressed quadtree in level order: four child bits
and the cell's largest impact for every node that is not empty, a cell with one point being a leaf that names it; ranks over the
child bits lead from a node to its children. Blocks are written as a table, one row a block.

An item's terms are rows of every block. Their paths descend jointly, best first: an entry is a range of documents
with each term's cell in it, its bound the sum of weight times cell maximum; the entries with the highest bounds are
halved, until no bound reaches the k-th best score. A range in which every term's cell is a leaf or empty gives exact
scores. A task keeps each item's best over its blocks, so later blocks start with a threshold.

A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); m = 50 + (50 n N) div L. Items are asked in packs whose
summed size is checked, every pack against all blocks.

Defined results: null or empty texts hold no terms, such documents count nowhere and are never found, such items return no row; rows that
share an item_id are one item with all their terms, a null item_id is one; repeated document rows are found
row by row; ties go to the smaller doc_id, null last; very long texts are indexed whole; empty tables give an empty
result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.llm.common import raw_text, text_steps
from souk.session import scratch_dir

#: A block is closed when it holds that many documents or points (one document is never cut).
BLOCK_DOCS, BLOCK_POINTS = 1 << 14, 1 << 20
#: Rows are spread by 2^SPREAD: cells over so many documents or fewer hold one term.
SPREAD = 6
#: Terms of the items that are asked at once; entries times terms that one descent step and the waiting entries hold.
PACK_TERMS, STEP_CELLS, WAITING_CELLS = 1 << 19, 1 << 13, 1 << 22
STEP_BYTES = 1 << 20

#: One block a row group, so that readers hold one at a time.
FORMAT = {"compression": "zstd", "parquet.block.row.count.limit": "1", "parquet.page.size.row.check.min": "1",
          "parquet.enable.dictionary": "false"}

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_ONES = np.array([bin(x).count("1") for x in range(16)], np.uint8)
#: Children of a node before its quadrant q: _BELOW[child bits, q].
_BELOW = np.array([[bin(x & ((1 << q) - 1)).count("1") for q in range(4)] for x in range(16)], np.uint8)

_LAST = 2**63 - 1


def _starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, which of them belong to terms, where a term starts) of a large_string array."""
    data, offsets = raw_text(texts)
    inside = _TERM[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[first] = inside[first]
    return data, inside, start


def count_terms(texts: pa.Array) -> np.ndarray:
    """Terms of each text, with repeats."""
    total = np.concatenate(([0], np.cumsum(_starts(texts)[2])))
    return np.diff(total[raw_text(texts)[1]])


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, term, occurrences) of every distinct pair, and the terms that the second numbers."""
    data, inside, start = _starts(texts)
    at = np.flatnonzero(start)
    none = np.empty(0, np.int64)
    if len(at) == 0:
        return none, none, none, pa.array([], pa.large_string())
    place = np.cumsum(inside) - inside  # of each byte among the terms' bytes
    kept = _LOWER[data[inside]]
    cuts = np.concatenate((place[at], [len(kept)])).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(kept)).dictionary_encode()
    n = len(words.dictionary)
    owner = np.searchsorted(raw_text(texts)[1], at, side="right") - 1
    pair, tf = np.unique(owner * n + np.asarray(words.indices), return_counts=True)
    return pair // n, pair % n, tf, words.dictionary


def _spread_bits(x: np.ndarray) -> np.ndarray:
    """Bits of a number below 2^31 moved to the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << np.uint64(shift)) & np.uint64(mask)
    return x


def _even_bits(x: np.ndarray) -> np.ndarray:
    x = x & np.uint64(0x5555555555555555)
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF),
                        (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | x >> np.uint64(shift)) & np.uint64(mask)
    return x


@dataclass
class Treap:
    """One block's quadtree in level order; ``row`` and ``doc`` name the points of its leaves."""

    levels: int
    child: np.ndarray  # uint8 a node: four child bits, 0 for a leaf
    top: np.ndarray    # uint32 a node: largest impact of its cell
    row: np.ndarray    # uint32 a leaf
    doc: np.ndarray    # uint32 a leaf

    @staticmethod
    def build(row: np.ndarray, doc: np.ndarray, impact: np.ndarray, rows: int, docs: int) -> Treap:
        levels = max(1, int(docs - 1).bit_length(), int(rows - 1).bit_length() + SPREAD)
        code = _spread_bits(row << SPREAD) << np.uint64(1) | _spread_bits(doc)
        order = np.argsort(code)
        code, value = code[order], impact[order].astype(np.uint32)
        child, top, leaves = [], [], []
        for level in range(levels + 1):
            key = code >> np.uint64(2 * (levels - level))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            start = np.flatnonzero(new)
            if len(start) == 0:
                break
            single = np.diff(start, append=len(key)) == 1
            top.append(np.maximum.reduceat(value, start))
            leaves.append(code[start[single]])
            bits = np.zeros(len(start), np.uint8)
            rest = ~single[np.cumsum(new) - 1]
            code, value, new = code[rest], value[rest], new[rest]
            if len(code):
                quadrant = (code >> np.uint64(2 * (levels - level - 1))) & np.uint64(3)
                bits[~single] = np.bitwise_or.reduceat(np.uint8(1) << quadrant.astype(np.uint8), np.flatnonzero(new))
            child.append(bits)
        named = np.concatenate(leaves)
        return Treap(levels, np.concatenate(child), np.concatenate(top),
                     (_even_bits(named >> np.uint64(1)) >> np.uint64(SPREAD)).astype(np.uint32), _even_bits(named).astype(np.uint32))

    def open(self) -> None:
        """Ranks: the first child of every node, and the number of every leaf."""
        ones = np.cumsum(_ONES[self.child], dtype=np.int64)
        self.first = np.concatenate(([0], ones[:-1])) + 1
        self.leaf = np.cumsum(self.child == 0, dtype=np.int64) - 1

    def _cells(self, node: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each cell as (inner node or -1, impact maximum, the leaf's document or -1); a leaf of another row is empty."""
        known = node >= 0
        at = np.where(known, node, 0)
        is_leaf = known & (self.child[at] == 0)
        number = np.where(is_leaf, self.leaf[at], 0)
        own = is_leaf & (self.row[number] == rows)
        inner = known & ~is_leaf
        value = np.where(inner | own, self.top[at], 0).astype(np.int64)
        return np.where(inner, node, -1), value, np.where(own, self.doc[number].astype(np.int64), -1)

    def search(self, rows: np.ndarray, weights: np.ndarray, best: Best, ids: np.ndarray) -> None:
        """Offer to ``best`` every document of the block that may be among the best for the terms ``rows``."""
        rows = rows.astype(np.int64)
        place, t = rows << SPREAD, len(rows)
        node, value, doc = self._cells(np.zeros((1, t), np.int64), rows)
        level, base = np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = value @ weights
        step, half = max(4, STEP_CELLS // t), np.arange(2)
        while len(bound):
            ready = (node < 0).all(axis=1)
            if ready.any():  # no cell to enter any more: the leaves' documents have exact scores
                which, term = np.nonzero(ready[:, None] & (doc >= 0))
                found, of = np.unique(doc[which, term], return_inverse=True)
                scores = np.zeros(len(found), np.int64)
                np.add.at(scores, of, value[which, term] * weights[term])
                best.offer(scores, ids[found])
            lowest = ids[np.minimum(base << (self.levels - level), len(ids) - 1)]
            rest = np.flatnonzero(~ready & best.open(bound, lowest))
            node, value, doc, level, base, bound = (x[rest] for x in (node, value, doc, level, base, bound))
            if len(bound) == 0:
                break
            # the highest bounds first; with many entries waiting the deepest, which end soonest
            if len(bound) > step:
                crowded = len(bound) * t > WAITING_CELLS
                pick = np.argpartition(-(level if crowded else bound), step)
                now, wait = pick[:step], pick[step:]
            else:
                now, wait = np.arange(len(bound)), np.empty(0, np.int64)
            shift = self.levels - 1 - level[now]
            row_bit = place[None, :] >> shift[:, None] & 1
            inner = node[now] >= 0
            at = np.where(inner, node[now], 0)
            bits, first = self.child[at], self.first[at]
            made = []
            for d in half:
                quadrant = row_bit * 2 + d
                there = inner & (bits >> quadrant & 1 == 1)
                n2, v2, d2 = self._cells(np.where(there, first + _BELOW[bits, quadrant], -1), rows)
                stays = (doc[now] >= 0) & (doc[now] >> shift[:, None] & 1 == d)
                v2, d2 = np.where(stays, value[now], v2), np.where(stays, doc[now], d2)
                made.append((n2, v2, d2, level[now] + 1, base[now] << 1 | d, v2 @ weights))
            made = [np.concatenate((old[wait], *new)) for old, *new in zip((node, value, doc, level, base, bound), *made)]
            live = made[5] > 0
            node, value, doc, level, base, bound = made if live.all() else [x[live] for x in made]


class Best:
    """The k best (score, id) so far; equal scores by ascending id."""

    def __init__(self, k: int):
        self.k = k
        self.score = self.id = np.empty(0, np.int64)

    def open(self, bound: np.ndarray, lowest: np.ndarray) -> np.ndarray:
        """Whether a range with this bound, whose smallest id is ``lowest``, may still hold one of the best."""
        if len(self.score) < self.k:
            return bound > 0
        return (bound > self.score[-1]) | ((bound == self.score[-1]) & (lowest < self.id[-1]))

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = self.open(score, ids)
        score, ids = np.concatenate((self.score, score[good])), np.concatenate((self.id, ids[good]))
        order = np.lexsort((ids, -score))[:self.k]
        self.score, self.id = score[order], ids[order]


class _Block:
    """Points of one block while it is filled."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.parts, self.points = [], [], [], 0

    def add(self, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, terms: pa.Array) -> None:
        self.parts.append((doc + sum(map(len, self.ids)), term, tf, terms))
        self.ids.append(ids), self.sizes.append(n)
        self.points += len(doc)

    def full(self) -> bool:
        return sum(map(len, self.ids)) >= BLOCK_DOCS or self.points >= BLOCK_POINTS

    def close(self, docs: int, total: int) -> pa.RecordBatch:
        ids, n = np.concatenate(self.ids), np.concatenate(self.sizes)
        doc, tf = (np.concatenate([p[i] for p in self.parts]) for i in (0, 2))
        size = np.cumsum([0, *(len(p[3]) for p in self.parts)])
        merged = pa.concat_arrays([p[3] for p in self.parts]).dictionary_encode()
        order = np.asarray(pc.array_sort_indices(merged.dictionary))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        row = rank[np.asarray(merged.indices)[np.concatenate([p[1] + s for p, s in zip(self.parts, size)])]]
        used = np.unique(doc)  # documents without terms are no columns
        by_id = used[np.argsort(ids[used], kind="stable")]
        column = np.zeros(len(ids), np.int64)
        column[by_id] = np.arange(len(by_id))
        m = np.array([50 + (50 * x * docs) // total for x in n.tolist()], np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
        treap = Treap.build(row, column[doc], impact, len(order), len(by_id))
        blob = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        listed = lambda x: pa.array([x], pa.list_(x.type))
        return pa.RecordBatch.from_arrays(
            [blob(ids[by_id], "<i8"), listed(merged.dictionary.take(pa.array(order)).cast(pa.string())),
             listed(pa.array(np.bincount(row, minlength=len(order)), pa.int32())), pa.array([treap.levels], pa.int32()),
             blob(treap.child, "u1"), blob(treap.top, "<u4"), blob(treap.row, "<u4"), blob(treap.doc, "<u4")], _BLOCK_COLUMNS)


_BLOCK_COLUMNS = ["ids", "terms", "dfs", "levels", "child", "top", "leaf_row", "leaf_doc"]
_BLOCK_SCHEMA = ("ids binary, terms array<string>, dfs array<int>, levels int, child binary, top binary, leaf_row binary, "
                 "leaf_doc binary")


@dataclass(frozen=True)
class LexicalIndex:
    """Blocks written at ``path``; documents with a term, and all their terms with repeats."""

    path: str
    documents: int
    terms: int

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_BLOCK_SCHEMA).parquet(self.path)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """Index every row's whole text: one pass counts documents and terms, one writes the blocks."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_seen = terms_seen = 0
        for b in text_steps(batches, step_bytes=STEP_BYTES):
            n = count_terms(b.column(0))
            docs_seen, terms_seen = docs_seen + int((n > 0).sum()), terms_seen + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([docs_seen]), pa.array([terms_seen])], ["docs", "terms"])

    told = docs.select(docs[text_col].alias("text")).mapInArrow(count, "docs bigint, terms bigint") \
        .agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for b in text_steps(batches, step_bytes=STEP_BYTES):
            doc, term, tf, terms = term_counts(b.column(1))
            ids = np.asarray(b.column(0).fill_null(_LAST))
            block.add(ids, np.bincount(doc, tf, minlength=len(ids)).astype(np.int64), doc, term, tf, terms)
            if block.full():
                if block.points:
                    yield block.close(*told)
                block = _Block()
                pa.default_memory_pool().release_unused()
        if block.points:
            yield block.close(*told)

    _texts(docs, id_col, text_col).mapInArrow(write, _BLOCK_SCHEMA).write.options(**FORMAT).parquet(path)
    return LexicalIndex(path, *told)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term): each item's terms once."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, step_bytes=STEP_BYTES):
            doc, term, _, terms = term_counts(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), terms.take(pa.array(term)).cast(pa.string())],
                                             ["item_id", "term"])

    rows = items.select(items[id_col].alias("item_id"), items[text_col].alias("text"))
    return rows.mapInArrow(run, f"item_id {kind}, term string").distinct()


def weighted_terms(index: LexicalIndex, spark: SparkSession, asked: DataFrame) -> DataFrame:
    """(item_id, term, weight) of the terms that some document holds; df is the sum of the blocks' own counts."""
    held = index.blocks(spark).select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select("x.terms", "x.dfs")
    df = held.join(asked.select(F.col("term").alias("terms")).distinct(), "terms", "left_semi") \
        .groupBy("terms").agg(F.sum("dfs").alias("df")).withColumnRenamed("terms", "term")
    weight = F.floor(F.lit(1000.0) * F.log((2.0 * index.documents + 2) / (F.col("df") * 2 + 1).cast("double")))
    return asked.join(df, "term").select("item_id", "term", weight.cast("long").alias("weight"))


def _packs(weighted: DataFrame, pack_terms: int) -> tuple[DataFrame, int]:
    """``weighted`` with ``pack``: whole items, dealt by hash to as few packs as keep each within ``pack_terms`` or one item."""
    sizes = weighted.groupBy("item_id").agg(F.count(F.lit(1)).alias("n")).cache()
    place = lambda n: F.pmod(F.xxhash64("item_id"), F.lit(n))
    n = max(1, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // pack_terms))
    while sizes.groupBy(place(n)).agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k")) \
            .filter((F.col("t") > pack_terms) & (F.col("k") > 1)).limit(1).count():
        n *= 2
    sizes.unpersist()
    return weighted.withColumn("pack", place(n)), n


def _ask(blocks: DataFrame, pack: pa.Table, kind: str, k: int) -> DataFrame:
    """(item_id, doc_id, score): each task's k best for every item of the pack."""
    pack = pack.sort_by([("item_id", "ascending"), ("term", "ascending")])
    shared = blocks.sparkSession.sparkContext.broadcast(pack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value.combine_chunks()
        term = pc.dictionary_encode(asked["term"].combine_chunks())
        number, weight = np.asarray(term.indices), np.asarray(asked["weight"])
        item = asked["item_id"].combine_chunks()
        code = np.asarray(pc.dictionary_encode(item, null_encoding="encode").indices)
        cuts = np.concatenate((np.flatnonzero(np.diff(code, prepend=-1)), [len(code)]))
        best = [Best(k) for _ in cuts[1:]]
        for b in batches:
            for r in range(b.num_rows):
                ids, terms, _, levels, *arrays = (b.column(i)[r] for i in range(8))
                child, top, row, doc = (np.frombuffer(a.as_buffer(), d) for a, d in zip(arrays, ("u1", "<u4", "<u4", "<u4")))
                treap = Treap(levels.as_py(), child, top, row, doc)
                treap.open()
                ids = np.frombuffer(ids.as_buffer(), "<i8")
                place = pc.index_in(term.dictionary, value_set=terms.values)
                place = np.asarray(pc.fill_null(place, -1)).astype(np.int64)[number]
                for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                    here = (place[s:e] >= 0) & (weight[s:e] > 0)
                    if here.any():
                        treap.search(place[s:e][here], weight[s:e][here], best[i], ids)
        size = [len(x.score) for x in best]
        if sum(size):
            ids = np.concatenate([x.id for x in best])
            yield pa.RecordBatch.from_arrays(
                [item.take(pa.array(np.repeat(cuts[:-1], size))), pa.array(ids, mask=ids == _LAST),
                 pa.array(np.concatenate([x.score for x in best]))], ["item_id", "doc_id", "score"])

    return blocks.mapInArrow(run, f"item_id {kind}, doc_id bigint, score bigint")


def search(index: LexicalIndex, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text",
           pack_terms: int = PACK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    spark = items.sparkSession
    kind = items.schema[id_col].dataType.simpleString()
    empty = spark.createDataFrame([], f"item_id {kind}, doc_id bigint, score bigint")
    found = empty
    if index.documents:
        packed, n = _packs(weighted_terms(index, spark, item_terms(items, id_col, text_col)).cache(), pack_terms)
        for p in range(n):
            pack = packed.filter(F.col("pack") == p).select("item_id", "term", "weight").toArrow()
            if pack.num_rows:
                found = found.unionByName(_ask(index.blocks(spark), pack, kind, k))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item_id").alias(id_col), "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index ``docs`` in the shared folder and search it for every row of ``items``."""
    return search(build_index(docs, scratch_dir(docs.sparkSession, "op11-index"), id_col, text_col), items, k)
