"""Operator 10: exact top-k inner products with a pivot table.

Vectors become integers floor(64 * x). Euclidean distances of every vector to many pivots (some of the
vectors, and the origin) are computed once. For a query q and a candidate v the pivots bound their distance from
below, max |d(q, p) - d(v, p)|, and so their inner product from above,
(|q|^2 + |v|^2 - bound^2) / 2. Candidates are evaluated in order of that bound until the k-th best score
is above the next bound: nothing that could still count is skipped.

Queries and candidates meet in blocks. A block holds vectors of one nearest pivot, at like distances from it, and is
known by its least and greatest distance to every pivot, so the pivots bound the scores of whole block pairs as they do
those of vectors. A first pass, of each query block with the block of the highest bound, gives each query a score that
its k-th best is known to reach; block pairs whose bound is below the scores of all their queries never meet.

Defined results: null vectors, null or non-finite components and null ids take no part; a query meets only vectors of its
own length; rows that share the query's id are its own; of several rows with one query id the least vector asks;
equal scores go to the smaller id; scores beyond 64 bits are clamped. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import drop_table, materialise

PIVOTS, CANDIDATE_BLOCK, QUERY_BLOCK = 24, 4096, 1024
#: Rings of like distance that a pivot's cell is cut into at most; candidate blocks that a task sets against query blocks.
RINGS, BLOCKS_A_TASK = 16, 256
#: Candidates evaluated first, in bound order; each further step takes four times as many.
STEP = 256

_MOST = 2**63 - 1


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, data): floor(64 * x) of the valid vectors, as little-endian doubles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, blobs = [], [], []
            for key, v in zip(b.column(0).to_pylist(), b.column(1)):
                if key is None or not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(64.0 * np.asarray(v.values).astype(np.float64))
                if np.isfinite(x).all():
                    ids.append(key), dims.append(len(x)), blobs.append((x + 0.0).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())],
                                             ["vec_id", "dim", "data"])

    chosen = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("v"))
    return chosen.mapInArrow(run, "vec_id bigint, dim int, data binary")


def matrix(blobs, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), "<f8").reshape(len(blobs), dim)


def pivot_table(vectors: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Adds ``reach``: distances to the origin and to each pivot of the vector's length; and ``far``: the same, as bytes."""
    chosen = vectors.dropDuplicates(["data"]).orderBy(F.xxhash64("vec_id", "data")).limit(pivots).collect()
    by_dim: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in chosen}:
        by_dim[dim] = matrix([bytes(r["data"]) for r in chosen if r["dim"] == dim], dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, blobs = np.asarray(b.column(1)), b.column(2).to_pylist()
            out: list[np.ndarray] = [np.empty(0)] * b.num_rows
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = matrix([blobs[i] for i in at], dim)
                points = np.concatenate((np.zeros((1, dim)), by_dim.get(int(dim), np.empty((0, dim)))))
                far = np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in points], axis=1)
                for i, row in zip(at, far):
                    out[i] = row
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([r.astype("<f8").tobytes() for r in out], pa.binary()), pa.array(out, pa.list_(pa.float64()))],
                ["vec_id", "dim", "data", "far", "reach"])

    return vectors.select("vec_id", "dim", "data").mapInArrow(
        run, "vec_id bigint, dim int, data binary, far binary, reach array<double>")


def _exact(block: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; clamped to 64 bits. ``block`` and ``q`` are floats that hold all their sums, or objects."""
    if block.dtype != object:
        return (block @ q).astype(np.int64)
    return np.array([max(-_MOST - 1, min(_MOST, sum(a * b for a, b in zip(row, q)))) for row in block.tolist()], np.int64)


def _holding(q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in the narrowest type in which every partial sum of their products is exact."""
    most = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, q.shape[1])
    if most < 2**24:
        return q.astype(np.float32), v.astype(np.float32)
    if most < 2**53:
        return q, v
    whole = np.vectorize(int, otypes=[object])
    return (whole(q), whole(v)) if q.size and v.size else (q, v)


def best_of_block(qs: pd.DataFrame, vs: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of ``vs`` for each query of ``qs`` whose score reaches the query's ``floor``."""
    dim = int(qs["dim"].iloc[0])
    q, v = _holding(matrix(qs["data"], dim), matrix(vs["data"], dim))
    q_far, v_far = matrix(qs["far"], -1), np.ascontiguousarray(matrix(vs["far"], -1).T)
    v_id, out = vs["vec_id"].to_numpy(), []
    q_norm, v_norm = q_far[:, 0] ** 2, v_far[0] ** 2
    # distances in single precision where their rounding stays far below one score; the slack covers it
    fine = max(q_norm.max(initial=0), v_norm.max(initial=0)) < 1e6
    near, slack = (np.float32, 1e-5) if fine else (np.float64, 1e-9)
    columns, rows = v_far.astype(near), q_far.astype(near)
    gap = np.empty_like(columns)
    for i, (own, floor) in enumerate(zip(qs["vec_id"].to_numpy(), qs["floor"].to_numpy())):
        np.abs(np.subtract(columns, rows[i][:, None], out=gap), out=gap)
        size = q_norm[i] + v_norm
        most = (size - gap.max(axis=0).astype(np.float64) ** 2) / 2 + slack * size + 1e-6
        most[~np.isfinite(most)] = np.inf  # distances beyond doubles bound nothing
        rest = np.flatnonzero((most >= floor) & (v_id != own))
        scores, ids, least, step = np.empty(0, np.int64), np.empty(0, np.int64), floor, STEP
        while len(rest):  # the highest bounds first; what can no longer reach the k-th best leaves
            if len(rest) > step:
                cut = np.argpartition(-most[rest], step)
                part, rest = rest[cut[:step]], rest[cut[step:]]
            else:
                part, rest = rest, rest[:0]
            found = _exact(v, q[i])[part] if 4 * len(part) > len(v) else _exact(v[part], q[i])
            good = found >= least
            if good.any():
                scores, ids = np.concatenate((scores, found[good])), np.concatenate((ids, v_id[part[good]]))
                order = np.lexsort((ids, ~scores))[:k]  # ~x falls as x rises, without overflow
                scores, ids = scores[order], ids[order]
                if len(scores) == k:
                    least = max(least, scores[-1])
            rest, step = rest[most[rest] >= least], step * 4
        out.append(pd.DataFrame({"query_id": own, "vec_id": ids, "score": scores}))
    return pd.concat(out, ignore_index=True)


def _meet(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Candidates of every block pair; both sides carry (dim, qb, cb)."""
    def run(key: tuple, qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        if len(qs) == 0 or len(vs) == 0:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return best_of_block(qs, vs, k)

    keys = ["dim", "qb", "cb"]
    return queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(
        run, "query_id bigint, vec_id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocked(rows: DataFrame, size: int, name: str, spread: str) -> DataFrame:
    """Adds the long ``name``: a block of about ``size`` rows at most, of one nearest pivot and like distance from it.

    Small tables use fewer pivots, so that blocks do not get tiny; vectors at one distance are dealt by ``spread``."""
    cells = max(1, min(PIVOTS, rows.count() // (2 * size)))
    near = F.slice("reach", 2, cells)  # empty for lengths without a pivot: one cell around the origin
    rows = rows.withColumn("least", F.coalesce(F.array_min(near), F.element_at("reach", 1)))
    rows = rows.withColumn("cell", F.coalesce(F.array_position(near, F.col("least")), F.lit(0)).cast("int"))
    steps = [i / RINGS for i in range(1, RINGS)]
    cuts = rows.groupBy("dim", "cell").agg(F.least(F.lit(RINGS), F.ceil(F.count(F.lit(1)) / size)).alias("rings"),
                                           F.percentile_approx("least", steps).alias("cuts"))
    # written first: the planner sees its true size, a row a cell, and broadcasts it only if that is small
    rows = rows.join(materialise(cuts, "op10-cuts"), ["dim", "cell"])
    passed = F.size(F.filter("cuts", lambda c: c < F.col("least")))
    rows = rows.withColumn("ring", F.floor(passed * F.col("rings") / RINGS).cast("int")).drop("cuts", "rings")
    parts = rows.groupBy("dim", "cell", "ring").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    rows = rows.join(materialise(parts, "op10-parts"), ["dim", "cell", "ring"])
    own = F.pmod(F.xxhash64(spread), F.col("parts"))
    block = (F.col("cell") * RINGS + F.col("ring")).cast("long") * (1 << 32) + own
    return rows.withColumn(name, block).drop("least", "cell", "ring", "parts")


def _reaches(rows: DataFrame, name: str) -> DataFrame:
    """A row a block: (dim, ``name``, lo, hi, n), the least and greatest distances to the origin and every pivot, and its rows."""
    far = [F.try_element_at("reach", F.lit(i)) for i in range(1, PIVOTS + 2)]
    side = lambda agg: F.array(*[agg(d) for d in far])
    return rows.groupBy("dim", name).agg(side(F.min).alias(f"{name}_lo"), side(F.max).alias(f"{name}_hi"), F.count(F.lit(1)).alias(f"{name}_n"))


def block_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(dim, qb, cb, most, cb_n): what the score of any pair of the two blocks is at most, for all pairs of blocks.

    Only the blocks' summaries meet here, dealt over tasks by a salt of the candidates' side."""
    q, c = _reaches(queries, "qb"), materialise(_reaches(candidates, "cb"), "op10-blocks")
    salts = -(-c.count() // BLOCKS_A_TASK) or 1
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    pairs = q.join(c.withColumn("salt", F.pmod(F.xxhash64("cb"), F.lit(salts)).cast("int")), ["dim", "salt"])
    apart = lambda lo, hi: F.zip_with(lo, hi, lambda x, y: x - y)
    gap = F.greatest(F.lit(0.0), F.array_max(apart(F.col("qb_lo"), F.col("cb_hi"))), F.array_max(apart(F.col("cb_lo"), F.col("qb_hi"))))
    a, b = F.element_at("qb_hi", 1), F.element_at("cb_hi", 1)
    most = F.least((a * a + b * b - gap * gap) / 2, a * b) + 1e-9 * (a * a + b * b) + 1e-6
    endless = F.isnan(most) | (F.abs(most) == float("inf"))  # distances beyond doubles bound nothing
    return pairs.select("dim", "qb", "cb", F.when(endless, float("inf")).otherwise(most).alias("most"), "cb_n")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each row that ``is_query`` (over ``vec_id``) names."""
    whole = materialise(integers(vectors, id_col, vector_col), "op10-integers")
    known = materialise(pivot_table(whole).withColumn("row", F.monotonically_increasing_id()), "op10-pivots")
    drop_table(whole)
    asked = known.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "data", "far", "reach")).alias("v")).select("vec_id", "v.*")
    asked = materialise(_blocked(asked, QUERY_BLOCK, "qb", "vec_id"), "op10-queries")
    known = materialise(_blocked(known, CANDIDATE_BLOCK, "cb", "row"), "op10-candidates")
    pairs = materialise(block_pairs(asked, known), "op10-pairs")
    asked, known = asked.drop("reach"), known.drop("reach", "row")

    first = pairs.filter(F.col("cb_n") > k).groupBy("dim", "qb").agg(F.max_by("cb", F.struct("most", "cb")).alias("cb"))
    first = materialise(first, "op10-first")
    lowest = F.lit(-_MOST - 1).cast("long")
    start = _best(_meet(asked.join(first, ["dim", "qb"]).withColumn("floor", lowest), known.join(first, ["dim", "cb"]), k), k)
    start = materialise(start.drop("rank"), "op10-start")
    floors = start.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    asked = asked.join(floors.select(F.col("query_id").alias("vec_id"), "floor"), "vec_id", "left") \
        .withColumn("floor", F.coalesce("floor", lowest))
    asked = materialise(asked, "op10-asked")
    least = asked.groupBy("dim", "qb").agg(F.min("floor").alias("floor"))
    left = pairs.join(least, ["dim", "qb"]).filter("most >= floor").join(first, ["dim", "qb", "cb"], "left_anti")
    left = materialise(left.select("dim", "qb", "cb"), "op10-left")
    rest = _meet(asked.join(left, ["dim", "qb"]), known.join(left, ["dim", "cb"]), k)
    return _best(start.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
