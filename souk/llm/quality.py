"""Operator 5: quality classifier, naive Bayes support vectors.

Features are the distinct n-grams of a text: byte trigrams, and trigrams of word shapes (case, digits, marks,
"same as the word before"), hashed to a fixed number of dimensions. Each indicator is scaled by its class
log-count ratio, the scaled vector has unit length, and a linear hinge-loss model (squared hinge) is fitted by
dual coordinate descent. A logistic curve fitted on rows that the descent did not see turns margins into scores.

The fit reads a bounded, documented sample of labelled rows (``per_class`` of each label, in hash order);
scoring reads every whole text. The model is a fixed-size vector. Labels, ids, lang and source are no features.

Defined results: null or empty text has no n-grams and gets the score of the intercept alone; documents with
contradicting labels are not learnt from; with fewer than two classes among the labels every text gets the share of
label 1 (0.5 without labels); repeated rows are scored row by row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import mix64, raw_text, text_steps
from souk.llm.minhash import word_hashes

#: Feature dimensions (2^18), sampled rows of each label, share of them kept for the score curve.
DIMENSIONS, PER_CLASS, CURVE_SHARE = 1 << 18, 4000, 0.25
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 12

#: Text bytes a vectorised step works on; its arrays hold several 64-bit values a byte.
STEP_BYTES = 1 << 19

_U64 = np.uint64
_SPACE, _LOWER, _UPPER, _DIGIT, _MARK = range(5)
_CLASS = np.full(256, _LOWER, np.uint8)  # bytes of other scripts count as lower-case letters
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[65:91] = _UPPER
_CLASS[48:58] = _DIGIT
_CLASS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = _MARK


def _trigrams(values: np.ndarray, owner: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of each run of three values inside one document."""
    if len(values) < 3:
        return owner[:0], owner[:0]
    inside = owner[2:] == owner[:-2]
    v = values.astype(_U64)
    with np.errstate(over="ignore"):
        code = (v[:-2] << _U64(42)) ^ (v[1:-1] << _U64(21)) ^ v[2:] ^ (_U64(salt) << _U64(62))
        feature = (mix64(code[inside]) & _U64(DIMENSIONS - 1)).astype(np.int64)
    return owner[2:][inside], feature


def _shapes(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shape code, document) of every word: its kinds of bytes, length up to 3, and whether it repeats the word before."""
    if len(data) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind = _CLASS[data]
    word = kind != _SPACE
    edge = word.copy()
    edge[1:] &= ~word[:-1] | (owner[1:] != owner[:-1])
    at = np.flatnonzero(edge)
    if len(at) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kinds = np.bitwise_or.reduceat(np.where(word, 1 << kind.astype(np.int64), 0), at)
    length = np.minimum(np.add.reduceat(word.astype(np.int64), at), 3)
    value, doc = word_hashes(data, offsets)[0], owner[at]
    repeats = np.zeros(len(at), np.int64)
    repeats[1:] = (value[1:] == value[:-1]) & (doc[1:] == doc[:-1])
    return kinds + 32 * repeats + 64 * length, doc


def features(texts: pa.Array) -> list[np.ndarray]:
    """Distinct feature numbers of each text of a large_string array."""
    data, offsets = raw_text(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    doc_a, byte_grams = _trigrams(data, owner, 1)
    shape, doc_of = _shapes(data, offsets, owner)
    doc_b, shape_grams = _trigrams(shape, doc_of, 2)
    cut_a, cut_b = np.searchsorted(doc_a, np.arange(len(texts) + 1)), np.searchsorted(doc_b, np.arange(len(texts) + 1))
    seen, out = np.zeros(DIMENSIONS, bool), []
    for i in range(len(texts)):
        seen[byte_grams[cut_a[i]:cut_a[i + 1]]] = True
        seen[shape_grams[cut_b[i]:cut_b[i + 1]]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        out.append(found)
    return out


@dataclass(frozen=True)
class QualityModel:
    """Log-count ratios, weights, intercept and score curve; a fixed number of values whatever the corpus."""

    ratio: np.ndarray
    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, found: list[np.ndarray]) -> np.ndarray:
        scaled, square = self.weights * self.ratio, self.ratio**2
        return np.array([scaled[f].sum() / max(1e-12, float(square[f].sum())) ** 0.5 for f in found], float) + self.intercept

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(found) + self.shift, -500, 500)))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray,
                            epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and intercept of min |w|^2 / 2 + sum cost_i * max(0, 1 - y_i (w x_i + b))^2, one dual variable at a time.

    x_i is the unit-length vector of the row's ``scale`` values; the intercept is one more feature of value 1. A row's
    values are made when its turn comes: of all rows together they would take the driver several times the rows' own memory."""
    length = np.array([max(1e-12, float(np.sqrt(v @ v))) for v in (scale[r] for r in rows)])
    w, b, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    diagonal = 0.5 / cost
    curvature = np.array([float(v @ v) for v in (scale[r] / n for r, n in zip(rows, length))]) + 1.0 + diagonal
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            values = scale[rows[i]] / length[i]
            slope = y[i] * (w[rows[i]] @ values + b) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / curvature[i])
            step = (new - alpha[i]) * y[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * values
                b += step
    return w, b


def _curve(margins: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic slope and shift by Newton steps, with targets drawn in a little from 0 and 1."""
    ones, zeros = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g = weight * (p - target)
        h = weight * p * (1 - p) + 1e-9
        m = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, np.array([(g * margins).sum() + 1e-6 * a, g.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def held_out(id_col: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id's text is divisible by 5."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _in_place(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The feature numbers that each value of a binary column holds, as views of the column's own memory."""
    out = []
    for chunk in column.chunks:
        data, offsets = raw_text(chunk.cast(pa.large_binary()))
        numbers, at = data.view("<i4"), offsets // 4
        out += [numbers[a:b] for a, b in zip(at[:-1], at[1:])]
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    """Learn from at most ``per_class`` labelled rows of each label that are not held out."""
    told = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")) \
        .filter("id IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("id")))
    told = told.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    counts = {r["y"]: r["count"] for r in told.groupBy("y").count().collect()}
    sample = [told.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    sample = F.broadcast(sample[0].unionByName(sample[1]))  # at most 2 * per_class pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, step_bytes=STEP_BYTES):
            found = [f.astype("<i4").tobytes() for f in features(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["id", "y", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(sample, "id")
    rows = rows.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least")).select("id", "y", "least.text")  # a row an id
    got = rows.mapInArrow(run, f"id {kind}, y int, found binary").toArrow()
    order = np.argsort([int(x) for x in mix64(np.asarray(got["id"]).astype(np.int64).view(_U64))], kind="stable")
    y = np.asarray(got["y"])[order]
    found = _in_place(got["found"])
    found = [found[i] for i in order]
    if len(set(y.tolist())) < 2:
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        edge = min(max(share, 1e-6), 1 - 1e-6)
        none = np.zeros(DIMENSIONS)
        return QualityModel(none, none, 0.0, 0.0, float(np.log(edge / (1 - edge))))

    return _fit_sample(found, y, counts)


def _fit_sample(found: list[np.ndarray], y: np.ndarray, counts: dict[int, int]) -> QualityModel:
    """``counts``: labelled rows of each label, to which the curve's rows are weighted back."""
    spare = np.arange(len(y)) % round(1 / CURVE_SHARE) == 0
    if any((y[spare] == c).sum() == 0 or (y[~spare] == c).sum() == 0 for c in (0, 1)):
        spare[:] = False  # too few rows to hold some back: the curve is fitted on the same rows
    learnt, learnt_y = [f for f, s in zip(found, spare) if not s], y[~spare]
    seen = {c: np.full(DIMENSIONS, SMOOTHING) for c in (0, 1)}
    for f, c in zip(learnt, learnt_y.tolist()):
        seen[c][f] += 1
    rows = {c: int((learnt_y == c).sum()) for c in (0, 1)}
    ratio = np.log(seen[1] / (rows[1] + 2 * SMOOTHING)) - np.log(seen[0] / (rows[0] + 2 * SMOOTHING))
    sign = np.where(learnt_y == 1, 1.0, -1.0)
    cost = COST * len(sign) / (2 * np.where(sign > 0, rows[1], rows[0]))
    model = QualityModel(ratio, *dual_coordinate_descent(learnt, sign, ratio, cost))
    curve, curve_y = ([f for f, s in zip(found, spare) if s], y[spare]) if spare.any() else (learnt, learnt_y)
    weight = np.array([counts[c] / (curve_y == c).sum() for c in curve_y.tolist()])
    slope, shift = _curve(model.margins(curve), curve_y, weight * len(curve_y) / weight.sum())
    return replace(model, slope=slope, shift=shift)


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, step_bytes=STEP_BYTES):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(features(b.column(1))))], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, score double")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: QualityModel, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is below ``least``; rows stream through in small slices, none waits in the JVM."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in text_steps(iter([pa.RecordBatch.from_arrays([b.column(at), pa.array(np.arange(b.num_rows))], ["text", "row"])]),
                                step_bytes=STEP_BYTES):
                good = shared.value.scores(features(s.column(0))) >= least
                yield b.take(s.column(1).filter(pa.array(good)))

    rows = docs.toDF(*names)
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def decide(docs: DataFrame, model: QualityModel, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    out = score(docs, model, id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
