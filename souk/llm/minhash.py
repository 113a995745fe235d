"""Operator 8: near-duplicate documents by MinHash, banding, verification and components.

1. Each document's set is its distinct 5-word shingles (64-bit hashes). Documents with equal
   sets form a numbered class, whose set is read from its smallest doc_id.
2. 240 universal hash minima a class, in 40 bands of 6; classes that share a band's minima
   share a bucket. At similarity 0.85 a pair misses every bucket once in 10^8, at 0.8 once in 10^5.
3. Signature verification: inside a bucket, classes whose 2-bit signatures agree nearly as often as the
   threshold asks (less five standard deviations) are joined into groups by a breadth-first search that
   returns a spanning forest, never all pairs.
4. The groups' components each get their members' full sets once; an inverted index finds
   the exact links (100 * intersection >= percent * union) and again returns a spanning forest of them.
5. Components of the confirmed links, by large-star and small-star.
Buckets and groups above a block size are dealt to block pairs, so that every pair still meets in some
task while no task holds more than two blocks.

Defined results: words are runs of anything but space, tab, LF, VT, FF, CR; A-Z is lower-cased; fewer than
five words are one shingle; null text or no words is an empty set, linked with nothing. Rows that share a doc_id
are one document, linked with whatever any of its sets is linked with. A null doc_id is linked with nothing and kept. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.bloom import build_filter, membership
from souk.llm.common import drop_table, gather, materialise, mix64, raw_text, text_steps
from souk.llm.components import connected_components

WORDS, BANDS, ROWS = 5, 40, 6
PERMUTATIONS = BANDS * ROWS
#: Classes a bucket block and shingles a group block holds; larger ones are dealt to block pairs.
BUCKET_BLOCK, GROUP_BLOCK = 4096, 1 << 20
#: Text bytes a vectorised step works on; its arrays hold several 64-bit values a byte.
STEP_BYTES = 1 << 19

_U64 = np.uint64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def _constants() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(20240817)
    draw = lambda n: rng.integers(1, 2**63, n, dtype=np.uint64)
    return draw(256), draw(PERMUTATIONS) << _U64(1) | _U64(1), draw(PERMUTATIONS), draw(WORDS) | _U64(1)


_BYTE, _A, _B, _PLACE = _constants()
_BASE = _U64(0xD6E8FEB86659FD93)
_BASE_INVERSE = _U64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_OF = _BYTE[_LOWER]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, words before each document), for concatenated UTF-8 documents.

    A word's hash is a polynomial in its bytes, from one running sum over the whole step."""
    n = len(data)
    if n == 0:
        return np.empty(0, _U64), np.zeros(len(offsets), np.int64)
    word = ~_WHITE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = word[cuts]  # words end with their document
    last[cuts - 1] = word[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    with np.errstate(over="ignore"):
        powers = np.full(n, _BASE, _U64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        total = np.cumsum(_BYTE_OF[data] * powers, dtype=_U64)
        inverse = np.full(n, _BASE_INVERSE, _U64)
        inverse[0] = 1
        np.multiply.accumulate(inverse, out=inverse)
        h = total[end] - np.where(start > 0, total[start - 1], _U64(0))
        h = mix64(h * inverse[start] + (end - start).astype(_U64))
    return h, np.searchsorted(start, offsets)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a large_string array."""
    h, at = word_hashes(*raw_text(texts))
    with np.errstate(over="ignore"):
        total = sum(h[k:len(h) - WORDS + 1 + k] * _PLACE[k] for k in range(WORDS)) if len(h) >= WORDS else h[:0]
        total = mix64(total)
        out = []
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= WORDS:
                out.append(np.unique(total[a:b - WORDS + 1]))
            elif b > a:
                out.append(mix64((h[a:b] * _PLACE[:b - a]).sum(dtype=_U64, keepdims=True) + _U64(b - a)))
            else:
                out.append(np.empty(0, _U64))
    return out


def set_hash(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signature(shingles: np.ndarray) -> np.ndarray:
    """The 240 minima of the set under (a * x + b) mod 2^64."""
    out = np.full(PERMUTATIONS, np.iinfo(_U64).max, _U64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 2048):
            part = shingles[at:at + 2048]
            np.minimum(out, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1), out=out)
    return out


def sketch(minima: np.ndarray) -> bytes:
    """Two mixed bits of every minimum, four to a byte."""
    two = (mix64(minima) & _U64(3)).astype(np.uint8).reshape(-1, 4)
    return (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).tobytes()


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key a band."""
    with np.errstate(over="ignore"):
        place = mix64(np.arange(1, PERMUTATIONS + 1, dtype=_U64)) | _U64(1)
        return mix64((minima * place).reshape(BANDS, ROWS).sum(axis=1, dtype=_U64)).view(np.int64)


#: Matching 2-bit lanes of a byte XOR.
_LANES = np.array([sum(1 for s in (0, 2, 4, 6) if (x >> s) & 3 == 0) for x in range(256)], np.uint8)


def least_agreement(percent: int) -> int:
    """Agreeing 2-bit lanes that a pair at the threshold falls below once in a few million."""
    p = percent / 100 + (1 - percent / 100) / 4
    return int(PERMUTATIONS * p - 5 * (PERMUTATIONS * p * (1 - p)) ** 0.5)


def agreement_forest(ids: np.ndarray, sketches: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs whose sketches agree in at least ``least`` lanes."""
    return _forest(ids, lambda i, rest: _LANES[sketches[rest] ^ sketches[i]].sum(axis=1, dtype=np.int32) >= least)


def _forest(ids: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Breadth-first search; ``linked(i, rest)`` tells which of the unreached ``rest`` member i links to."""
    rest, us, vs = np.argsort(ids, kind="stable"), [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = linked(i, rest)
            found = rest[hit]
            if len(found):
                us.append(ids[found])
                vs.append(np.full(len(found), ids[i]))
                queue.extend(found)
                rest = rest[~hit]
    none = np.empty(0, np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


class LinkIndex:
    """Exact overlaps of sets with the members not reached yet; rebuilt as these halve."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.size = np.array([len(s) for s in sets], np.int64)
        values, self.flat = np.unique(np.concatenate([*sets, np.empty(0, _U64)]), return_inverse=True)
        self.start = np.cumsum(self.size) - self.size
        self.owner = np.repeat(np.arange(len(sets)), self.size)
        self.values, self.live = len(values), 1 << 62

    def _build(self, rest: np.ndarray) -> None:
        self.live = len(rest)
        at = gather(self.start[rest], self.size[rest])
        shingle = self.flat[at]
        order = np.argsort(shingle, kind="stable")
        self.members = self.owner[at][order]
        self.count = np.bincount(shingle, minlength=self.values)
        self.first = np.cumsum(self.count) - self.count

    def __call__(self, i: int, rest: np.ndarray) -> np.ndarray:
        if 2 * len(rest) <= self.live:
            self._build(rest)
        mine = self.flat[self.start[i]:self.start[i] + self.size[i]]
        common = np.bincount(self.members[gather(self.first[mine], self.count[mine])], minlength=len(self.size))[rest]
        return 100 * common >= self.percent * (self.size[i] + self.size[rest] - common)


def link_forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs with 100 * intersection >= percent * union, on the full sets."""
    return _forest(ids, LinkIndex(sets, percent))


def _in_groups(rows: DataFrame, keys: list[str], forest: Callable[[np.ndarray, list[bytes]], tuple]) -> DataFrame:
    """Edges (u, v) of ``forest`` over each group of ``rows`` (id, data); groups stream through sorted partitions."""
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, data = None, [], []
        us, vs, held = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs)], ["u", "v"])

        def close() -> int:
            order = np.unique(np.concatenate(ids), return_index=True)[1]  # a class meets itself once
            flat = [b for d in data for b in d]
            u, v = forest(np.concatenate(ids)[order], [flat[i] for i in order])
            if len(u):
                us.append(u), vs.append(v)
            return len(u)

        for b in batches:
            key = [np.asarray(b.column(k)) for k in range(width)]
            n = b.num_rows
            if n == 0:
                continue
            change = np.zeros(n, bool)
            for k in key:
                change[1:] |= k[1:] != k[:-1]
            cuts = [0, *np.flatnonzero(change), n]
            own = np.asarray(b.column(width))
            blob = b.column(width + 1).to_pylist()
            for s, e in zip(cuts[:-1], cuts[1:]):
                now = tuple(k[s] for k in key)
                if now != group and group is not None:
                    held += close()
                    ids, data = [], []
                group = now
                ids.append(own[s:e]), data.append(blob[s:e])
            if held > 50_000:
                yield out()
                us, vs, held = [], [], 0
        if group is not None:
            close()
        if us:
            yield out()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "id", "data")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def _block_pairs(rows: DataFrame, blocks: str) -> DataFrame:
    """Adds (i, j): a group of ``blocks`` blocks goes to one task for each pair of blocks."""
    own = f"pmod(xxhash64(id, 7), {blocks})"
    pairs = f"transform(sequence(0, {blocks} - 1), x -> struct(least(x, {own}) AS i, greatest(x, {own}) AS j))"
    return rows.withColumn("pair", F.explode(F.expr(pairs))).select("*", "pair.i", "pair.j").drop("pair")


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_hash, sketch, bands) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, step_bytes=STEP_BYTES):
            sets = shingle_sets(b.column(1))
            minima = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_hash(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([None if m is None else sketch(m) for m in minima], pa.binary()),
                pa.array([None if m is None else band_keys(m) for m in minima], pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_hash", "sketch", "bands"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_hash binary, sketch binary, bands array<bigint>")


def _candidate_groups(reps: DataFrame, percent: int) -> DataFrame:
    """(node, component): classes joined by bucket neighbours whose signatures agree."""
    least = least_agreement(percent)
    placed = reps.select(F.explode("bands").alias("key"), "id")
    shared = placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = placed.join(shared, "key").join(reps.select("id", F.col("sketch").alias("data")), "id")
    members = _block_pairs(members.withColumn("blocks", F.expr(f"int(ceil(n / {BUCKET_BLOCK}))")), "blocks")

    def forest(ids: np.ndarray, data: list[bytes]):
        sketches = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
        return agreement_forest(ids, sketches, least)

    return connected_components(_in_groups(members, ["key", "i", "j"], forest), "op8-groups")


def _links(docs: DataFrame, groups: DataFrame, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Edges confirmed on the full sets of the groups' members (at most a spanning forest a task), and the table of sets they read.

    ``groups``: (id, component, rep, set_hash). One Python step asks a Bloom filter of the representatives, so that other
    texts are neither cut nor shuffled, and one set of each (rep, set_hash) is kept before the groups are joined."""
    bloom = docs.sparkSession.sparkContext.broadcast(build_filter(groups.select(F.col("rep").alias("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column(0).is_valid()
            held = pa.array(bloom.value.contains(np.asarray(b.column(0).fill_null(0)).astype(np.int64)))
            b = b.filter(pc.and_(known, held))
            for c in text_steps(iter([b]), step_bytes=STEP_BYTES):
                sets = shingle_sets(c.column(1))
                yield pa.RecordBatch.from_arrays([
                    c.column(0), pa.array([set_hash(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "set_hash", "n", "data"])

    rows = docs.select(docs[id_col].cast("long").alias("rep"), docs[text_col].alias("text"))
    sets = rows.mapInArrow(run, "rep bigint, set_hash binary, n bigint, data binary").dropDuplicates(["rep", "set_hash"])
    sets = materialise(sets.join(groups, ["rep", "set_hash"]).select("id", "component", "n", "data"), "op8-sets")
    sizes = sets.groupBy("component").agg(F.expr(f"int(ceil(sum(n) / {GROUP_BLOCK}))").alias("blocks"))
    dealt = _block_pairs(sets.join(sizes, "component"), "blocks")

    def forest(ids: np.ndarray, data: list[bytes]):
        return link_forest(ids, [np.frombuffer(d, _U64) for d in data], percent)

    return _in_groups(dealt, ["component", "i", "j"], forest), sets


def _shared_ids(described: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (u, v) from each doc_id that occurs with different sets to the representatives of their classes."""
    known = described.filter("doc_id IS NOT NULL").select("doc_id", "set_hash")
    several = known.withColumn("h", F.xxhash64("set_hash")).groupBy("doc_id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")) \
        .filter("lo <> hi").select("doc_id")
    return known.join(several, "doc_id").join(classes, "set_hash").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    return _near_duplicates(docs, percent, id_col, text_col)[0]


def _near_duplicates(docs: DataFrame, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """The result and the written tables that it reads; those of the search are freed."""
    described = materialise(describe(docs, id_col, text_col), "op8-described")
    some = described.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialise(some.groupBy("set_hash").agg(F.min("doc_id").alias("rep"))
                          .withColumn("id", F.monotonically_increasing_id()), "op8-classes")
    reps = some.join(classes, "set_hash").filter("doc_id = rep").dropDuplicates(["id"])
    reps = materialise(reps.select("id", "rep", "set_hash", "sketch", "bands"), "op8-reps")
    grouped = _candidate_groups(reps, percent)
    groups = grouped.select(F.col("node").alias("id"), "component").join(reps.select("id", "rep", "set_hash"), "id")
    groups = materialise(groups, "op8-candidates")
    links, sets = _links(docs, groups, percent, id_col, text_col)
    for end in ("u", "v"):  # from classes to documents
        links = links.join(groups.select(F.col("id").alias(end), F.col("rep").alias(f"{end}_doc")), end)
    links = links.select(F.col("u_doc").alias("u"), F.col("v_doc").alias("v"))
    linked = connected_components(links.unionByName(_shared_ids(described, classes)), "op8-components")
    for search in (reps, grouped, groups, sets):  # the components are written
        drop_table(search)
    whole = described.select("doc_id", "n_shingles", "set_hash").join(classes, "set_hash", "left") \
        .withColumn("node", F.coalesce("rep", "doc_id")).join(linked, "node", "left")
    return whole.select(F.col("doc_id").alias(id_col), "n_shingles",
                        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")) \
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))), [described, classes, linked]


def keep_one(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near-duplicates: of each component the document with the smallest id stays.

    Rows whose id the Bloom filter of dropped ids does not hold pass without a shuffle."""
    found, tables = _near_duplicates(docs, percent, id_col, text_col)
    dropped = materialise(found.filter(~F.col("kept")).select(F.col(id_col).alias("key")), "op8-dropped")
    for read in tables:
        drop_table(read)
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    at = F.col(f"c{docs.columns.index(id_col)}").cast("long")
    rows = rows.withColumn("maybe", membership(rows, at, build_filter(dropped)))
    stay = rows.filter("maybe").join(dropped, at == F.col("key"), "left_anti")
    return rows.filter(~F.col("maybe")).unionByName(stay).drop("maybe").toDF(*docs.columns)
