"""Operator 4: mixing sources to target weights by Pfair scheduling.

Target weights are exact: whole numbers a_s that sum to W (a float is a fraction, so nothing is rounded). Source s has a
share a_s / W of the slots; its k-th block (a fixed number of rows) is released at slot floor(k * W / a_s) and due by slot
ceil((k + 1) * W / a_s); earliest deadline first fills every slot, so that after any number of slots each source has
had its share to within one block, however long the stream is. The slots are placed in chunks, side by side: what a chunk's start
has done ahead of time follows from the chunks' least numbers of free slots, which the driver folds one after the other.

A source's rows come in a pseudo-random order that depends on their ids only. The stream lasts until every
source was used up once (``all_exhausted``: smaller sources begin again, nothing is dropped) or until the first one would
run out (``first_exhausted``: no row comes twice).

Defined results: a null source is a source of its own; sources without a weight or of weight 0 are left out; repeated rows and null ids
are rows like others (ties in the order fall to the id); an empty table gives an empty stream. Extra columns pass
through ``mix`` untouched, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Collection, Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.llm.common import materialise

#: Rows a block, rows an order bucket holds on average, slots that one step places.
BLOCK_ROWS, BUCKET_ROWS, CHUNK_SLOTS = 16, 2000, 1 << 14


def _in_order(sources: Collection[str | None]) -> list[str | None]:
    return sorted(sources, key=lambda s: (s is not None, s))


def whole_weights(weights: dict[str | None, float]) -> dict[str | None, int]:
    """The positive weights as whole numbers in exactly the same proportions."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*whole.values())
    return {s: a // common for s, a in whole.items()}


def _under_way(shares: Sequence[int], total: int, slot: int) -> list[tuple[int, int, int, int]]:
    """(deadline, source number, block, release) of the blocks released before ``slot`` and due after it: one a source at most."""
    return [(-(-(a * slot // total + 1) * total // a), no, a * slot // total, a * slot // total * total // a)
            for no, a in enumerate(shares) if a * slot % total]


def _released(shares: Sequence[int], total: int, start: int, stop: int) -> Iterator[tuple[int, int, int, int]]:
    """(deadline, source number, block, release) of the blocks released in slots [start, stop)."""
    for no, a in enumerate(shares):
        k = -(-a * start // total)
        while (release := k * total // a) < stop:
            yield -(-(k + 1) * total // a), no, k, release
            k += 1


def place(shares: Sequence[int], start: int, stop: int, ahead: Collection[int] = ()) -> list[tuple[int, int, int, int]]:
    """(source number, block, release, deadline) of slots [start, stop): earliest deadline first among released blocks.

    ``ahead``: the sources whose block under way at ``start`` is done."""
    total = sum(shares)
    releases: list[list] = [[] for _ in range(stop - start)]
    for block in _released(shares, total, start, stop):
        releases[block[3] - start].append(block)
    ready = [block for block in _under_way(shares, total, start) if block[1] not in ahead]
    heapq.heapify(ready)
    out = []
    for slot in range(start, stop):
        for block in releases[slot - start]:
            heapq.heappush(ready, block)
        deadline, no, k, release = heapq.heappop(ready)
        assert slot < deadline, "a block missed its deadline"
        out.append((no, k, release, deadline))
    return out


def free_slots(shares: Sequence[int], start: int, stop: int) -> list[tuple[int, int]]:
    """(release, room) for the releases in [start, stop) of blocks under way at ``stop``, in their order.

    Room: the least number of slots from t to ``stop`` that the blocks released from t on and due by ``stop`` leave free, for t after
    the release before and up to this one."""
    total = sum(shares)
    due = [release - start for deadline, _, _, release in _released(shares, total, start, stop) if deadline <= stop]
    later = np.cumsum(np.bincount(np.array(due, np.int64), minlength=stop - start)[::-1])[::-1]
    room = np.arange(stop - start, 0, -1) - later
    ends = sorted({release for _, _, _, release in _under_way(shares, total, stop) if release >= start})
    return [(r, int(room[at:r - start + 1].min())) for at, r in zip([0, *(e - start + 1 for e in ends)], ends)]


def done_ahead(shares: Sequence[int], start: int, stop: int, ahead: Collection[int], free: Sequence[tuple[int, int]]) -> set[int]:
    """The sources whose block under way at ``stop`` is done by then, from those at ``start`` and the ``free_slots`` between.

    Blocks due by ``stop`` are done. Of the others earliest deadline first does, in that order, each one for which a slot is free:
    the sets that fit are those with no more blocks released from any t on than slots from t on (a matroid)."""
    total = sum(shares)
    blocks = sorted(_under_way(shares, total, stop))
    done = {no for _, no, _, release in blocks if release < start and no in ahead}
    places = stop - sum(a * stop // total for a in shares) - len(done)
    releases, room = np.array([r for r, _ in free], np.int64), np.array([n for _, n in free], np.int64)
    for _, no, _, release in blocks:
        if places == 0:
            break
        if no in done:
            continue
        up_to = int(np.searchsorted(releases, release, side="right")) if release >= start else 0
        if up_to and room[:up_to].min() < 1:
            continue
        room[:up_to] -= 1
        done.add(no)
        places -= 1
    return done


def source_counts(docs: DataFrame, source_col: str = "source") -> dict[str | None, int]:
    """Rows of each source; sources are as few as the weights that a caller can state."""
    return {r["s"]: r["count"] for r in docs.groupBy(docs[source_col].alias("s")).count().collect()}


def tempered(counts: dict[str | None, int], exponent: float) -> dict[str | None, float]:
    """Weights proportional to rows ** exponent: 1 keeps the natural shares, smaller ones favour small sources."""
    return {s: n**exponent for s, n in counts.items()}


def _plan(spark: SparkSession, shares: list[int], slots: int, chunk: int) -> DataFrame:
    """(no, block, slot, release, deadline) of all slots, each chunk placed by itself."""
    spans = [(start, min(start + chunk, slots)) for start in range(0, slots, chunk)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop in zip(b["start"].to_pylist(), b["stop"].to_pylist()):
                free = free_slots(shares, start, stop)
                yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([[r for r, _ in free]], pa.list_(pa.int64())),
                                                  pa.array([[n for _, n in free]], pa.list_(pa.int64()))], ["start", "releases", "room"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop, ahead in zip(b["start"].to_pylist(), b["stop"].to_pylist(), b["ahead"].to_pylist()):
                no, block, release, deadline = zip(*place(shares, start, stop, set(ahead)))
                deadline = [min(x, (1 << 63) - 1) for x in deadline]  # of weights near 0
                yield pa.RecordBatch.from_arrays([pa.array(no, pa.int32()), *(pa.array(x, pa.int64()) for x in (block, range(start, stop), release, deadline))],
                                                 ["no", "block", "slot", "release", "deadline"])

    free = {}
    if len(spans) > 1:
        measured = spark.createDataFrame(spans[:-1], "start long, stop long").mapInArrow(measure, "start long, releases array<long>, room array<long>")
        free = {r["start"]: list(zip(r["releases"], r["room"])) for r in measured.collect()}
    ahead: list[set[int]] = [set()]
    for start, stop in spans[:-1]:
        ahead.append(done_ahead(shares, start, stop, ahead[-1], free[start]))
    chunks = spark.createDataFrame([(*span, sorted(done)) for span, done in zip(spans, ahead)], "start long, stop long, ahead array<int>")
    return materialise(chunks.mapInArrow(fill, "no int, block long, slot long, release long, deadline long"), "op4-plan")


def _numbered(rows: DataFrame, total_rows: int, id_at: int, block_rows: int, plan: DataFrame) -> DataFrame:
    """Adds ``__index`` (0.. in each source, in hash order) and the slots of each bucket's blocks to rows with no, n, taken.

    Buckets of the hash keep any source's rows spread. ``places``: for each pass over the bucket ``stride`` blocks from its first one on."""
    buckets = max(1, total_rows // BUCKET_ROWS)
    key = F.xxhash64(F.md5(F.col(f"c{id_at}").cast("string")), F.col(f"c{id_at}"))
    rows = rows.withColumn("__key", key)
    rows = rows.withColumn("__bucket", F.floor((F.shiftrightunsigned("__key", 1) / F.lit(float(1 << 63))) * buckets).cast("long"))
    sizes = rows.groupBy("no", "__bucket").agg(F.count(F.lit(1)).alias("size"), F.first("n").alias("of"), F.first("taken").alias("out"))
    before = Window.partitionBy("no").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))) \
        .withColumn("stride", F.expr(f"(size + {2 * block_rows - 2}) DIV {block_rows}"))  # blocks that so many rows touch at most
    spans = sizes.withColumn("pass", F.explode(F.expr("CASE WHEN out > base THEN sequence(0L, (out - 1 - base) DIV of) ELSE array() END"))) \
        .withColumn("th", F.explode(F.expr("sequence(0L, stride - 1)"))) \
        .withColumn("block", F.expr(f"(pass * of + base) DIV {block_rows} + th")) \
        .join(plan, ["no", "block"], "left")
    places = spans.groupBy("no", "__bucket", "base", "stride").agg(
        F.array_sort(F.collect_list(F.struct(F.expr("pass * stride + th").alias("at"), "slot", "release", "deadline"))).alias("places"))
    inside = Window.partitionBy("no", "__bucket").orderBy(F.shiftrightunsigned("__key", 1), "__key", f"c{id_at}")
    rows = rows.withColumn("__row", F.row_number().over(inside) - 1).join(places, ["no", "__bucket"])
    return rows.withColumn("__index", F.col("base") + F.col("__row"))


def schedule(docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.8, until: str = "all_exhausted",
             block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` as columns c0, c1, ... with source, pass (0: first use), block, release, deadline, slot, position."""
    return _scheduled(docs, weights, exponent, until, block_rows, id_col, source_col)[0]


def _scheduled(docs: DataFrame, weights: dict[str | None, float] | None, exponent: float, until: str, block_rows: int,
               id_col: str, source_col: str, chunk: int = CHUNK_SLOTS) -> tuple[DataFrame, int]:
    """The schedule and its number of slots."""
    spark: SparkSession = docs.sparkSession
    counts = source_counts(docs, source_col)
    weights = whole_weights({s: w for s, w in (weights or tempered(counts, exponent)).items() if counts.get(s)})
    sources = _in_order(weights)
    shares, total = [weights[s] for s in sources], sum(weights.values())
    if until == "all_exhausted":  # the block of each source with which the stream may end
        ends, last = [-(-counts[s] // block_rows) - 1 for s in sources], max
    elif until == "first_exhausted":  # the first block that a source could not fill
        ends, last = [counts[s] // block_rows for s in sources], min
    else:
        raise ValueError(f"until: {until!r}")
    plan = _plan(spark, shares, last([-(-(k + 1) * total // a) for k, a in zip(ends, shares)], default=0), chunk)
    known = spark.createDataFrame([(no, k) for no, k in enumerate(ends)], "no int, block long")
    found = [r["slot"] for r in plan.join(F.broadcast(known), ["no", "block"]).select("slot").collect()]
    slots = last(found, default=0) + (until == "all_exhausted" and bool(found))
    plan = plan.filter(F.col("slot") < slots)
    taken = {r["no"]: r["count"] * block_rows for r in plan.groupBy("no").count().collect()}

    known = spark.createDataFrame([(s, no, counts[s], taken.get(no, 0)) for no, s in enumerate(sources)], "s string, no int, n long, taken long")
    rows = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)], docs[source_col].alias("__source"))
    rows = rows.join(F.broadcast(known), F.col("__source").cast("string").eqNullSafe(F.col("s"))).drop("s")  # a row a source
    rows = _numbered(rows, sum(counts.values()), docs.columns.index(id_col), block_rows, plan)
    passes = F.expr("CASE WHEN taken > __index THEN sequence(0L, (taken - 1 - __index) DIV n) ELSE array() END")
    rows = rows.withColumn("pass", F.explode(passes))
    rows = rows.withColumn("nth", F.col("pass") * F.col("n") + F.col("__index"))
    rows = rows.withColumn("block", F.expr(f"nth DIV {block_rows}"))
    rows = rows.withColumn("place", F.expr(f"element_at(places, int(pass * stride + block - (pass * n + base) DIV {block_rows}) + 1)"))
    out = rows.select(
        *[f"c{i}" for i in range(len(docs.columns))], F.col("__source").alias("source"), "pass", "block", "place.release", "place.deadline",
        "place.slot", F.expr(f"place.slot * {block_rows} + nth % {block_rows}").alias("position"))
    return out, slots


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.8, until: str = "all_exhausted",
        block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` in stream order: partition after partition, and inside each; a row comes once a pass.

    Positions are dense, so equal ranges of them are the partitions: no sampling, one shuffle."""
    rows, slots = _scheduled(docs, weights, exponent, until, block_rows, id_col, source_col)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = max(1, -(-slots * block_rows // parts))
    rows = rows.select(*[f"c{i}" for i in range(len(docs.columns))], "position")
    rows = rows.repartitionById(parts, F.expr(f"int(position DIV {width})")).sortWithinPartitions("position")
    return rows.drop("position").toDF(*docs.columns)
