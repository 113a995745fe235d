"""Fixed-size Bloom filters over 64-bit keys, built slice by slice in Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import mix64

#: Upper bound of a broadcast filter: 2^28 bits are 32 MiB. Bits a key, and slices it is built in.
MAX_BITS, BITS_PER_KEY, SLICES, PROBES = 1 << 28, 16, 64, 3

_U64 = np.uint64


class BloomFilter:
    """``bits`` is a power of two and bounds the size, whatever the number of keys."""

    def __init__(self, bits: int, data: np.ndarray | None = None, probes: int = PROBES):
        self.bits, self.data, self.probes = bits, data, probes

    def positions(self, keys: np.ndarray) -> np.ndarray:
        """(probes, n) bit positions by double hashing."""
        with np.errstate(over="ignore"):
            h = mix64(keys.astype(np.int64).view(_U64))
            step = mix64(h ^ _U64(0x9E3779B97F4A7C15)) | _U64(1)
            k = np.arange(self.probes, dtype=_U64)[:, None]
            return ((h[None, :] + k * step[None, :]) & _U64(self.bits - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p = self.positions(keys)
        return ((self.data[p >> 3] >> (p & 7).astype(np.uint8)) & 1).all(axis=0)


def build_filter(keys: DataFrame, repeated: bool = False, max_bits: int = MAX_BITS) -> BloomFilter:
    """Filter of the long column ``key``; with ``repeated``, of the keys that occur more than once.

    Each task sends its rows' bit positions to the slice that owns them; a slice is a bounded pair
    of bitmaps ("met", "met again"). All bits of a key that occurs twice are "met again". The
    finished bitmap that the driver broadcasts has ``max_bits`` bits at most."""
    bits = min(max_bits, 1 << max(13, int(keys.count() * BITS_PER_KEY).bit_length()))
    width = bits // SLICES

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = BloomFilter(bits)
        for b in batches:
            key, n = np.unique(np.asarray(b.column(0).drop_null()), return_counts=True)
            p = np.sort(shape.positions(key), axis=0)
            new = np.ones(p.shape, bool)  # probes of one key that meet in one bit are one meeting
            new[1:] = p[1:] != p[:-1]
            again, p = np.broadcast_to(n > 1, p.shape)[new], p[new]
            order = np.argsort(p, kind="stable")
            p, again = p[order], again[order]
            cut = np.searchsorted(p, np.arange(SLICES + 1) * width)
            for s in np.flatnonzero(np.diff(cut)):
                at = slice(cut[s], cut[s + 1])
                own = (p[at] - s * width).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([own[again[at]].tobytes()], pa.binary())],
                    ["slice", "met", "again"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for s, once, again in zip(*(c.to_pylist() for c in b.columns)):
                met, twice = maps.setdefault(s, (np.zeros(width, bool), np.zeros(width, bool)))
                p, n = np.unique(np.frombuffer(once, "<u4"), return_counts=True)
                twice[p[met[p] | (n > 1)]] = True
                met[p] = True
                twice[np.frombuffer(again, "<u4")] = True
        for s, (met, twice) in maps.items():
            found = np.packbits(twice if repeated else met, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([found], pa.binary())], ["slice", "bits"])

    sent = keys.select(F.col("key").cast("long").alias("key")).mapInArrow(spread, "slice int, met binary, again binary")
    data = np.zeros(bits // 8, np.uint8)
    for row in sent.repartition(SLICES, "slice").mapInArrow(build, "slice int, bits binary").collect():
        at = row["slice"] * width // 8
        data[at:at + width // 8] = np.frombuffer(row["bits"], np.uint8)
    return BloomFilter(bits, data)


def membership(df: DataFrame, key: Column, bloom: BloomFilter) -> Column:
    """Boolean column: whether the filter may hold the 64-bit key (false for null keys). Only the key goes to Python."""
    shared = df.sparkSession.sparkContext.broadcast(bloom)

    @F.arrow_udf("boolean")
    def held(k: pa.Array) -> pa.Array:
        known = np.asarray(k.is_valid())
        return pa.array(shared.value.contains(np.asarray(k.fill_null(0)).astype(np.int64)) & known)

    return held(key)
