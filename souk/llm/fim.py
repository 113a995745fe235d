"""Operator 13: fill-in-middle transformation, cut positions found on a wavelet matrix.

Each step of whole texts becomes one sequence of character classes; a position's symbol is the class of
the character before it and its own. A wavelet matrix over the symbols answers "how often does symbol s
occur before p" from its bit planes; a unit's border is one of a few symbols, so the sum of their ranks counts the
borders before p, and bisection on that count finds the cut after any number of units, for all texts of the step at once.

Defined results: null text counts as ''; an empty text and one that holds a sentinel are left plain; a null id hashes as
''; repeated rows are cut alike; very long texts make one step of their own; an empty table gives an empty one;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import text_steps

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Text bytes a vectorised step works on; a code point takes some 40 bytes in it.
STEP_BYTES = 1 << 19

_OTHER, _SPACE, _LINE = 0, 1, 2
_CLASSES = 4  # a power of two: a symbol is two classes of two bits
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[0x0A] = _LINE

#: Border symbols of each unit, as (class before, class after): a token is white space with the run after it
#: (trailing white space stands alone), a line ends with its line feed.
UNITS = {
    "token": [(_OTHER, _SPACE), (_OTHER, _LINE)],
    "line": [(_LINE, _OTHER), (_LINE, _SPACE), (_LINE, _LINE)],
}

_WORD = 64


class BitPlane:
    """A bit sequence with counts of ones before every 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(n // _WORD + 1, np.uint64)
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])
        self.zeros = n - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Ranks of small symbols: one bit plane a symbol bit, each plane stably sorted by the bits above it."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.size, self.bits, self.planes = len(symbols), bits, []
        now = symbols
        for level in range(bits - 1, -1, -1):
            ones = (now >> level) & 1
            self.planes.append(BitPlane(ones))
            now = np.concatenate((now[ones == 0], now[ones == 1]))

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before each position of ``at``."""
        start, end = np.zeros(1, np.int64), at
        for level, plane in zip(range(self.bits - 1, -1, -1), self.planes):
            if symbol >> level & 1:
                start, end = plane.zeros + plane.rank(start), plane.zeros + plane.rank(end)
            else:
                start, end = start - plane.rank(start), end - plane.rank(end)
        return end - start


class Borders:
    """Unit borders inside the texts of one step."""

    def __init__(self, texts: list[str], unit: str = "token"):
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate(([0], self.ends[:-1])).astype(np.int64)
        joined = "".join(texts)
        if joined.isascii():
            kind = _KIND[np.frombuffer(joined.encode("ascii"), np.uint8)]
        else:
            point = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            kind = np.where(point < 256, _KIND[np.minimum(point, 255)], np.uint8(_OTHER))
        before = np.empty(len(kind), np.uint8)
        before[1:] = kind[:-1]
        first = self.starts[self.starts < self.ends]
        before[first] = _CLASSES - 1  # no class: nothing ends before a text's first character
        self.matrix = WaveletMatrix(before * _CLASSES + kind, 4)
        self.symbols = [a * _CLASSES + b for a, b in UNITS[unit]]
        self.skipped = self.count(self.starts)

    def count(self, at: np.ndarray) -> np.ndarray:
        """Borders before each position of the joined texts."""
        return sum(self.matrix.rank(s, at) for s in self.symbols)

    def units(self) -> np.ndarray:
        """Units of each text: one more than the borders inside, none in an empty text."""
        return self.count(self.ends) - self.skipped + (self.ends > self.starts)

    def cut(self, doc: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Characters of text ``doc`` in its first ``k`` of ``n`` units: bisection for the position whose border is the k-th."""
        low, high = self.starts[doc].copy(), self.ends[doc].copy()  # count(low) < wanted <= count(high) for inner cuts
        wanted = self.skipped[doc] + k
        for _ in range(int((high - low).max(initial=1)).bit_length()):
            mid = (low + high) >> 1
            enough = self.count(mid) >= wanted
            high, low = np.where(enough, mid, high), np.where(enough, low, mid)
        # the k-th border is at the last position before ``high``: unit k + 1 starts there
        inner = np.maximum(high - 1, self.starts[doc])
        return np.where(k <= 0, self.starts[doc], np.where(k >= n, self.ends[doc], inner)) - self.starts[doc]


def draws(seed: int, ids: list) -> np.ndarray:
    """(rows, 4): the first four 8-digit groups of the hex sha256 of ``seed:id``, as integers."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def transform(docs: DataFrame, rate: int = 50, spm_share: int = 80, seed: int = 42, unit: str = "token",
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row's whole text.

    ``rate`` per cent of the texts are rearranged, ``spm_share`` per cent of those suffix first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, step_bytes=STEP_BYTES):
            texts = b.column(1).to_pylist()
            borders = Borders(texts, unit)
            n, h = borders.units(), draws(seed, b.column(0).to_pylist())
            one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            free = np.array([bool(t) and not (PREFIX in t or SUFFIX in t or MIDDLE in t) for t in texts], bool)
            cut = np.flatnonzero(free & (h[:, 2] % 100 < rate))
            a = borders.cut(cut, np.minimum(one, two)[cut], n[cut])
            z = borders.cut(cut, np.maximum(one, two)[cut], n[cut])
            spm = h[cut, 3] % 100 < spm_share
            form, output = ["plain"] * len(texts), texts
            sizes: list[list] = [[None] * len(texts), [None] * len(texts)]
            for i, p, m, suffix_first in zip(cut.tolist(), a.tolist(), z.tolist(), spm.tolist()):
                t = texts[i]
                head, middle, tail = t[:p], t[p:m], t[m:]
                if suffix_first:
                    form[i], output[i] = "spm", f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{middle}"
                else:
                    form[i], output[i] = "psm", f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{middle}"
                sizes[0][i], sizes[1][i] = p, m - p
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.array(form), pa.array(sizes[0], pa.int64()), pa.array(sizes[1], pa.int64()),
                 pa.array(output, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(
        run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return out.withColumnRenamed("doc_id", id_col)


def restored(form: Column, output: Column) -> Column:
    """The exact text that ``output`` was made from: a rearranged text holds no sentinel of its own, so each occurs once."""
    def between(before: str, after: str | None) -> Column:
        rest = F.substring_index(output, before, -1)
        return rest if after is None else F.substring_index(rest, after, 1)

    middle = between(MIDDLE, None)
    return F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))) \
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))).otherwise(output)
