"""Operator 7: BPE encoding and decoding by prefix-sharing trie traversal.

Distinct words are taken in sorted order, which is the depth-first order of
their trie. Each trie node is a word prefix and its state is the last token of
that prefix's BPE encoding; a node's state follows from those of its ancestors,
so a prefix shared by many words is encoded once. The last token of a prefix is
the one suffix token that (a) is its own encoding and (b) forms a stable
border with the state before it: no merge of lower rank crosses that border.

Defined results: null or empty text gives no ids and decodes to ''; a text that
holds a special token's string gets that token's id, as in the library; repeated
rows and null ids are encoded row by row; other columns are not touched.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from souk.llm.common import text_steps
from souk.llm.words import WordSplitter, WordTable, encode_texts, load

NEVER = 1 << 62

#: Token pairs whose stability a worker remembers. Changes speed, never results.
MAX_PAIRS = 1_000_000


@functools.lru_cache(maxsize=1)
def _byte_chars() -> list[str]:
    """Byte -> printable character of byte-level vocabularies: printable Latin-1 stays, the rest follow from 256."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(moved)) for b in range(256)]


class TrieEncoder:
    """Encodes sorted distinct words; states of shared prefixes are computed once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            a_id, b_id = self.vocab[a], self.vocab[b]
            whole = self.vocab[a + b]
            self.rank.setdefault((a_id, b_id), rank)
            self.parts.setdefault(whole, (a_id, b_id, rank))
        made = [t for t, i in self.vocab.items() if i in self.parts or len(t.removesuffix(suffix)) == 1]
        made = [t for t in made if self._reachable(self.vocab[t])]
        self.inner = {t: self.vocab[t] for t in made if not (suffix and t.endswith(suffix))}
        self.final = {t.removesuffix(suffix): self.vocab[t] for t in made if suffix and t.endswith(suffix)} \
            if suffix else self.inner
        self._reachable.cache_clear()
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.stable: dict[int, bool] = {}
        chars = _byte_chars()
        self.byte_char = {b: chars[b] for b in range(256)}
        self.ascii = {b: chars[b] for b in range(128)}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(symbol, rank at which it is merged away) along the token's right (1) or left (0) edge."""
        out, until = [(token, NEVER)], NEVER
        while token in self.parts:
            *pair, until = self.parts[token]
            token = pair[side]
            out.append((token, until))
        return out

    def _crossed(self, left: int, right: int, but: int = -1) -> bool:
        """Whether some merge joins symbols on both sides of the border before they are merged away.

        Equal ranks: merges go from left to right, so the left symbol's own merge comes
        first and a merge over the border comes before the right symbol's own."""
        lefts, rank = self._spine(left, 1), self.rank
        for b, until_b in self._spine(right, 0):
            for a, until_a in lefts:
                r = rank.get((a, b), NEVER)
                if r != but and r < until_a and r <= until_b and r != NEVER:
                    return True
        return False

    @functools.cache  # noqa: B019  one encoder a worker
    def _reachable(self, token: int) -> bool:
        if token not in self.parts:
            return True
        a, b, rank = self.parts[token]
        return self._reachable(a) and self._reachable(b) and not self._crossed(a, b, but=rank)

    def _fits(self, key: int) -> bool:
        """Whether the border of the token pair ``left << 32 | right`` is stable; remembered, in bounded memory."""
        if len(self.stable) >= MAX_PAIRS:
            self.stable.clear()
        ok = self.stable[key] = not self._crossed(key >> 32, key & 0xFFFFFFFF)
        return ok

    def mapped(self, word: str) -> str:
        return word.translate(self.ascii) if word.isascii() else "".join(self.byte_char[b] for b in word.encode())

    def __call__(self, words: list[str]) -> tuple[list[int], list[int]]:
        """(ids of all words, number of ids of each); ``words`` sorted, so that neighbours share prefixes.

        At most one suffix token fits, so short ones, the likelier, are tried first."""
        stable, fits, longest = self.stable, self._fits, self.longest
        inner, final = self.inner.get, self.final.get
        states, sizes, before, flat, counts = [-1], [0], "", [], []
        for s in map(self.mapped, words):
            n, shared = len(s), 0
            for a, b in zip(s, before):
                if a != b:
                    break
                shared += 1
            keep = min(shared, n - 1) + 1
            del states[keep:], sizes[keep:]
            for i in range(keep, n + 1):
                find = inner if i < n else final
                for size in range(1, min(i, longest) + 1):
                    t = find(s[i - size:i])
                    if t is not None:
                        if size == i:
                            break
                        key = states[i - size] << 32 | t
                        ok = stable.get(key)
                        if fits(key) if ok is None else ok:
                            break
                else:
                    raise ValueError(f"no token ends {s[:i]!r}")
                states.append(t)
                sizes.append(size)
            ids, i = [], n
            while i:
                ids.append(states[i])
                i -= sizes[i]
            ids.reverse()
            flat += ids
            counts.append(len(ids))
            before = s[:n - 1]
            del states[n:], sizes[n:]
        return flat, counts


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        self.tok = load(path)
        self.splitter = WordSplitter(self.tok)
        self.words = WordTable(TrieEncoder(path))
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.tokens = pa.array([self.tok.id_to_token(i) or "" for i in range(size)], pa.large_string())

    def encode(self, texts: list[str]) -> pa.ListArray:
        ids, offsets = encode_texts(texts, self.splitter, self.words)
        return pa.ListArray.from_arrays(offsets.astype(np.int32), ids)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Token strings joined by one space: the file names no decoder. Null lists give ''."""
        ids = pc.fill_null(ids, pa.scalar([], ids.type))
        strings = pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), self.tokens.take(ids.values))
        return pc.binary_join(strings, pa.scalar(" ", pa.large_string()))


@functools.lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), codec(path).encode(b.column(1).to_pylist())], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text string): what the library's decode(ids, skip_special_tokens=False) gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), codec(path).decode(b.column(1)).cast(pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, finish: Callable[[pa.ListArray, pa.Array], list[pa.Array]], schema: str,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids again, and keep what ``finish(ids, decoded)`` makes of both.

    One Python stage: ids and decoded texts, several times the text's size, never cross into the JVM."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches):
            ids = codec(path).encode(b.column(1).to_pylist())
            columns = [b.column(0), *finish(ids, codec(path).decode(ids))]
            yield pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])

    kind = docs.schema[id_col].dataType.simpleString()
    names = [c.split()[0] for c in schema.split(",")]
    kinds = [c.split()[1] for c in schema.split(",")]
    inner = ", ".join(f"`{i}` {k}" for i, k in enumerate([kind, *kinds]))
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, inner).toDF(id_col, *names)


def digests(ids: pa.ListArray, decoded: pa.Array) -> list[pa.Array]:
    """n_tokens, sha256 of the ids as little-endian unsigned 32-bit integers, sha256 of the decoded text."""
    offsets, flat = np.asarray(ids.offsets), np.asarray(ids.values).astype("<u4")
    raw = memoryview(flat.tobytes())
    of_ids = [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
    of_text = [hashlib.sha256(memoryview(s.as_buffer())).hexdigest() for s in decoded]
    return [pa.array(np.diff(offsets), pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]


DIGEST_SCHEMA = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
