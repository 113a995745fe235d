"""Vectorised pre-tokens of a word-level BPE tokenizer, and the table of words already encoded.

The tokenizer file stays the authority: the class of every code point is asked
from its own normaliser and pre-tokeniser the first time it is met, so the
vectorised split equals the library's (tests compare them).
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.normalizers import NFC

from souk.llm.common import gather

SPACE, LETTER, NUMBER, OTHER = 1, 2, 3, 4

#: Words a worker remembers; beyond it the table starts anew. Changes speed, never results.
MAX_WORDS = 400_000


@functools.lru_cache(maxsize=2)
def load(path: str) -> Tokenizer:
    """The tokenizer, without truncation and padding."""
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class WordSplitter:
    """Splits documents into normalised pre-tokens ("words") with numpy."""

    def __init__(self, tok: Tokenizer):
        self.tok, self.nfc = tok, NFC()
        self.kind = np.zeros(0x110000, np.uint8)
        special = [t.content for t in tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def _learn(self, points: np.ndarray) -> None:
        """Ask the library what kind each new code point is."""
        for p in points:
            c = chr(p)
            n = len(self.tok.pre_tokenizer.pre_tokenize_str("a" + c + "a"))
            if n == 1:
                kind = LETTER
            elif n == 2:
                kind = SPACE
            else:
                kind = NUMBER if len(self.tok.pre_tokenizer.pre_tokenize_str(c + c)) == 2 else OTHER
            self.kind[p] = kind

    def normal(self, text: str) -> str:
        """NFC and lower case by code point (white space is told apart later)."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = self.nfc.normalize_str(text)
            text = text.replace("Σ", "σ")  # no final-sigma rule in the file's normaliser
        return text.lower()

    def plain(self, text: str) -> bool:
        """False for texts that need the library itself: special tokens, unassigned code points."""
        if self.special is not None and self.special.search(text):
            return False
        return text.isascii() or "Cn" not in set(map(unicodedata.category, set(text)))

    def split(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(index of each word into the distinct words, the distinct words, words before each document)."""
        docs = [self.normal(t).encode() for t in texts]
        joined = b"\n".join(docs)
        ends = np.cumsum([len(d) + 1 for d in docs], dtype=np.int64)
        none = np.zeros(len(docs) + 1, np.int64)
        if not joined:
            return np.empty(0, np.int32), [], none
        raw = np.frombuffer(joined, np.uint8)
        kind, later = self._kinds(joined, raw)
        word = kind != SPACE
        start = word.copy()
        start[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        start[later] = False
        self._contractions(raw, kind, start)
        at = np.flatnonzero(start)
        if len(at) == 0:
            return np.empty(0, np.int32), [], none
        data = raw[word].tobytes()
        offsets = np.cumsum(word, dtype=np.int32)[at] - 1
        offsets = np.concatenate((offsets, [len(data)])).astype(np.int32)
        words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        per_doc = np.concatenate(([0], np.searchsorted(at, ends)))
        return np.asarray(words.indices), words.dictionary.to_pylist(), per_doc

    def _kinds(self, joined: bytes, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(kind of the code point that each byte belongs to, places of the bytes after a code point's first)."""
        lead = np.flatnonzero(raw >= 0xC0)
        first, second = raw[lead].astype(np.uint32), raw[lead + 1] & 0x3F
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = (first & (0x7F >> size)) << 6 | second
        for n in (3, 4):
            own = np.flatnonzero(size >= n)
            point[own] = point[own] << 6 | (raw[lead[own] + n - 1] & 0x3F)
        points = np.concatenate((np.flatnonzero(np.bincount(raw, minlength=128)[:128]), point))
        if (unknown := self.kind[points] == 0).any():
            self._learn(np.unique(points[unknown]))
        kind = np.frombuffer(joined.translate(self.kind[:256].tobytes()), np.uint8).copy()
        later = []
        wide = self.kind[point]
        kind[lead] = wide
        for n in (2, 3, 4):
            own = size >= n
            later.append(lead[own] + n - 1)
            kind[later[-1]] = wide[own]
        return kind, np.concatenate(later)

    @staticmethod
    def _contractions(raw: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
        """An apostrophe that begins a run takes 's 't 'm 'd 're 've 'll with it."""
        i = np.flatnonzero((raw == ord("'")) & start)
        i = i[i + 1 < len(raw)]
        i = i[kind[i + 1] == LETTER]
        if len(i) == 0:
            return
        last = len(raw) - 1
        a, b = raw[i + 1], raw[np.minimum(i + 2, last)]
        b = np.where(i + 2 <= last, b, 0)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | \
            ((a == ord("l")) & (b == ord("l")))
        start[i[one | two] + 1] = False
        after = np.concatenate((i[one] + 2, i[two] + 3))
        after = after[after <= last]
        start[after[kind[after] == LETTER]] = True


class WordTable:
    """Distinct word -> its token ids; ``encode`` maps sorted new words to (all their ids, ids of each).

    Flat arrays in hash order, some tens of bytes a word; a hit is compared with the word itself."""

    def __init__(self, encode: Callable[[list[str]], tuple[list[int], list[int]]], max_words: int = MAX_WORDS):
        self.encode, self.max_words = encode, max_words
        self._reset()

    def _reset(self) -> None:
        self.hashes = self.slot_of = np.empty(0, np.int64)  # sorted hashes and the slots they lead to
        self.words = pa.array([], pa.large_string())
        self.ids = np.empty(0, np.int32)
        self.start = self.size = np.empty(0, np.int64)

    def _find(self, hashes: np.ndarray, words: pa.Array) -> np.ndarray:
        """Slot of each word, -1 where it is new."""
        if len(self.hashes) == 0:
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        slots = np.where(self.hashes[at] == hashes, self.slot_of[at], 0)
        same = pc.equal(self.words.take(pa.array(slots)), words)
        return np.where(np.asarray(same) & (self.hashes[at] == hashes), slots, -1)

    def _add(self, hashes: np.ndarray, words: list[str]) -> np.ndarray:
        """Encode new words (in sorted order) and return their slots."""
        flat, sizes = self.encode(words)
        size, first = np.array(sizes, np.int64), len(self.start)
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, np.array(flat, np.int32)))
        self.words = pa.concat_arrays([self.words, pa.array(words, pa.large_string())])
        slots = np.arange(first, first + len(words))
        merged, slot_of = np.concatenate((self.hashes, hashes)), np.concatenate((self.slot_of, slots))
        order = np.argsort(merged, kind="stable")
        self.hashes, self.slot_of = merged[order], slot_of[order]
        return slots

    def lookup(self, indices: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        hashes = np.fromiter(map(hash, words), np.int64, len(words))
        slots = self._find(hashes, pa.array(words, pa.large_string()))
        new = np.flatnonzero(slots < 0)
        if len(self.start) + len(new) > self.max_words and len(self.start):
            self._reset()
            slots, new = np.full(len(words), -1), np.arange(len(words))
        if len(new):
            new = new[sorted(range(len(new)), key=[words[i] for i in new].__getitem__)]
            slots[new] = self._add(hashes[new], [words[i] for i in new])
        slots = slots[indices]
        size = self.size[slots]
        return self.ids[gather(self.start[slots], size)], size


def encode_texts(texts: list[str], splitter: WordSplitter, words: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, n + 1 offsets), as ``tok.encode(text, add_special_tokens=False)`` gives them."""
    odd = {i: splitter.tok.encode(t, add_special_tokens=False).ids
           for i, t in enumerate(texts) if not splitter.plain(t)}
    indices, distinct, per_doc = splitter.split([t if i not in odd else "" for i, t in enumerate(texts)] if odd
                                                else texts)
    ids, size = words.lookup(indices, distinct)
    offsets = np.concatenate(([0], np.cumsum(size)))[per_doc]
    if odd:
        parts = [np.asarray(odd[i], np.int32) if i in odd else ids[offsets[i]:offsets[i + 1]]
                 for i in range(len(texts))]
        ids = np.concatenate(parts)
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return ids.astype(np.int32, copy=False), offsets.astype(np.int64, copy=False)
