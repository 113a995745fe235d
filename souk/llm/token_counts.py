"""Operator 2: token counts under a unigram model, by dynamic programming shared over a trie.

Pre-tokens are runs of anything but ASCII white space, with the vocabulary's word mark in front. Distinct pre-tokens are
taken in sorted order, the depth-first order of their trie. Each node (prefix) holds the forward score of its best
segmentation and that segmentation's length; a prefix shared by many words is computed once, and a word's terminal
node holds its count. Documents add up the counts of their words.

Piece scores come from the vocabulary file's own order: the r-th piece has log-probability -log(r + 1) - log(sum 1 / i)
(Zipf's law); nothing is trained. A character without a piece costs ten more than the rarest piece and counts as
its UTF-8 bytes. Equal scores prefer the longer last piece.

Defined results: null or empty text has 0 tokens, 0 words and score 0; repeated rows are counted row by row; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from souk.llm.common import raw_text, text_steps

MARK, MISSING_PENALTY = "▁", 10.0

#: Words whose counts a worker remembers; beyond it the table starts anew. Changes speed, never results.
MAX_WORDS = 1_000_000

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def piece_scores(path: str) -> dict[str, float]:
    """Normal pieces of a sentencepiece file with their Zipf log-probabilities, in file order."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())
              if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    total = math.log(math.fsum(1 / i for i in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - total for r, p in enumerate(pieces, 1)}


class TrieCounter:
    """Counts and scores of sorted distinct words; the prefix of a word that the word before had is not computed again."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.missing = min(scores.values(), default=0.0) - MISSING_PENALTY

    def __call__(self, words: list[str]) -> tuple[list[int], list[float]]:
        find, longest, missing = self.scores.get, self.longest, self.missing
        best, count, before = [0.0], [0], ""  # by prefix length
        counts, totals = [], []
        for w in words:
            s = MARK + w
            n, shared = len(s), 0
            for a, b in zip(s, before):
                if a != b:
                    break
                shared += 1
            del best[shared + 1:], count[shared + 1:]
            for i in range(shared + 1, n + 1):
                top, k = best[i - 1] + missing, -1
                for j in range(max(0, i - longest), i):
                    score = find(s[j:i])
                    if score is not None and (k < 0 or best[j] + score > top):
                        if best[j] + score > top:
                            top, k = best[j] + score, j
                if k < 0:
                    k, tokens = i - 1, len(s[i - 1].encode())
                else:
                    tokens = 1
                best.append(top)
                count.append(count[k] + tokens)
            counts.append(count[n])
            totals.append(best[n])
            before = s
        return counts, totals


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(index of each word into the distinct words, the distinct words, words before each document)."""
    data, offsets = raw_text(texts)
    none = np.zeros(len(offsets), np.int64)
    if len(data) == 0:
        return np.empty(0, np.int32), [], none
    word = ~_WHITE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = word[cuts]
    at = np.flatnonzero(first)
    if len(at) == 0:
        return np.empty(0, np.int32), [], none
    kept = np.cumsum(word, dtype=np.int64)
    starts = np.concatenate((kept[at] - 1, [kept[-1]])).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(starts), pa.py_buffer(data[word].tobytes())).dictionary_encode()
    return np.asarray(words.indices), words.dictionary.to_pylist(), np.searchsorted(at, offsets)


class Counter:
    """Word table of one vocabulary."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        self.trie, self.max_words = TrieCounter(piece_scores(path)), max_words
        self.table: dict[str, tuple[int, float]] = {}

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, words, score) of each text."""
        indices, words, per_doc = split_words(texts)
        if len(self.table) + len(words) > self.max_words:
            self.table = {}
        new = sorted(w for w in words if w not in self.table)
        self.table.update(zip(new, zip(*self.trie(new))))
        tokens = np.fromiter((self.table[w][0] for w in words), np.int64, len(words))
        score = np.fromiter((self.table[w][1] for w in words), np.float64, len(words))
        sums = [np.concatenate((np.zeros(1, x.dtype), np.cumsum(x[indices]))) for x in (tokens, score)]
        return np.diff(sums[0][per_doc]), np.diff(per_doc), np.diff(sums[1][per_doc])


@functools.lru_cache(maxsize=1)
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_words, log_prob) of every row's whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches):
            tokens, words, score = _counter(path).count(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens), pa.array(words.astype(np.int64)), pa.array(np.round(score, 3))],
                                             ["id", "n_tokens", "n_words", "log_prob"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(
        run, f"id {kind}, n_tokens bigint, n_words bigint, log_prob double")
    return out.withColumnRenamed("id", id_col)
