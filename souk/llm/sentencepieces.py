"""Operator 12: SentencePiece (merge type) encoding by backtracking, and decoding.

A merge-type encoding is the one sequence of pieces in which every two neighbours, written together and merged anew, come
out as themselves. So a word is encoded from left to right: an Aho-Corasick automaton gives the longest piece at
each position; a piece is taken if it is compatible with the one before and the position after it has not failed;
else the next shorter piece (its longest proper prefix among the pieces) is tried; if none is left the position is marked in a
bitfield of failed positions and the piece before is taken back. No position fails twice, so the work is linear.

Compatibility is checked by re-merging the two pieces' characters, best score first and leftmost among equals, and is
remembered. Where no piece holds a space after another character (read from the model), no merge crosses such a
border: texts are cut there and each distinct word is encoded once a worker, through flat, bounded tables.

Defined results: null or empty text holds the begin and end ids alone and decodes to ''; characters that no piece holds
become byte pieces; control symbols' strings in a text are ordinary text; repeated rows and null ids are encoded row by row; very
long texts make one step of their own; an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb

from souk.llm.common import raw_text, text_steps
from souk.llm.words import WordTable

#: Text bytes a vectorised step works on, neighbours whose compatibility and words' bytes a worker remembers (speed only).
STEP_BYTES, MAX_PAIRS, MAX_WORD_BYTES = 1 << 20, 1_000_000, 16 << 20

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class Backtracker:
    """Exact merge-type encoding of words, in which a space stands for the model's space symbol."""

    def __init__(self, proto: model_pb.ModelProto):
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i, p in enumerate(proto.pieces):
            if p.type == _NORMAL:
                text = p.piece.replace(SPACE, " ")
                self.score[text], self.id[text] = p.score, i
            elif p.type == _BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = i
        kinds = {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != 2 or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} or len(self.bytes) != 256:
            raise ValueError("a merge-type model with byte pieces and without user symbols is needed")
        if any(c not in self.id for t in self.id for c in t):
            raise ValueError("every character of a piece must be a piece")
        #: Whether no piece holds a space after another character, so that texts can be cut there.
        self.cuts = not any(b == " " != a for t in self.id for a, b in zip(t, t[1:]))
        self.text = {i: t for t, i in self.id.items()}
        self.shorter = {i: next((self.id[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.id), -1) for t, i in self.id.items()}
        self.matches = ahocorasick.Automaton()
        for t, i in self.id.items():
            self.matches.add_word(t, (len(t), i))
        self.matches.make_automaton()
        self.size = {i: len(t) for i, t in self.text.items()}
        self.whole: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}

    def remerge(self, text: str) -> list[str]:
        """The merges themselves: the best score first, the leftmost among equals."""
        parts, score = list(text), self.score.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def alone(self, token: int) -> bool:
        """Whether the piece's own characters merge into it."""
        ok = self.whole.get(token)
        if ok is None:
            ok = self.whole[token] = self.remerge(self.text[token]) == [self.text[token]]
        return ok

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces, written together, merge into themselves; a negative id is a character of no piece."""
        if left < 0 or right < 0:
            return right < 0 or self.alone(right)
        key = left << 32 | right
        ok = self.pairs.get(key)
        if ok is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            a, b = self.text[left], self.text[right]
            ok = self.pairs[key] = self.remerge(a + b) == [a, b]
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Piece ids of the word; -1 - code point for a character of no piece."""
        own = self.id.get(word)
        if own is not None and self.alone(own):
            return [own]
        n = len(word)
        longest, length = [-1] * n, [0] * n
        for end, (size, token) in self.matches.iter(word):
            start = end - size + 1
            if size > length[start]:
                length[start], longest[start] = size, token
        failed = bytearray(n + 1)  # the bitfield
        out: list[int] = []
        at, token = 0, longest[0] if length[0] else -1 - ord(word[0])
        sizes, shorter, known = self.size, self.shorter, self.pairs.get
        while at < n:
            end = at + sizes[token] if token >= 0 else at + 1
            if failed[end]:
                fits = False
            elif out:
                fits = known(out[-1] << 32 | token)
                if fits is None:
                    fits = self.compatible(out[-1], token)
            else:
                fits = token < 0 or self.alone(token)
            if fits:
                out.append(token)
                at = end
                if at < n:
                    token = longest[at] if length[at] else -1 - ord(word[at])
            elif token >= 0 and shorter[token] >= 0:
                token = shorter[token]
            else:
                if not out:
                    raise ValueError(f"no encoding of {word[:50]!r}")
                failed[at] = 1
                token = out.pop()
                at -= sizes[token] if token >= 0 else 1
        return out

    def __call__(self, words: list[str]) -> tuple[list[int], list[int]]:
        """(ids of all words, number of ids of each)."""
        flat, counts = [], []
        for w in words:
            ids = self.encode_word(w)
            if min(ids) < 0:
                ids = [j for i in ids for j in ([i] if i >= 0 else [self.bytes[x] for x in chr(-1 - i).encode()])]
            flat += ids
            counts.append(len(ids))
        return flat, counts


class Codec:
    """Encoder and decoder of one model file with an identity normaliser."""

    def __init__(self, path: str):
        proto = model_pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces \
                or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only an identity normaliser that keeps white space is supported")
        self.dummy = spec.add_dummy_prefix
        self.encoder = Backtracker(proto)
        self.words = WordTable(self.encoder)
        lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.begin, self.end, self.n_ids = lib.bos_id(), lib.eos_id(), lib.get_piece_size()
        kinds = [p.type for p in proto.pieces]
        value = {i: bytes([b]) for b, i in self.encoder.bytes.items()}
        surface = [b"" if k == _CONTROL else proto.trainer_spec.unk_surface.encode() if k == _UNKNOWN else
                   value[i] if k == _BYTE else p.piece.replace(SPACE, " ").encode()
                   for i, (p, k) in enumerate(zip(proto.pieces, kinds))]
        #: Every id's bytes, and again without their first space.
        self.surface = pa.array(surface + [s.removeprefix(b" ") for s in surface], pa.large_binary())
        self.silent = np.array([k == _CONTROL for k in kinds])
        self.spaced = np.array([k == _NORMAL and p.piece.startswith(SPACE) for p, k in zip(proto.pieces, kinds)])

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(index of each word into the distinct words, the distinct words, words before each text)."""
        texts = pc.replace_substring(texts, SPACE, " ")  # one symbol for both, as the escaped text has
        if self.dummy:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (" ", texts, ""))))
            texts = texts.cast(pa.large_string())
        data, offsets = raw_text(texts)
        n = len(data)
        start = np.zeros(n, bool)
        if self.encoder.cuts and n:
            start[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        start[first] = True
        at = np.flatnonzero(start)
        if len(at) == 0:
            return np.empty(0, np.int32), [], np.zeros(len(texts) + 1, np.int64)
        cuts = np.concatenate((at, [n])).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        return np.asarray(words.indices), words.dictionary.to_pylist(), np.searchsorted(at, offsets)

    def encode(self, texts: pa.Array, ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets) of a non-null large_string array; ``ends`` adds the begin and end ids."""
        indices, words, per_doc = self._split(texts)
        if self.words.words.nbytes > MAX_WORD_BYTES:
            self.words._reset()
        ids, size = self.words.lookup(indices, words) if words else (np.empty(0, np.int32), np.empty(0, np.int64))
        offsets = np.concatenate(([0], np.cumsum(size)))[per_doc]
        if ends:
            rows = len(texts)
            both = np.concatenate((offsets[:-1], offsets[1:]))
            marks = np.concatenate((np.full(rows, self.begin), np.full(rows, self.end)))
            order = np.argsort(np.concatenate((np.arange(rows) * 2, np.arange(rows) * 2 + 1)), kind="stable")
            ids = np.insert(ids, both[order], marks[order])
            offsets = offsets + 2 * np.arange(rows + 1)
        return ids.astype(np.int32, copy=False), offsets.astype(np.int64, copy=False)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """large_string array: what the library's decode(ids) gives for each list.

        Byte pieces stand for their byte; a byte that is part of no well-formed character becomes U+FFFD."""
        if self.dummy and len(ids):  # the space that encoding put first
            loud = np.flatnonzero(~self.silent[ids])
            first = np.append(loud, len(ids))[np.searchsorted(loud, offsets[:-1])]
            first = first[first < offsets[1:]]
            ids = ids.copy()
            ids[first[self.spaced[ids[first]]]] += self.n_ids
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), self.surface.take(pa.array(ids)))
        raw = pc.binary_join(lists, pa.scalar(b"", pa.large_binary()))
        try:
            text = raw.cast(pa.large_string())  # checks that all are well formed
        except pa.ArrowInvalid:
            text = pa.array([utf8(r) for r in raw.to_pylist()], pa.large_string())
        return text


def utf8(raw: bytes) -> str:
    """Well-formed UTF-8 characters; every other byte becomes U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for n in range(1, 5):
            try:
                out.append(raw[at:at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@functools.lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ends: bool = True) -> DataFrame:
    """(id, ids array<int>) of every row's whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, step_bytes=STEP_BYTES):
            ids, offsets = codec(path).encode(b.column(1), ends)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets.astype(np.int32), ids)], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text string) of every list of ids; a null list gives ''."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = pc.fill_null(b.column(1), pa.scalar([], b.column(1).type))
            offsets = np.asarray(lists.offsets).astype(np.int64)
            ids = np.asarray(lists.values)[offsets[0]:offsets[-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), codec(path).decode(ids, offsets - offsets[0]).cast(pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    out = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, finish: Callable[[pa.ListArray, pa.Array], list[pa.Array]], schema: str,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids again, and keep what ``finish(ids, decoded)`` makes of both, in one Python stage."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, step_bytes=STEP_BYTES):
            ids, offsets = codec(path).encode(b.column(1))
            made = finish(pa.ListArray.from_arrays(offsets.astype(np.int32), ids), codec(path).decode(ids, offsets))
            yield pa.RecordBatch.from_arrays([b.column(0), *made], [str(i) for i in range(len(made) + 1)])

    kind = docs.schema[id_col].dataType.simpleString()
    fields = [c.split() for c in schema.split(",")]
    inner = ", ".join(f"`{i}` {k}" for i, k in enumerate([kind, *(k for _, k in fields)]))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, inner).toDF(id_col, *(name for name, _ in fields))
