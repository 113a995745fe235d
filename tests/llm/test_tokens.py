"""Operators 2, 3 and 7 against the tokenizers library and plain dynamic programming."""

import hashlib
import math
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from souk.llm import bpe, token_counts, token_files
from souk.llm.queries import unigram_path, word_bpe_path
from souk.llm.words import WordSplitter
from tests.llm.conftest import tuples


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_bpe_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_trie_encoder_equals_library_on_random_texts(library):
    rng, codec = random.Random(3), bpe.Codec(word_bpe_path())
    alphabet = "abcdefeéèßnt'  !!12.,lvrsmd\n\tΣσäAŹ́ 漢ﬁǅ½"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    got = codec.encode(texts)
    assert got.to_pylist() == [ids_of(library, t) for t in texts]
    assert codec.decode(got).to_pylist() == [library.decode(ids_of(library, t), skip_special_tokens=False) for t in texts]


def test_words_are_split_on_bytes_as_the_library_does(library):
    rng, splitter = random.Random(5), WordSplitter(library)
    raw = "é漢 😀1".encode()
    kind, later = splitter._kinds(raw, np.frombuffer(raw, np.uint8))
    assert sorted(later.tolist()) == [1, 3, 4, 7, 8, 9] and kind.tolist() == [2, 2, 2, 2, 2, 1, 4, 4, 4, 4, 3]
    alphabet = "aZé߿ࠀ漢𝟘𝄞😀𐍈١²1'sre ,\u00a0\u3000\n\u07fe\uffed"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(2000)]
    got = bpe.Codec(word_bpe_path()).encode(texts)
    assert got.to_pylist() == [ids_of(library, t) for t in texts]


def test_word_table_reset_changes_nothing(library):
    small = bpe.Codec(word_bpe_path())
    small.words.max_words = 3
    texts = ["the cat sat", "the mat and a hat", "", "cat hat mat the"]
    assert [x for t in texts for x in small.encode([t]).to_pylist()] == [ids_of(library, t) for t in texts]


def test_op7_rows(spark, library, hard_docs, hard_rows):
    got = tuples(bpe.round_trip(hard_docs, word_bpe_path(), bpe.digests, bpe.DIGEST_SCHEMA))
    want = []
    for i, t in hard_rows:
        ids = ids_of(library, t)
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_op7_encode_then_decode_frames(spark, library, hard_docs, hard_rows):
    encoded = bpe.encode(hard_docs, word_bpe_path())
    assert {(r[0], tuple(r[1])) for r in encoded.collect()} == {(i, tuple(ids_of(library, t))) for i, t in hard_rows}
    decoded = {(r[0], r[1]) for r in bpe.decode(encoded, word_bpe_path()).collect()}
    assert decoded == {(i, library.decode(ids_of(library, t), skip_special_tokens=False)) for i, t in hard_rows}


def test_empty_tables(spark, no_docs, tmp_path):
    assert bpe.round_trip(no_docs, word_bpe_path(), bpe.digests, bpe.DIGEST_SCHEMA).collect() == []
    assert token_counts.count_tokens(no_docs, unigram_path()).collect() == []
    token_files.write_tokens(no_docs, str(tmp_path / "t"), word_bpe_path(), 2)
    assert token_files.token_index(spark, str(tmp_path / "t")).collect() == []


def test_op3_files(spark, library, hard_docs, hard_rows, tmp_path):
    out = str(tmp_path / "tokens")
    token_files.write_tokens(hard_docs, out, word_bpe_path(), end_id=2)
    got = sorted(token_files.token_index(spark, out).collect(), key=lambda r: r["start"])
    want = {}
    for i, t in hard_rows:
        ids = [*ids_of(library, t), 2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in hard_rows), key=lambda i: (i is not None, i))
    start = 0
    for r in got:
        assert r["start"] == start and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        start += r["n_tokens"]
    assert not any(want.values())


def test_op3_format_is_indexed_and_dictionary_coded(spark, hard_docs, tmp_path):
    out = tmp_path / "tokens"
    token_files.write_tokens(hard_docs, str(out), word_bpe_path(), end_id=2)
    for f in sorted(out.glob("part-*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert all(c.has_column_index and c.has_offset_index for n, c in columns.items() if not n.startswith("ids"))
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            ids = next(c for n, c in columns.items() if n.startswith("ids"))
            assert ids.has_offset_index and any("DICTIONARY" in e for e in ids.encodings)
    plan = token_files.read_tokens(spark, str(out)).select("doc_id", "n_tokens").filter("doc_id = 3")._jdf.queryExecution().toString()
    assert "ids" not in plan.split("ReadSchema")[-1]  # metadata reads leave the ids alone


def brute_unigram(word, scores, missing):
    s = token_counts.MARK + word
    best = [(0.0, 0)] + [None] * len(s)
    for i in range(1, len(s) + 1):
        options = [(best[j][0] + scores[s[j:i]], i - j, best[j][1] + 1) for j in range(i) if s[j:i] in scores]
        options = [o for o in options if o[0] > best[i - 1][0] + missing]
        top = max(options) if options else (best[i - 1][0] + missing, 1, best[i - 1][1] + len(s[i - 1].encode()))
        best[i] = (top[0], top[2])
    return best[-1]


def test_op2_rows(spark, hard_docs, hard_rows):
    scores = token_counts.piece_scores(unigram_path())
    missing = min(scores.values()) - token_counts.MISSING_PENALTY
    got = {}
    for r in token_counts.count_tokens(hard_docs, unigram_path()).collect():
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["n_words"], r["log_prob"]))
    seen = {}
    for i, t in hard_rows:
        parts = [x for x in (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        found = [seen.setdefault(w, None) or seen.__setitem__(w, brute_unigram(w, scores, missing)) or seen[w] for w in parts]
        want = (sum(f[1] for f in found), len(parts), math.fsum(f[0] for f in found))
        match = [g for g in got[i] if g[:2] == want[:2] and abs(g[2] - want[2]) < 0.01]
        assert match, (i, want, got[i])
        got[i].remove(match[0])
    assert not any(got.values())


def test_op2_counts_equal_a_unigram_model_of_the_library():
    scores = token_counts.piece_scores(unigram_path())
    model = Tokenizer(Unigram([("<unk>", 0.0), *scores.items()], 0, False))
    rng = random.Random(9)
    words = sorted({"".join(rng.choice("abcdeinorstéä") for _ in range(rng.randrange(1, 14))) for _ in range(2000)})
    counts, _ = token_counts.TrieCounter(scores)(words)
    assert counts == [len(model.encode(token_counts.MARK + w).ids) for w in words]


def test_op2_split_of_bytes():
    index, words, per_doc = token_counts.split_words(pa.array(["a b", "", "b\tç\r\nb ", " "], pa.large_string()))
    assert [words[i] for i in index] == ["a", "b", "b", "ç", "b"]
    assert np.diff(per_doc).tolist() == [2, 0, 3, 0]


def test_op3_offsets_follow_file_numbers_beyond_five_digits(spark, tmp_path):
    names = ["part-99998-a-c000.zstd.parquet", "part-99999-a-c000.zstd.parquet", "part-99999-a-c001.zstd.parquet",
             "part-100000-a-c000.zstd.parquet", "part-100001-a-c000.zstd.parquet"]
    for i, name in enumerate(names):
        ids = list(range(i + 1))
        pq.write_table(pa.table({"doc_id": pa.array([i]), "n_tokens": pa.array([len(ids)], pa.int32()),
                                 "ids": pa.array([ids], pa.list_(pa.int32()))}), tmp_path / name)
    rows = token_files.token_index(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["start"] for r in rows] == [0, 1, 3, 6, 10]
