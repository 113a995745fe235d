"""Operators 11 to 13 against plain versions and the sentencepiece library."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from souk.llm import bpe, fim, lexical, sentencepieces
from souk.llm.common import table
from souk.llm.queries import QUERIES, unigram_path
from souk.session import scratch_dir
from tests.llm.conftest import tuples

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ------------------------------------------------------------------ op11
def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_search(docs, items, k):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    counts = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall(lower(t)))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in terms if t in c)
            if s > 0:
                found.append((-s, doc is None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(found[:k])]
    return sorted(out, key=repr)


def search(spark, docs, items, k, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x"))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    index = lexical.build_index(d, scratch_dir(spark, "index"))
    return sorted(map(tuple, lexical.search(index, i, k, **options).collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Ünï", "漢字", "x1"]
    text = lambda: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocab, weights=range(len(vocab), 0, -1), k=rng.randrange(0, 40)))
    return [(i, text()) for i in rng.sample(range(10 * n), n)], [(i, text()) for i in range(12)]


@pytest.mark.parametrize("k", [1, 7, 500])
def test_op11_equals_scoring_everything(spark, k):
    docs, items = corpus(k, 300)
    assert search(spark, docs, items, k) == plain_search(docs, items, k)


def test_op11_small_blocks_packs_and_steps(spark, monkeypatch):
    docs, items = corpus(3, 400)
    for name, value in (("BLOCK_DOCS", 16), ("STEP_CELLS", 32), ("WAITING_CELLS", 64)):
        monkeypatch.setattr(lexical, name, value)  # the closures that tasks run carry no module state: also held below
    assert search(spark, docs, items, 9, pack_terms=20) == plain_search(docs, items, 9)


def test_op11_descent_with_small_steps_and_many_blocks(monkeypatch):
    """The same descent in this process, where the small sizes are sure to hold."""
    docs, items = corpus(11, 500)
    docs.sort()
    monkeypatch.setattr(lexical, "STEP_CELLS", 16)
    monkeypatch.setattr(lexical, "WAITING_CELLS", 40)
    n = lexical.count_terms(pa.array([t for _, t in docs], pa.large_string()))
    n_docs, total = int((n > 0).sum()), int(n.sum())
    best = [lexical.Best(10) for _ in items]
    df = Counter(t for _, text in docs for t in set(TERM.findall(lower(text))))
    for at in range(0, len(docs), 70):
        part = docs[at:at + 70]
        texts, ids = pa.array([t for _, t in part], pa.large_string()), np.array([i for i, _ in part])
        block = lexical._Block()
        doc, term, tf, terms = lexical.term_counts(texts)
        block.add(ids, lexical.count_terms(texts), doc, term, tf, terms)
        made = block.close(n_docs, total)
        arrays = [np.frombuffer(made.column(i)[0].as_py(), d) for i, d in zip(range(4, 8), ("u1", "<u4", "<u4", "<u4"))]
        treap = lexical.Treap(made.column(3)[0].as_py(), *arrays)
        treap.open()
        names = {t: r for r, t in enumerate(made.column(1)[0].as_py())}
        assert list(names) == sorted(names) and sum(made.column(2)[0].as_py()) == len(doc)
        for (_, text), b in zip(items, best):
            asked = [t for t in set(TERM.findall(lower(text))) if t in names]
            weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in asked], np.int64)
            if asked:
                treap.search(np.array([names[t] for t in asked]), weights, b, np.frombuffer(made.column(0)[0].as_py(), "<i8"))
    got = sorted(((i, r + 1, int(d), int(s)) for (i, _), b in zip(items, best) for r, (d, s) in enumerate(zip(b.id, b.score))), key=repr)
    assert got == plain_search(docs, items, 10)


def test_op11_nulls_ties_copies_and_long_texts(spark):
    docs = [(5, "same words here"), (3, "same words here"), (3, "same words here"), (None, "same words here"), (9, "SAME Words\x00here!"),
            (1, None), (2, ""), (4, " .,;"), (6, "other " * 30000 + "words"), (7, "漢字 ünï")]
    items = [(1, "same words"), (2, None), (3, ""), (4, "漢字"), (5, "missing"), (None, "other"), (1, "here"), (6, "?!")]
    for k in (2, 50):
        assert search(spark, docs, items, k) == plain_search(docs, items, k)


def test_op11_empty_tables(spark):
    assert search(spark, [], [(1, "a")], 5) == []
    assert search(spark, [(1, None), (2, "..")], [(1, "a")], 5) == []
    assert search(spark, [(1, "a")], [], 5) == []


# ------------------------------------------------------------------ op12
@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=unigram_path())


def odd_texts(seed, n):
    rng = random.Random(seed)
    signs = " \t\nabcdeéß漢字▁<s>0x0A😀́\x00'\"-__  1234567890thein"
    pieces = list(sentencepieces.codec(unigram_path()).encoder.id)
    texts = ["", " ", "▁", "▁▁ a", "<s>", "</s> <unk> <0x0A>", "x" * 5000, " " * 3000, "a" * 4000 + " " * 77 + "the" * 300]
    texts += ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(n)]
    texts += ["".join(rng.choices(" ae", k=rng.randrange(80))) for _ in range(n)]
    return texts + ["".join(rng.choices(pieces, k=rng.randrange(1, 8))) for _ in range(n)]


def test_op12_ids_and_texts_equal_the_library(library):
    texts, codec = odd_texts(1, 2000), sentencepieces.codec(unigram_path())
    ids, offsets = codec.encode(pa.array(texts, pa.large_string()))
    lists = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]
    assert lists == [[1, *x, 2] for x in library.encode(texts)]
    assert codec.decode(ids, offsets).to_pylist() == [library.decode(x) for x in lists]
    bare, at = codec.encode(pa.array(texts, pa.large_string()), ends=False)
    assert [bare[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [x[1:-1] for x in lists]


def test_op12_decodes_any_ids_as_the_library(library):
    rng = random.Random(2)
    lists = [[rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(260) for _ in range(rng.randrange(12))] for _ in range(4000)]
    offsets = np.cumsum([0, *map(len, lists)])
    flat = np.array([x for ids in lists for x in ids], np.int32)
    assert sentencepieces.codec(unigram_path()).decode(flat, offsets).to_pylist() == [library.decode(x) for x in lists]


def test_op12_neighbours_decide_the_encoding():
    """What the method rests on: a sequence is the merge result if and only if all its neighbours re-merge into themselves."""
    rng, enc = random.Random(4), sentencepieces.codec(unigram_path()).encoder
    for _ in range(300):
        word = "".join(rng.choices("theinrasdo ", k=rng.randrange(1, 12)))
        parts = [enc.id[p] for p in enc.remerge(word)]
        assert enc.encode_word(word) == parts and all(enc.compatible(a, b) for a, b in zip(parts, parts[1:]))


def test_op12_tables_stay_bounded(library, monkeypatch):
    monkeypatch.setattr(sentencepieces, "MAX_PAIRS", 50)
    monkeypatch.setattr(sentencepieces, "MAX_WORD_BYTES", 500)
    codec = sentencepieces.Codec(unigram_path())
    for seed in range(4):
        texts = odd_texts(seed, 60)
        ids, offsets = codec.encode(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [[1, *x, 2] for x in library.encode(texts)]
        assert len(codec.encoder.pairs) <= 50


def test_op12_on_hard_rows(spark, hard_docs, no_docs, library):
    rows = tuples(sentencepieces.encode(hard_docs, unigram_path()))
    want = sorted(((r["doc_id"], [1, *library.encode(r["text"] or ""), 2]) for r in hard_docs.collect()),
                  key=lambda r: tuple((x is not None, x) for x in r))
    assert rows == want
    back = sentencepieces.decode(sentencepieces.encode(hard_docs, unigram_path()), unigram_path())
    assert tuples(back) == sorted(((r["doc_id"], r["text"] or "") for r in hard_docs.collect()), key=lambda r: tuple((x is not None, x) for x in r))
    empty = sentencepieces.round_trip(no_docs, unigram_path(), bpe.digests, bpe.DIGEST_SCHEMA)
    assert empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and empty.count() == 0
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert tuples(sentencepieces.decode(nothing, unigram_path())) == [(1, ""), (2, "")]


def test_op12_query_over_its_table(spark, library):
    def digests(text):
        ids = [1, *library.encode(text or ""), 2]
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    want = sorted((r["doc_id"], *digests(r["text"])) for r in table(spark, SF, "documents").collect())
    got = QUERIES["op12_sentencepiece"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == want


# ------------------------------------------------------------------ op13
def plain_fim(i, text):
    text = text or ""
    parts = TOKEN.findall(text)
    h = [int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[8 * j:8 * j + 8], 16) for j in range(4)]
    a, z = sorted(x % (len(parts) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (parts[:a], parts[a:z], parts[z:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return i, len(parts), "plain", None, None, text
    if h[3] % 100 < 80:
        return i, len(parts), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(parts), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_op13_equals_the_plain_version_and_restores(spark, hard_rows):
    rng = random.Random(8)
    rows = hard_rows + [(1000 + i, "".join(rng.choices(" \t\n\x0b\x1cab漢<PSM>é\x00\xa0", k=rng.randrange(30)))) for i in range(2000)]
    rows += [(5000 + i, x) for i, x in enumerate(["<P>", "a <S> b", "x<M>", "<", "<P", "> <S", " <M ", "<<P S>"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("output", F.lit(1)).withColumn("n", F.lit("n"))
    made = fim.transform(docs)
    assert tuples(made) == order(plain_fim(i, t) for i, t in rows)
    back = made.select("doc_id", fim.restored(F.col("form"), F.col("output")).alias("text"))
    assert tuples(back) == order((i, t or "") for i, t in rows)
    assert {r["form"] for r in made.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_op13_borders_of_tokens_and_lines():
    rng = random.Random(9)
    texts = ["", " ", "\n", "\n\n", "a", "a\n", " a\n\nb "] + ["".join(rng.choices(" \n\tab漢", k=rng.randrange(25))) for _ in range(500)]
    for unit, pattern in (("token", TOKEN), ("line", re.compile(r"[^\n]*\n|[^\n]+"))):
        parts = [pattern.findall(t) for t in texts]
        borders = fim.Borders(texts, unit)
        n = borders.units()
        assert n.tolist() == [len(p) for p in parts]
        for k in range(30):
            at = np.minimum(k, n)
            got = borders.cut(np.arange(len(texts)), at, n)
            assert got.tolist() == [sum(map(len, p[:x])) for p, x in zip(parts, at)]


def test_op13_ranks_of_the_wavelet_matrix():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 16, size).astype(np.uint8)
        matrix, at = fim.WaveletMatrix(symbols, 4), np.arange(size + 1)
        for s in range(16):
            assert matrix.rank(s, at).tolist() == np.concatenate(([0], np.cumsum(symbols == s))).tolist()


def test_op13_empty_table_and_shares(spark, no_docs):
    assert fim.transform(no_docs).count() == 0
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('some words ', id, ' more of them') AS text")
    forms = {r["form"]: r["count"] for r in fim.transform(docs, rate=90, spm_share=0, unit="line").groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm"} and 1700 < forms["psm"] < 1900
