"""Operators 8 and 9 and their helpers against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from souk.llm import bloom, components, exact_dedup, minhash
from tests.llm.conftest import DOC_SCHEMA, tuples, words


def smallest(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def test_op9_rows(hard_docs, hard_rows):
    groups = {}
    for i, t in hard_rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = [(i, smallest(ids), len(ids), i == smallest(ids), hashlib.sha256(t.encode()).hexdigest())
            for t, ids in groups.items() for i in ids]
    assert tuples(exact_dedup.exact_groups(hard_docs)) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("max_bits", [1 << 13, 1 << 28])
def test_op9_filter_size_never_changes_a_result(spark, max_bits):
    rows = [(i, f"text {i % 700}", None, "s", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    got = exact_dedup.exact_groups(docs, max_bits=max_bits).collect()
    assert len(got) == 3000 and all(r["keep_id"] == r["doc_id"] % 700 for r in got)
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(docs, max_bits=max_bits).collect()) == list(range(700))


def test_op9_deduplicate_keeps_columns_and_one_of_repeated_rows(hard_docs, hard_rows):
    out = exact_dedup.deduplicate(hard_docs)
    assert out.columns == hard_docs.columns and out.dtypes == hard_docs.dtypes
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    normal = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in got]
    assert len(set(normal)) == len(normal) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in hard_rows})
    assert [i for i, t in got if t and t.startswith(hard_rows[6][1]) and "extra" not in t] == [6]


def test_empty_tables(no_docs):
    assert exact_dedup.exact_groups(no_docs).collect() == [] and exact_dedup.deduplicate(no_docs).collect() == []
    assert minhash.near_duplicates(no_docs).collect() == [] and minhash.keep_one(no_docs).collect() == []


def test_bloom_filter_holds_all_keys_and_few_others(spark):
    keys = spark.range(5000).select((F.col("id") * 977).alias("key"))
    held = bloom.build_filter(keys)
    assert held.contains(np.arange(5000, dtype=np.int64) * 977).all()
    assert held.contains(np.arange(5000, dtype=np.int64) * 977 + 5).mean() < 0.05
    twice = bloom.build_filter(keys.unionByName(keys.filter("key % 2 = 0")), repeated=True)
    assert twice.contains(np.arange(0, 5000, 2, dtype=np.int64) * 977).all()
    assert twice.contains(np.arange(1, 5000, 2, dtype=np.int64) * 977).mean() < 0.05


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4)))


def brute_components(rows, percent):
    """Component of each document id; rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                label[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = rng.choice("xyzuvw") * 3
    return " ".join(w)


@pytest.fixture(scope="module")
def near_rows():
    """A large group of chained near copies around the threshold, small groups, shared passages, short texts."""
    rng = random.Random(11)
    rows, passage = [], words(rng, 40)
    seedling = words(rng, 120)
    chain = seedling
    for _ in range(90):
        rows.append(edited(rng, seedling, rng.randrange(0, 7)))
        chain = edited(rng, chain, 1)
        rows.append(chain)
    for _ in range(30):
        base = words(rng, rng.randrange(5, 200))
        rows += [base, edited(rng, base, 1), base.upper(), base + " " + words(rng, rng.randrange(1, 30))]
    rows += [words(rng, 30) + " " + passage for _ in range(60)]
    rows += [words(rng, n) for n in (1, 1, 2, 3, 4, 4, 5)] * 3 + ["", None, " \n"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("percent", [80, 85])
def test_op8_rows(spark, near_rows, percent):
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in near_rows], DOC_SCHEMA)
    want = brute_components(near_rows, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, percent).collect()}
    assert got == want
    kept = sorted(r["doc_id"] for r in minhash.keep_one(docs, percent).collect())
    assert kept == [i for i, (_, c) in want.items() if c == i]


def test_op8_blocks_change_nothing(spark, near_rows, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 16)
    monkeypatch.setattr(minhash, "GROUP_BLOCK", 2000)
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in near_rows], DOC_SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 85).collect()}
    assert got == {i: c for i, (_, c) in brute_components(near_rows, 85).items()}


def test_op8_hard_rows(hard_docs, hard_rows):
    got = minhash.near_duplicates(hard_docs, 85).collect()
    assert len(got) == len(hard_rows)
    unique = {i: t for i, t in hard_rows if i is not None and i != 100}
    want = brute_components(list(unique.items()), 85)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        elif r["doc_id"] != 100:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert minhash.keep_one(hard_docs, 85).columns == hard_docs.columns


def test_op8_ids_with_several_texts_keep_all_links(spark):
    rng = random.Random(4)
    a, b, c = (words(rng, 120) for _ in range(3))
    rows = [(200 * g + i, t) for g in range(6) for i, t in  # either text may have the smaller hash
            [(100, f"g{g} " + a.replace(" ", f" {g}", 30)), (100, f"g{g} " + b.replace(" ", f" {g}", 30)), (105, f"g{g} " + b.replace(" ", f" {g}", 30)),
             (106, f"g{g} " + b.replace(" ", f" {g}", 30) + " end")]]
    rows += [(5000, c), (5002, c), (5001, c + " far " + a), (5002, c + " far " + a), (5003, ""), (5003, c + " more"), (5004, ""), (5004, "one")]
    texts, want = {}, {}
    for i, t in rows:
        texts.setdefault(i, []).append(shingles(t))
    near = lambda x, y: bool(x & y) and 100 * len(x & y) >= 85 * len(x | y)
    for i in sorted(texts):
        todo = [] if i in want else [i]
        while todo:
            j = todo.pop()
            want[j] = i
            todo += [k for k in texts if k not in want and any(near(x, y) for x in texts[j] for y in texts[k])]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], DOC_SCHEMA)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, 85).collect())
    assert got == sorted((i, len(shingles(t)), want[i]) for i, t in rows)
    assert want[106] == 100 and want[5001] == want[5003] == 5000


def test_op8_many_rows_of_one_id_and_text_give_one_set(spark, monkeypatch):
    """3,000 rows of one document beside a near copy: the written sets hold one row a class."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(0, text)] * 3000 + [(7, text + " end"), (8, "another text of more than five words")]
    docs, seen = spark.createDataFrame(rows, "doc_id long, text string").repartition(8), {}
    keep = minhash.materialise

    def counted(df, purpose):
        table = keep(df, purpose)
        seen[purpose] = table.count()  # the search's tables are freed after it
        return table

    monkeypatch.setattr(minhash, "materialise", counted)
    got = minhash.near_duplicates(docs, 85).groupBy("doc_id", "component_id").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, 3000), (7, 0, 1), (8, 8, 1)]
    assert seen["op8-sets"] == 2


def test_shingle_sets_equal_plain_sets(hard_rows):
    import pyarrow as pa

    texts = [t or "" for _, t in hard_rows]
    got = minhash.shingle_sets(pa.array(texts, pa.large_string()))
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    for a in range(len(texts)):
        for b in range(len(texts)):
            assert len(np.intersect1d(got[a], got[b])) == len(shingles(texts[a]) & shingles(texts[b]))


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(5, 5)] + [(1000 + i, 1001 + i) for i in range(64)]
    label = {x: x for e in edges for x in e}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        ra, rb = find(a), find(b)
        label[max(ra, rb)] = min(ra, rb)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {(r["node"], r["component"]) for r in got} == {(x, find(x)) for x in linked} and len(got) == len(linked)


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    written, write = [], components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, purpose: written.append(purpose) or write(df, purpose))
    stars = [(1, 2), (3, 1), (1, 3), (4, 1), (8, 9), (7, 7), (None, 2)]
    got = components.connected_components(spark.createDataFrame(stars, "u long, v long")).collect()
    assert sorted((r["node"], r["component"]) for r in got) == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)] and len(written) == 1
    for edges, nodes in (([(1, 5), (2, 5)], [1, 2, 5]), ([(1, 2), (2, 3)], [1, 2, 3])):  # two smaller neighbours; a smaller and a larger one
        got = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
        assert sorted((r["node"], r["component"]) for r in got) == [(n, 1) for n in nodes]
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []
