"""Operators 1, 4, 5, 6 and 10 against brute force, and the pipeline's stages."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from souk.llm import chat, minhash, mixing, quality, topk, url_filter
from souk.llm.queries import ORACLE_SQL, QUERIES, URL_RULES, word_bpe_path
from souk.llm.words import load
from tests.llm.conftest import DOC_SCHEMA, tuples, words
from tests.llm.test_dedup import brute_components

# ---- operator 1


def rule_for(host, path):
    fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0])) if fits else None


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:] if rest[cut:cut + 1] == "/" else ""
    cut_path = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:cut_path]


def propagated(seeds, edges, rounds=400):
    out = Counter(a for a, _ in edges)
    score = dict(seeds)
    for _ in range(rounds):
        new = dict(seeds)
        for a, b in edges:
            new[b] = new.get(b, 0.0) + url_filter.DAMPING * score.get(a, 0.0) / out[a]
        score = new
    return score


def brute_verdicts(pages):
    rows = [(i, *parts(u), h or "") for i, u, h in pages]
    ruled = {}
    for _, host, path, _ in rows:
        if host:
            ruled.setdefault(host, []).append((rule_for(host, path) or (None, None))[1])
    edges = set()
    for _, host, _, html in rows:
        for part in html.split('href="')[1:]:
            to = part.split('"')[0]
            to = to.split("//", 1)[1].split("/")[0].lower() if "//" in to else ""
            if host and to and to != host:
                edges.add((host, to))
    seed = lambda v: {h: ruled[h].count(v) / len(ruled[h]) for h in ruled}
    trust, distrust = propagated(seed("allow"), edges), propagated(seed("block"), {(b, a) for a, b in edges})
    out = []
    for i, host, path, _ in rows:
        rule = rule_for(host, path)
        verdict = rule[1] if rule else ("block" if distrust.get(host, 0) - trust.get(host, 0) > url_filter.MARGIN else "allow")
        out.append((i, host, path, rule[0] if rule else None, verdict))
    return out


def judged(spark, pages):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string, host string, rule string"), rules)
    return tuples(got.select("page_id", "host", "path", "rule", "verdict"))


def test_op1_rows_and_link_flow(spark):
    link = lambda *hs: "".join(f'<a href="https://{h}/x">y</a>' for h in hs)
    pages = [(1, "http://WWW.Example.NET/en/1?q#f", ""), (2, "http://example.net/de/", None), (3, "https://a.org/fr/x", ""), (4, "no scheme", link("b.net")),
             (5, None, ""), (6, "http://farm.edu/a", link("b.net", "c.net", "farm.edu")), (7, "http://b.net/", ""), (8, "http://c.net/q", ""),
             (9, "http://good.edu/", link("farm2.edu")), (10, "http://net?x", ""), (11, "http://x.example.com/de/1", ""), (12, "http://x.example.com/en/1", ""),
             (13, "http://both.edu/", link("b.net")), (14, "http://a.org/fr/y", link("both.edu")), (14, "http://a.org/fr/y", link("both.edu")),
             (15, "http:///en/", ""), (16, "a://b://c/d", ""), (17, "http://notexample.net/en/", ""), (None, "http://z.org/fr/", "")]
    got = judged(spark, [(*p, "h", "r") for p in pages])
    assert got == sorted(brute_verdicts(pages), key=lambda r: tuple((x is not None, x) for x in r))
    assert {r[0]: r[4] for r in got}[6] == "block" and {r[0]: r[4] for r in got}[12] == "allow"


def test_op1_many_small_flows_meet_again(spark):
    link = lambda *hs: "".join(f'<a href="https://{h}/x">y</a>' for h in hs)
    middle = [f"h{i}.edu" for i in range(1200)]
    pages = [(-1, "http://bad.net/", ""), (-2, "http://farm.edu/", link(*middle)), *((i, f"http://{h}/", link("bad.net")) for i, h in enumerate(middle))]
    got = judged(spark, [(*p, "h", "r") for p in pages])
    assert got == sorted(brute_verdicts(pages))
    assert {r[0]: r[4] for r in got}[-2] == "block"
    edges = [(a, b) for h in middle for a, b in (("bad.net", h), (h, "farm.edu"))] + [("farm.edu", "bad.net"), ("farm.edu", "x.edu")]
    want = propagated({"bad.net": 1.0}, edges)
    found = url_filter.propagate(spark.createDataFrame([("bad.net", 1.0)], "host string, seed double"), spark.createDataFrame(edges, "src string, dst string"))
    found = {r["host"]: r["score"] for r in found.collect()}
    assert set(found) == set(want) and all(abs(found[h] - x) <= url_filter.TOLERANCE for h, x in want.items())


def test_op1_empty(spark):
    assert judged(spark, []) == []


# ---- operator 4


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1, "c": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 997, "b": 2, "c": 1}, {"a": 0.31, "b": 0.33, "c": 0.36}])
def test_op4_schedule_stays_within_one_block(weights):
    whole = mixing.whole_weights(weights)
    shares, total = list(whole.values()), sum(whole.values())
    assert [Fraction(a, total) for a in shares] == [Fraction(w) / sum(map(Fraction, weights.values())) for w in weights.values()]
    seen = [0] * len(shares)
    for slot, (no, k, release, deadline) in enumerate(mixing.place(shares, 0, 2500), 1):
        assert k == seen[no] and release < slot <= deadline
        seen[no] += 1
        assert all(abs(n * total - slot * a) < total for n, a in zip(seen, shares))


@pytest.mark.parametrize("tiny", [2, 30, 999, 1500])
def test_op4_long_tail_keeps_a_share_each(tiny):
    weights = mixing.tempered({"big": 10_000_000, "middle": 40_000, **{f"t{i}": 1 for i in range(tiny)}}, 0.8)
    whole = mixing.whole_weights(weights)
    assert set(whole) == set(weights) and min(whole.values()) >= 1


LONG_TAILS = [{"a": 10_000_000, "b": 1, "c": 1}, {"a": 9000, "b": 8999, None: 40, **{f"t{i}": 1 for i in range(30)}}]


@pytest.mark.parametrize("rows", LONG_TAILS)
@pytest.mark.parametrize("chunk", [1, 37, 5000])
def test_op4_chunks_stay_within_one_block_of_the_weights(rows, chunk):
    weights = {s: Fraction(w) for s, w in mixing.tempered(rows, 0.8).items()}
    whole = mixing.whole_weights(weights)
    assert all(Fraction(whole[s], sum(whole.values())) == w / sum(weights.values()) for s, w in weights.items())
    shares, total, slots = list(whole.values()), sum(whole.values()), 7000
    got, ahead = [], set()
    for start in range(0, slots, chunk):
        stop = min(start + chunk, slots)
        got += mixing.place(shares, start, stop, ahead)
        ahead = mixing.done_ahead(shares, start, stop, ahead, mixing.free_slots(shares, start, stop))
    assert got == mixing.place(shares, 0, slots)
    seen = [0] * len(shares)
    for slot, (no, k, release, deadline) in enumerate(got, 1):
        assert k == seen[no] and k * total // shares[no] == release < slot <= deadline == -(-(k + 1) * total // shares[no])
        seen[no] += 1
        assert all(abs(n * total - slot * a) < total for n, a in zip(seen, shares))


def test_op4_stream_follows_small_weights(spark):
    rows = [(i, None, None, "a", 1) for i in range(20_000)] + [(-1, None, None, "b", 1), (-2, None, None, "c", 1)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    weights = mixing.tempered({"a": 20_000, "b": 1, "c": 1}, 0.8)
    out, slots = mixing._scheduled(docs, None, 0.8, "all_exhausted", 1, "doc_id", "source", chunk=3000)
    got = sorted(out.select("position", "source", "slot", "release", "deadline", "block").collect())
    assert [r["position"] for r in got] == list(range(slots)) and {r["source"] for r in got} == {"a", "b", "c"}
    seen, total = Counter(), sum(weights.values())
    for n, r in enumerate(got, 1):
        assert r["release"] <= r["slot"] < r["deadline"] and r["block"] == seen[r["source"]]
        seen[r["source"]] += 1
        assert all(abs(seen[s] - n * w / total) < 1 for s, w in weights.items())
    assert seen["a"] == 20_000 and 6 <= seen["b"] <= 9  # 7.3 by weight; thousandths gave 20


def test_op4_rows(spark):
    rng = random.Random(1)
    rows = [(i, None, None, rng.choice(["a"] * 6 + ["b", "c", None]), 1) for i in range(900)] + [(None, None, None, "a", 1), (5, None, None, "b", 1)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    size = Counter(r[3] for r in rows)
    shares = mixing.tempered(size, 0.8)
    total = sum(shares.values())
    got = mixing.schedule(docs, block_rows=8).collect()
    assert sorted(r["position"] for r in got) == list(range(len(got)))  # every slot is filled
    used = Counter(r["source"] for r in got)
    assert all(abs(used[s] - len(got) * shares[s] / total) < 8 for s in shares) and all(used[s] >= size[s] for s in size)
    seen, by_source = Counter(), Counter()
    for r in sorted(got, key=lambda r: r["position"]):
        assert r["release"] <= r["slot"] < r["deadline"] and r["block"] == by_source[r["source"]] // 8
        by_source[r["source"]] += 1
    for r in got:
        seen[r["c0"], r["source"], r["pass"]] += 1
    assert {k[:2] for k in seen} == {(r[0], r[3]) for r in rows}
    once = mixing.schedule(docs, block_rows=8, until="first_exhausted").collect()
    assert max(Counter((r["c0"], r["source"]) for r in once).values()) == 1 and {r["pass"] for r in once} == {0}
    assert all(abs(n - len(once) * shares[s] / total) < 8 for s, n in Counter(r["source"] for r in once).items())


def test_op4_mix_keeps_columns_and_order(spark, hard_docs, hard_rows, no_docs):
    out = mixing.mix(hard_docs, block_rows=2)
    assert out.columns == hard_docs.columns and out.dtypes == hard_docs.dtypes
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == set(hard_rows)
    order = mixing.schedule(hard_docs, block_rows=2).orderBy("position").select("c0").collect()
    assert [r[0] for r in out.select("doc_id").collect()] == [r[0] for r in order]
    assert mixing.mix(no_docs).collect() == []


# ---- operator 5


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = words(rng, rng.randrange(20, 60))
        rows.append((i, text.replace(" ", "$$$ ") if bad else text.capitalize() + ".", None, None, 1))
        if i % 3:
            labels.append((i, 0 if bad else 1))
    rows += [(1000, "", None, None, 1), (1001, None, None, None, 1), (None, "x", None, None, 1), (1002, words(rng, 30_000), None, None, 1)]
    labels += [(2, 0), (2, 1), (None, 1), (7, None)]
    return spark.createDataFrame(rows, DOC_SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")


def test_op5_held_out_accuracy(labelled):
    docs, labels = labelled
    got = quality.decide(docs, quality.fit(docs, labels, per_class=100)).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0) for r in got)
    known = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 600]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in known]) > 0.97


def test_op5_learns_from_no_held_out_label(spark, labelled):
    docs, labels = labelled
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(odd, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(docs, labels, per_class=100), quality.fit(docs, flipped, per_class=100)
    assert np.array_equal(a.weights, b.weights) and (a.slope, a.shift, a.intercept) == (b.slope, b.shift, b.intercept)


def plain_features(text):
    """Feature numbers of one text, value by value."""
    data, m = text.encode(), 2**64 - 1

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m
        h = (h ^ h >> 27) * 0x94D049BB133111EB & m
        return h ^ h >> 31

    def grams(v, salt):
        return {mix((a << 42 ^ b << 21 ^ c ^ salt << 62) & m) % quality.DIMENSIONS for a, b, c in zip(v, v[1:], v[2:])}

    def kind(byte):
        c = chr(byte)
        return 1 if byte > 126 or byte < 33 or c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4

    shapes, before = [], None
    for w in re.findall(rb"[^\x20\x09-\x0D]+", data):
        shapes.append(sum(1 << k for k in {kind(b) for b in w}) + 32 * (w.lower() == before) + 64 * min(3, len(w)))
        before = w.lower()
    return sorted(grams(data, 1) | grams(shapes, 2))


def test_op5_features_equal_plain_ones(hard_rows):
    texts = [t or "" for _, t in hard_rows if len(t or "") < 6000] + ["the The the cat 12 !x A-b", "ab", "a  b\tc", "\x01\x7f é É", "A b C d"]
    got = quality.features(pa.array(texts, pa.large_string()))
    assert [g.tolist() for g in got] == [plain_features(t) for t in texts]


def test_op5_ratios_margins_and_curve_equal_plain_ones():
    rng = random.Random(9)
    y = np.array([rng.random() < 0.6 for _ in range(80)], int)
    texts = [words(rng, 8) + ("." if c or rng.random() < 0.2 else " $$") for c in y]
    found = [np.array(plain_features(t)) for t in texts]
    model = quality._fit_sample(found, y, {0: 300, 1: 100})
    learnt = [i for i in range(80) if i % 4]
    size = {c: sum(y[i] == c for i in learnt) for c in (0, 1)}
    seen = {c: Counter(f for i in learnt if y[i] == c for f in found[i].tolist()) for c in (0, 1)}
    for f in {f for x in found for f in x.tolist()}:
        want = math.log((1 + seen[1][f]) / (size[1] + 2)) - math.log((1 + seen[0][f]) / (size[0] + 2))
        assert abs(model.ratio[f] - want) < 1e-12
    margin = [sum(model.weights[f] * model.ratio[f] for f in x) / math.sqrt(sum(model.ratio[f] ** 2 for f in x)) + model.intercept for x in found]
    assert np.allclose(model.margins(found), margin) and np.allclose(model.scores(found), [1 / (1 + math.exp(-model.slope * x - model.shift)) for x in margin])

    held = range(0, 80, 4)  # the curve's rows, weighted back to 300 and 100 labelled rows
    rows = Counter(int(y[i]) for i in held)
    weight = {0: 300 / rows[0], 1: 100 / rows[1]}
    each = len(held) / 400
    ones, zeros = each * 100, each * 300
    aim = {1: (ones + 1) / (ones + 2), 0: 1 / (zeros + 2)}

    def loss(a, b):
        ps = [(1 / (1 + math.exp(-a * margin[i] - b)), int(y[i])) for i in held]
        return -sum(each * weight[c] * (aim[c] * math.log(p) + (1 - aim[c]) * math.log(1 - p)) for p, c in ps)

    best = loss(model.slope, model.shift)
    assert all(loss(model.slope + da, model.shift + db) > best - 1e-6 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))


def test_op5_without_labels_and_without_documents(spark, labelled, no_docs, hard_docs):
    docs, labels = labelled
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.decide(docs, none).collect()} == {0.5}
    assert quality.decide(no_docs, quality.fit(no_docs, labels)).collect() == []
    kept = quality.keep_good(hard_docs, none)
    assert kept.columns == hard_docs.columns and kept.count() == hard_docs.count()


def test_op5_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(80)]
    y = np.where(np.array([1.0 if len(r) and r[0] < 3 else -1.0 for r in rows]) + rng.normal(0, 0.3, 80) > 0, 1.0, -1.0)
    scale, cost = rng.normal(size=12), np.full(80, 1.0)
    x = np.zeros((80, 13))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / max(1e-12, np.sqrt((scale[r] ** 2).sum()))
        x[i, 12] = 1
    w, b = quality.dual_coordinate_descent(rows, y, scale, cost, epochs=400)
    v = np.append(w, b)
    slack = np.maximum(0, 1 - y * (x @ v))
    gradient = v - 2 * (cost * slack * y) @ x
    assert np.abs(gradient).max() < 1e-3


def test_op5_sample_holds_one_row_of_a_repeated_id(spark, monkeypatch):
    rng, seen, fit_sample = random.Random(8), [], quality._fit_sample
    rows = [(i, words(rng, 20), None, "s", 1) for i in range(60)] + [(1, words(rng, 20), None, "s", 1) for _ in range(300)]
    monkeypatch.setattr(quality, "_fit_sample", lambda found, y, counts: seen.append(len(found)) or fit_sample(found, y, counts))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    held = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(60))
    assert zlib.crc32(b"1") % 5
    quality.fit(spark.createDataFrame(rows, DOC_SCHEMA), labels)
    assert seen == [60 - held]


def test_op5_fit_keeps_the_sample_in_place(spark, monkeypatch):
    rng, seen, fit_sample = random.Random(9), [], quality._fit_sample
    monkeypatch.setattr(quality, "_fit_sample", lambda found, y, counts: seen.extend(found) or fit_sample(found, y, counts))
    texts = {i: words(rng, 20) for i in range(40)}
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in texts.items()], DOC_SCHEMA)
    quality.fit(docs, spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int"))
    assert seen and all(f.dtype == np.int32 and not f.flags.owndata for f in seen)
    whole = quality.features(pa.array([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5], pa.large_string()))
    assert sorted(f.tolist() for f in seen) == sorted(f.tolist() for f in whole)


def test_op5_descent_takes_less_memory_than_its_rows():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.permutation(8000)[:4000]).astype(np.int32) for _ in range(200)]
    y = np.where(np.arange(200) % 2, 1.0, -1.0)
    tracemalloc.start()
    quality.dual_coordinate_descent(rows, y, rng.normal(size=8000), np.ones(200), epochs=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < sum(r.nbytes for r in rows) / 2


# ---- operator 6


def test_op6_fold_of_deltas_edits_and_regenerations(spark):
    rows = [(1, 10, 0, 1, "start", "user", "hi "), (1, 10, 0, 2, "delta", None, "there"), (1, 11, 1, 3, "start", "assistant", None),
            (1, 11, 1, 4, "delta", None, "bad"), (1, 11, 1, 5, "regenerate", None, "ignored"), (1, 11, 1, 6, "delta", None, "go"), (1, 11, 1, 7, "delta", None, "od"),
            (1, 10, 0, 8, "edit", None, "hello"), (1, 10, 0, 9, "delta", None, "!"), (None, 12, None, 1, "delta", None, "no start"), (2, 13, 0, None, "start", "a:b", None),
            (2, 13, 0, 1, "delta", None, None)]
    events = spark.createDataFrame(rows, "conv_id long, message_id long, turn long, seq long, kind string, role string, text string")
    got = tuples(chat.fold_events(events).select("conv_id", "turn", "role", "text"))
    assert got == [(None, None, "", "no start"), (1, 0, "user", "hello!"), (1, 1, "assistant", "good"), (2, 0, "a:b", "")]


def test_op6_round_trip_and_digests(spark):
    rng = random.Random(8)
    bits = ["\\", "###", "</turn>", ":", "\n", " ", "é", "\U0001F600", "### assistant: ", "a"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(0, 900)))
    rows = [(i % 7, i // 7, rng.choice(["user", "assistant", "system", "x:y", "\\###\n"]), text()) for i in range(70)]
    rows += [(50, 0, None, None), (50, 0, "assistant", None), (50, None, "assistant", "first"), (50, 1, "assistant", "twice"), (50, 1, "assistant", "twice"), (None, 0, "user", "x")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    parsed = chat.parse(chat.render(chat.fold_events(chat.events_of_turns(turns, chunk=7))))
    key = lambda r: tuple((x is not None, x) for x in r)
    clean = [(c, t, r or "", x or "") for c, t, r, x in rows]
    assert tuples(parsed.select("conv_id", "turn", "role", "text")) == sorted(clean, key=key)
    assert all(r["loss_text"] == (r["text"] if r["role"] == "assistant" else None) for r in parsed.collect())
    got = {r["conv_id"]: r for r in chat.conversation_digests(parsed).collect()}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in clean if r[0] == conv), key=key)
        loss = "".join(x for _, _, r, x in mine if r == "assistant")
        assert got[conv]["n_turns"] == len(mine) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in mine).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_op6_log_of_turns_holds_every_kind_of_event(spark):
    turns = spark.createDataFrame([(1, 0, "user", "abcdefgh"), (1, 1, "assistant", "abcdefgh"), (1, 2, "user", ""), (1, 3, "assistant", None)],
                                  "conv_id long, turn long, role string, text string")
    log = {}
    for e in sorted(chat.events_of_turns(turns, chunk=3).collect(), key=lambda e: (e["turn"], e["seq"])):
        log.setdefault(e["turn"], []).append((e["kind"], e["text"]))
    draft = ("delta", "draft: cba")
    assert log[0] == [("start", ""), draft, ("edit", "abc"), ("delta", "def"), ("delta", "gh")]
    assert log[1] == [("start", ""), draft, ("regenerate", None), ("delta", "abc"), ("delta", "def"), ("delta", "gh")]
    assert log[2] == [("start", ""), ("delta", "draft: "), ("edit", "")]
    assert log[3] == [("start", ""), ("delta", "draft: "), ("regenerate", None)]


def test_op6_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.parse(chat.render(chat.fold_events(chat.events_of_turns(none))))).collect() == []


# ---- operator 10


def brute_top_k(rows, k):
    whole = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in whole if i % 20 == 0}):
        vectors = sorted((v for i, v in whole if i == q), key=lambda v: (len(v), np.array(v, "<f8").tobytes()))
        x = vectors[0]
        found = sorted((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(x, v)))), i) for i, v in whole if i != q and len(v) == len(x))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return out


@pytest.mark.parametrize("blocks", [(4096, 1024), (40, 3)])
def test_op10_rows(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    rows += [(i, [0.5] * 8) for i in range(200, 280)]  # a common vector: ties everywhere
    rows += [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (420, [float("inf")] * 8), (None, [1.0] * 8), (440, [1.0, 2.0]), (441, [3.0, -4.0]),
             (460, []), (461, []), (480, [3e30] * 8), (481, [-3e30] * 8), (20, [9.0] * 8), (7, rows[7][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    assert tuples(topk.top_k(frame, F.col("vec_id") % 20 == 0, k=5)) == brute_top_k(rows, 5)


def test_op10_rows_of_one_id_fill_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    met = []
    monkeypatch.setattr(topk, "_meet", lambda q, c, k, meet=topk._meet: (met.append(c.groupBy("qb", "cb").count().agg(F.max("count")).first()[0]), meet(q, c, k))[1])
    rows = [(7, [1.0, float(i % 3)]) for i in range(600)] + [(20, [1.0, 1.0]), (40, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert tuples(topk.top_k(frame, F.col("vec_id") % 20 == 0, k=30)) == brute_top_k(rows, 30)
    assert max(m for m in met if m) < 150  # 602 rows in 13 blocks


def test_op10_blocks_that_cannot_reach_never_meet(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    met, every = [], []
    meet, pairs = topk._meet, topk.block_pairs
    monkeypatch.setattr(topk, "_meet", lambda q, c, k: (met.append(q.select("qb", "cb").distinct().count()), meet(q, c, k))[1])
    monkeypatch.setattr(topk, "block_pairs", lambda q, c: (every.append(pairs(q, c).count()), pairs(q, c))[1])
    rng = np.random.default_rng(8)  # eight clusters, a hundred vectors each
    centres = rng.normal(size=(8, 16)) * 4
    rows = [(i, [float(x) for x in centres[i % 8] + rng.normal(size=16) * 0.1]) for i in range(800)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert tuples(topk.top_k(frame, F.col("vec_id") % 20 == 0, k=5)) == brute_top_k(rows, 5)
    assert sum(met) < 0.5 * every[0]


def test_op10_vectors_beyond_doubles(spark):
    rows = [(i, [float(x) * 1e160 for x in (i % 7 - 3, i % 5 - 2)]) for i in range(60)] + [(60, [1e290, -1e290]), (80, [1.0, 1.0])]
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=4).collect()
    for q, x in whole:
        if q % 20 == 0:
            scores = [(-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(x, v)))), i) for i, v in whole if i != q]
            assert sorted((-r["score"], r["vec_id"]) for r in got if r["query_id"] == q) == sorted(scores)[:4]


def test_op10_empty(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect() == []


# ---- registry and pipeline


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline_stages_over_hard_rows(spark, hard_docs, hard_rows, tmp_path):
    spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = hard_docs
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "bpe":
            assert docs.columns == before.columns
        if name == "near_dedup":
            sets = minhash.near_duplicates(docs, 80).collect()
            assert all(r["kept"] for r in sets)
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 0


def test_pipeline_run_equals_plain_stages(spark, labelled, tmp_path):
    rng = random.Random(12)
    rows = [(r["doc_id"], r["text"], None, rng.choice("aaaaab") if r["doc_id"] != 5 else None, 1)
            for r in labelled[0].collect() if r["doc_id"] is not None and r["doc_id"] < 200]
    good = [r for r in rows if r[0] % 4]
    rows += [(2000 + i, t.replace(" ", "  "), None, "b", 1) for i, t in ((r[0], r[1]) for r in good[:25])]  # exact copies
    rows += [(3000 + i, t + " end", None, "c", 1) for i, t in ((r[0], r[1]) for r in good[20:40])]  # near copies
    rng.shuffle(rows)
    spark.createDataFrame(rows, DOC_SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    labelled[1].write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality.decide(docs, quality.fit(docs, labelled[1])).collect()}
    kept = {}
    for i, t, _, source, _ in sorted(rows):
        if scores[i] >= 0.3:
            kept.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t, source))
    assert 100 < len(kept) < len(rows)
    component = brute_components([(i, t) for i, t, _ in kept.values()], 80)
    left = {i: (t, s) for i, t, s in kept.values() if component[i][1] == i}
    assert len(left) < len(kept)

    size = Counter(s for _, s in left.values())
    weight = {s: Fraction(n**0.8) for s, n in size.items()}
    slots, done = 0, Counter()
    order = sorted(size, key=lambda s: (s is not None, s))
    due = lambda s: (math.ceil((done[s] + 1) * sum(weight.values()) / weight[s]), order.index(s))
    while any(done[s] * mixing.BLOCK_ROWS < n for s, n in size.items()):  # until every source was used up once
        free = [s for s in order if math.floor(done[s] * sum(weight.values()) / weight[s]) <= slots]
        done[min(free, key=due)] += 1
        slots += 1
    times = Counter(r["doc_id"] for r in got)
    assert set(times) == set(left)
    by_source = Counter()
    for i, n in times.items():
        s = left[i][1]
        by_source[s] += n
        assert n in (done[s] * mixing.BLOCK_ROWS // size[s], -(-done[s] * mixing.BLOCK_ROWS // size[s]))
    assert by_source == {s: done[s] * mixing.BLOCK_ROWS for s in size}

    library = load(word_bpe_path())
    for r in got:
        ids = library.encode(left[r["doc_id"]][0], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_pipeline_of_an_empty_table(spark, no_docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = no_docs
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.collect() == []
