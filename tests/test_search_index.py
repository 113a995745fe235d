"""The trigram search gives the rows of the plain search (P1), reading only names that can match."""

import random

import pytest
from pyspark.sql import functions as F

from souk.operators import catalog
from souk.plans.trigrams import candidates, literal_runs, needed_grams, trigrams, write_trigrams
from souk.session import scratch_dir

NAMES = ["Red Widget", "red  widget", "re", "", "Straße 12", "ΟΔΟΣ", "a\\b_c%d", "50% off", "İstanbul mug", "\U0001F600\U0001F600\U0001F600!", "Ünïcode"]
SEARCHES = ["red", "RED%WID_ET", "re", "e", "%", "___", "straße", "οδος", "ΟΔΟ", "a\\\\b", "\\_c\\%d", "50\\% o", "istanbul", "İst", "\U0001F600\U0001F600\U0001F600",
            "zzz", "red%zzz", "ünï", "d\\", ""]


@pytest.fixture(scope="module")
def shop(spark, seed):
    rng = random.Random(2)
    names = NAMES + ["".join(rng.choice("abAB \\%_ß") for _ in range(rng.randrange(0, 9))) for _ in range(120)]
    one = seed.products.limit(1).drop("id", "name")
    named = spark.createDataFrame(list(enumerate(names, 1)), "id long, name string").crossJoin(one)
    t = seed.with_(products=named.select(*seed.products.columns))
    path = scratch_dir(spark, "test-trigrams")
    write_trigrams(trigrams(t.products, "id", "name"), path)
    return t, spark.read.parquet(path)


def test_indexed_search_equals_the_plain_one(shop):
    t, grams = shop
    rng = random.Random(4)
    for search in SEARCHES + ["".join(rng.choice("abAB%_ \\") for _ in range(rng.randrange(3, 7))) for _ in range(12)]:
        plain = {r["id"] for r in catalog.catalog_search(t, search=search).select("id").collect()}
        got = [r["id"] for r in catalog.catalog_search(t, search=search, grams=grams).select("id").collect()]
        assert sorted(got) == sorted(plain), search


def test_grams_of_patterns(spark, shop):
    assert literal_runs("%a\\%b_cde%f") == ["a%b", "cde", "f"]
    assert needed_grams(spark, "%AbCd_ef%") == ["abc", "bcd"] and needed_grams(spark, "%ab_cd%") == []
    assert candidates(shop[1], "%ab%") is None
    plan = catalog.catalog_search(shop[0], search="widget", grams=shop[1])._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    scan = shop[1].filter(F.col("gram").isin("wid", "idg"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in scan


def test_trigrams_of_nothing(spark):
    none = spark.createDataFrame([(1, None), (2, ""), (3, "ab")], "id long, name string")
    assert trigrams(none, "id", "name").collect() == []
    assert [r["gram"] for r in trigrams(spark.createDataFrame([(1, "AAAA")], "id long, name string"), "id", "name").collect()] == ["aaa"]
