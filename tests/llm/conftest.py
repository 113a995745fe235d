import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgäéh") for _ in range(rng.randrange(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """(doc_id, text) with nulls, empty and very long texts, ties, repeated rows, odd scripts and markup."""
    rng = random.Random(5)
    base = words(rng, 80)
    texts = ["", None, "   \t\n ", "one", "a b c d", "a b c d e", base, base, base.replace(" ", "  \n"), base + " extra",
             base.upper(), words(rng, 40_000), "It's 'tis we'll 're''s 12 3½ !!'s ΑΣ Σ", "<|endoftext|> x <|startoftext|>y",
             "é ́a ​ 漢字かな İstanbul \U0001F600\U0001F600'll'd", "a\x00b\x85c", "x" * 5000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(6, base), (100, "same id, one text"), (100, "same id, another text"), (None, base), (None, None)]
    return rows


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    """The hard rows as documents, with extra columns whose names clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, kept string, sha string, score string, key string"
    rows = [(i, t, None, None if i is None else f"s{i % 3}", None, 7, "k", None, "s", "x") for i, t in hard_rows]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


def tuples(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r))
