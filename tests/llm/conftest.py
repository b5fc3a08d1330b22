import random

import pytest

KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and columns with names of results."""
    r = random.Random(4)
    long = " ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 9))) for _ in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, long, "en", "a", len(long)), (4, long, "en", "a", len(long)),
        (None, "one two three four five six", "en", None, 1), (None, None, None, None, None), (7, "x" * 100_000, "de", "b", 1), (8, "tie tie\ntie tie\ntie tie\ntie tie", "fr", "b", 1),
        (9, "a b", "fr", "b", 3), (10, "A  B", "fr", "b", 4), (11, "é漢😀 ​ <|endoftext|> ▁ '", "zh", "b", 9), (12, 'password: "hunter2hunter2" mail a@b.co 4111 1111 1111 1111', "en", "b", 9),
    ]
    df = spark.createDataFrame(rows, KINDS)
    for name in ("score", "SIZE", "taken", "n_lines", "kept", "spans", "ids", "votes", "rank", "n_tokens"):
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
