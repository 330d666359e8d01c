import random

import pytest

EDGES = [None, "", " \t\n ", "one", "Two words", "x" * 70_000, "a b " * 20_000, "Ünïcödé 中文 🙂 ﬁ ½ ", "it's <|endoftext|> We'll", " a\x00b  ▁c\r\n\n d "]


def prose(rng: random.Random, n: int) -> str:
    syllables = ["the", "an", "er", "on", "re", "st", "ti", "ea", "wh", "ly"]
    return " ".join("".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 3)))) for _ in range(n)).replace(" st ", ". St ", 3)


@pytest.fixture(scope="package")
def corpus():
    """(id, text) with nulls, empty and long texts, exact and near copies, and a repeated row."""
    rng = random.Random(5)
    texts = [prose(rng, rng.choice((3, 40, 120, 300))) for _ in range(60)]
    near = [t.replace("the", "then", 1) for t in texts[:10]]
    rows = [(i, t) for i, t in enumerate([*EDGES, *texts, *texts[20:25], *near])]
    return [*rows, rows[15], (None, texts[3]), (None, None)]


@pytest.fixture(scope="package")
def docs(spark, corpus):
    """The corpus as documents, with columns whose names operators use themselves."""
    rows = [(i, t, ["en", "fr", None][k % 3], ["a", "a", "b", None][k % 4], 7, "mine") for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_tokens bigint, score string").repartition(3)
