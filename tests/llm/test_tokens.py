"""Operators 2 and 4 against the libraries that own the vocabularies."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from scarpline.llm import piece_codec, queries, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def scribble(n: int) -> list[str]:
    rng = random.Random(2)
    letters = "abcXYZ 'sS\t\n\r<>|_09é߀İſªº²½́\xa0 中文🙂Ω ΑΣ ▁\x00\x1c​!#٣ﬁ"
    free = ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(n)]
    return free + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [7, 1 << 15])
def test_counts_equal_the_library(corpus, chunk):
    from tokenizers import Tokenizer

    counter, library = token_counts.Counter(WORDS, chunk), Tokenizer.from_file(WORDS)
    texts = [t or "" for _, t in corpus] + scribble(400)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == want


def test_counts_survive_a_full_memory(corpus):
    counter, small = token_counts.Counter(WORDS), token_counts.Counter(WORDS)
    small.machine.memory = 50
    for t in scribble(60):
        assert small.count(t) == counter.count(t)


def test_state_maps_compose_in_any_order():
    counter, text = token_counts.Counter(WORDS), "some text, cut anywhere; withaverylongwordinside it"
    maps = [counter.state_map(text[i : i + 5]) for i in range(0, len(text), 5)]
    left = right = None
    for m in maps:
        left = m if left is None else counter.compose(left, m)
    for m in reversed(maps):
        right = m if right is None else counter.compose(m, right)
    total = lambda m: counter.closed(m[0]) + (m[1] or 0) + counter.closed(m[2])
    assert total(left) == total(right) == counter.count(text)


def test_counted_frame(docs, corpus):
    counted = token_counts.with_token_counts(docs, WORDS, limit=100)
    rows = counted.collect()
    assert counted.columns[:4] == docs.columns[:4] and len(rows) == len(corpus)
    for r in rows:
        assert r.n_bytes == len((r.text or "").encode()) and r.over_limit == (r.n_tokens > 100)
    assert token_counts.with_token_counts(docs.limit(0), WORDS).count() == 0


def test_pieces_equal_the_library_and_round_trip(docs):
    model = piece_codec.table(PIECES).model
    both = piece_codec.with_round_trip(docs, PIECES)
    apart = piece_codec.with_decoded(piece_codec.with_piece_ids(docs.select("text"), PIECES), PIECES)
    for r in [*both.collect(), *apart.collect()]:
        assert r.ids == model.encode(r.text or "") and r.decoded == model.decode(r.ids)
    assert piece_codec.with_round_trip(docs.limit(0), PIECES).count() == 0
    free = piece_codec.table(PIECES)
    texts = scribble(400)
    assert [piece_codec.array("i", b).tolist() for b in free.encode(texts)] == [model.encode(t) for t in texts]


def test_null_ids_decode_to_nothing(spark):
    lists = spark.createDataFrame([(None,), ([],), ([28705, 264],)], "ids array<int>")
    assert [r.decoded for r in piece_codec.with_decoded(lists, PIECES).collect()][:2] == ["", ""]


def test_queries(spark, small):
    n = spark.read.parquet(f"{small}/documents.parquet").count()
    for name in ("op2_token_counts", "op4_piece_codec"):
        found = queries.QUERIES[name](spark, small)
        assert found.count() == n and dict(found.dtypes)["n_tokens"] == "bigint"
    assert found.where(F.length("ids_sha256") != 64).count() == 0
