"""Operator 11 against the tokenizer library and a plain dynamic program."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scarpline.llm import packing, queries
from scarpline.llm.token_counts import Transducer, byte_letters

PATH = public_tokenizers.path("byte_bpe_50k.json")


def padding(length, window):
    return 0 if length & (length - 1) == 0 else window - length


def test_tokens_are_made_by_their_own_merges():
    """What lets pairs be merged by the id of their union: ids ascend with the merges, and every
    token's bytes merge into that token."""
    import json

    with open(PATH, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in merges]
    assert ids == sorted(ids) and len(set(ids)) == len(ids)
    machine = Transducer(merges, "")
    rng = random.Random(1)
    assert all(machine.merge(a + b) == [a + b] for a, b in rng.sample(merges, 6000))


def test_ids_equal_the_library(corpus):
    library, coder = Tokenizer.from_file(PATH), packing.encoder(PATH)
    letters = "".join(map(chr, [*range(1, 0x500), *range(0x2000, 0x2070), 0x3000, 0x4E00, 0x1F600]))
    rng = random.Random(2)
    odd = ["".join(rng.choices(letters, k=60)) for _ in range(300)] + [f"a{c} {c}b {c}{c}1'{c}" for c in letters]
    odd += ["".join(rng.choices(" \n\t\xa0ab1',.", k=40)) for _ in range(500)]
    for text in [*(t for _, t in corpus if t), *odd]:
        assert coder.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(30))
def test_cuts_cost_least(seed):
    rng = random.Random(seed)
    window, total = 16, rng.randint(1, 90)
    places = sorted({*rng.sample(range(1, total + 1), rng.randint(1, total)), total, *range(window, total, window)})
    penalty = np.array([rng.choice((0, 1, 8)) for _ in places])
    least, best = {0: 0}, [0, *places]
    for j, cost in zip(places, penalty, strict=True):
        least[j] = min(least[i] + padding(j - i, window) for i in best if i < j and j - i <= window) + int(cost) + packing.OPENING
    cuts = packing.choose_cuts(np.array(places), penalty, window)
    costs = dict(zip(places, penalty.tolist(), strict=True))
    assert cuts[-1] == total and all(0 < b - a <= window for a, b in zip([0, *cuts], cuts))
    assert sum(padding(b - a, window) + costs[b] + packing.OPENING for a, b in zip([0, *cuts], cuts)) == least[total]


def test_places_to_cut():
    places, penalty = packing.places_to_cut(np.array([300, 5]), np.array([10, 20]), 8, 100)
    known = dict(zip(places.tolist(), penalty.tolist(), strict=True))
    assert (known[10], known[20], known[120], known[220], known[300], known[305]) == (1, 1, 8, 8, 0, 0)
    assert set(range(305 - 16, 306)) <= set(known) and known[304] == packing.INSIDE and 150 not in known


@pytest.fixture(scope="module")
def packed(docs):
    """Short windows and stretches, so that documents are cut and many stretches meet."""
    return packing.pack(docs, PATH, window=64, stretch=1 << 12).collect()


def test_every_id_lies_in_one_piece(packed, corpus):
    library = Tokenizer.from_file(PATH)
    want = collections.Counter((i, np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, t in corpus)
    sequences = collections.defaultdict(list)
    for r in packed:
        assert len(r.ids) == 4 * r.length and r.length > 0
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
        assert sum(r.length for r in own) <= 64
        ids = [r.doc_id for r in own if r.doc_id is not None]
        assert ids == sorted(ids)  # the order of the documents is kept
    got = collections.Counter()
    parts = collections.defaultdict(list)
    for r in packed:
        parts[r.doc_id].append(r)
    for i, own in parts.items():
        if sum(d == i for d, _ in want.elements()) == 1:
            own.sort(key=lambda r: r.start)
            assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
            got[i, b"".join(bytes(r.ids) for r in own)] += 1
        else:  # an id of several rows: the ids of all rows together
            assert sum(r.length for r in own) == sum(len(x) // 4 for d, x in want.elements() if d == i)
    assert all(want[k] == n for k, n in got.items())
    total = sum(r.length for r in packed)
    waste = sum(padding(sum(r.length for r in own), 64) for own in sequences.values())
    assert waste <= 0.05 * total


def test_hot_id_is_spread_and_reruns_agree(spark):
    rows = spark.createDataFrame([(7, "one two three. " * 30)] * 200 + [(i, "four. five.") for i in range(10, 30)], "doc_id bigint, text string").coalesce(1)
    first = packing.pack(rows, PATH, window=128, stretch=2000).collect()
    assert len({r.sequence_id >> 32 for r in first}) > 5
    hot = [r for r in first if r.doc_id == 7]
    assert sum(r.length for r in hot) == 200 * hot[0].doc_tokens
    again = packing.pack(rows, PATH, window=128, stretch=2000).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_sequences_and_empty(spark, docs):
    pieces = packing.pack(docs.where("doc_id < 20 or doc_id is null"), PATH, window=256)
    whole = packing.sequences(pieces, 256).collect()
    assert all(len(r.ids) == 4 * r.n_tokens == 4 * sum(s.length for s in r.spans) <= 1024 and r.padding == padding(r.n_tokens, 256) for r in whole)
    assert sum(r.n_tokens for r in whole) == pieces.agg(F.sum("length")).first()[0]
    assert packing.pack(docs.limit(0), PATH).count() == 0
    null = packing.pack(spark.createDataFrame([(None, None)], "doc_id bigint, text string"), PATH).collect()
    assert [(r.doc_id, r.start, r.length, r.doc_tokens, r.offset) for r in null] == [(None, 0, 1, 1, 0)]


def test_query(spark, small):
    rows = queries.QUERIES["op11_packing"](spark, small).collect()
    library = Tokenizer.from_file(PATH)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    lengths = collections.Counter()
    for r in rows:
        ids = np.array([*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        lengths[r.sequence_id] += r.length
    assert {r.doc_id for r in rows} == set(texts) and max(lengths.values()) <= 2048
    assert sum(padding(n, 2048) for n in lengths.values()) <= 0.01 * sum(lengths.values())
