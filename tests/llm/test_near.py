"""Operator 9 and the near-duplicate stage against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from scarpline.llm import simhash
from scarpline.llm.components import components
from tests.llm.conftest import prose


def plain_fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    parts = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def plain_roots(links, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def flipped(rng, base, bits):
    for b in rng.sample(range(64), bits):
        base ^= 1 << b
    return base - (1 << 64) if base >> 63 else base


def test_fingerprints(corpus):
    for _, text in corpus:
        assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("leaf", [4, 50, 16_384])
def test_links_span_all_pairs(spark, leaf):
    """Chains, dense groups and far points, in leaves of any size, blocks of hot leaves too."""
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    points = [flipped(rng, s, rng.randint(0, 5)) for s in seeds for _ in range(8)] + [flipped(rng, seeds[0], rng.randint(0, 3)) for _ in range(300)]
    points = sorted(set(points))
    got = {r.fp: r.root for r in simhash.fingerprint_roots(spark.createDataFrame([(p,) for p in points], "fp bigint"), 3, leaf=leaf, sample=400).collect()}
    bits = np.array(points).view(np.uint64)
    near = np.argwhere(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3)
    roots = plain_roots([(a, b) for a, b in near if a < b], len(points))
    assert got == {points[i]: points[r] for i, r in enumerate(roots) if roots.count(r) > 1}


def test_near_duplicates(docs, corpus):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(corpus)
    prints = [plain_fingerprint(t) for _, t in corpus]
    close = [(a, b) for a in range(len(corpus)) for b in range(a) if bin((prints[a] ^ prints[b]) & (2**64 - 1)).count("1") <= 3]
    roots = plain_roots(close, len(corpus))
    low = {r: min((i for (i, _), x in zip(corpus, roots) if x == r and i is not None), default=None) for r in roots}
    want = sorted(((i, p, low[r]) for (i, _), p, r in zip(corpus, prints, roots)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=repr) == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_stage_keeps_one_of_near_copies(spark):
    rng = random.Random(8)
    bases = [prose(rng, 200) for _ in range(12)]
    copies = [b.split(" ") for b in bases for _ in range(2)]
    for c in copies:
        c[rng.randrange(200)] = "changed"
        c[rng.randrange(200)] = "altered"
    texts = [*bases, *(" ".join(c) for c in copies), bases[0], None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, bases[3]), (None, bases[4])], "doc_id bigint, text string")
    kept = simhash.without_near_duplicates(rows, leaf=10, sample=100)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(12), len(texts) - 2]
    assert kept.columns == ["doc_id", "text"]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (300, 301), (301, 300)], "u bigint, v bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 300: 300, 301: 300}
    assert components(edges.limit(0)).count() == 0
    assert components(edges.withColumn("u", F.col("v"))).count() == 0


def test_stage_links_all_pairs_at_the_required_similarity(spark):
    """Appended blocks, replaced passages and scattered edits at J 0.80 to 0.85, repeated passages
    (same shingles), and pairs below the bound, against brute force."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = []
    for i in range(240):
        w = [word() for _ in range(300)]
        k = rng.randint(52, 80)
        texts.append(w)
        if i % 4 == 0:
            texts.append(w + [word() for _ in range(k)])
        elif i % 4 == 1:
            at, k = rng.randrange(200), k // 2
            texts.append(w[:at] + [word() for _ in range(k)] + w[at + k :])
        elif i % 4 == 2:
            cut = set(rng.sample(range(300), rng.randint(5, 8)))
            texts.append([word() if j in cut else x for j, x in enumerate(w)])
        else:
            texts.append(w * 3)
            texts.append(w * 4)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a + 1, min(a + 3, len(texts))) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert 200 < len(links)
    roots = plain_roots(links, len(texts))
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    kept = sorted(r.doc_id for r in simhash.without_near_duplicates(rows).collect())
    assert kept == sorted(set(roots))


def test_hot_bucket_meets_in_blocks(spark):
    """One large group of near copies, few of them neighbours, against all pairs."""
    from scarpline.llm import similar

    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    texts = [[f"x{i}.{k}" if k in cut else w for k, w in enumerate(base)] for i in range(150) for cut in [set(rng.sample(range(150), rng.randint(2, 8)))]]
    held = [similar.shingles(" ".join(w).encode()) for w in texts]
    both = similar.overlaps(held, held)
    sizes = np.array([len(h) for h in held])
    assert all(both[a, b] == len(np.intersect1d(held[a], held[b])) for a in range(20) for b in range(20))
    links = [(a, b) for a, b in np.argwhere(both >= 0.8 * (sizes[:, None] + sizes - both)) if a < b]
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "node bigint, text string")
    points = similar._with_sketch(rows, "text", 5).select("node", "__s.n", "__s.bands")
    got = {r.node: r.root for r in similar.similar_roots(points, rows, 0.8, 5, block=20).collect()}
    roots = plain_roots(links, len(texts))
    assert got == {i: r for i, r in enumerate(roots) if roots.count(r) > 1}


def test_stage_holds_fingerprint_components_against_the_sets(spark, monkeypatch):
    """Without MinHash bands the fingerprints' components alone must find near copies, and the exact
    check must part texts whose fingerprints are equal and whose sets are not."""
    from scarpline.llm import similar

    rng = random.Random(12)
    bases = [prose(rng, 400) for _ in range(8)]
    near = [" ".join(w if k else "changed" for k, w in enumerate(b.split(" "))) for b in bases]
    apart = [plain_fingerprint(a) ^ plain_fingerprint(b) for a, b in zip(bases, near)]
    found = [i for i, x in enumerate(apart) if bin(x & (2**64 - 1)).count("1") <= 3]
    assert found
    lone = " ".join(f"w{k}" for k in range(100))
    texts = [*bases, *near, lone, " ".join(f"v{k}" for k in range(100))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(similar, "bands", lambda held: np.arange(similar.BANDS, dtype=np.int64) * 1_000_003 + int(held.sum() >> np.uint64(2)) if len(held) else np.zeros(similar.BANDS, np.int64))
    asked = []
    monkeypatch.setattr(simhash, "fingerprint_roots", lambda prints, radius=3, f=simhash.fingerprint_roots, **o: asked.append(radius) or f(prints, radius, **o))
    kept = {r.doc_id for r in simhash.without_near_duplicates(rows).collect()}
    assert asked == [3]
    assert kept == set(range(len(texts))) - {8 + i for i in found}
    # Equal marks propose; the sets decide.
    same = similar.without_near_duplicates(
        rows, mark=lambda r: r.withColumn("__mark", F.lit(7).cast("bigint")), grouped=lambda m: m.select("node", "n", F.col("mark").alias("key"))
    )
    want = {tuple(t.split(" ")) for t in texts}
    assert len(want) == len(texts) and {r.doc_id for r in same.collect()} == set(range(8)) | {16, 17}


def test_stage_loses_no_pair_that_shares_neither_a_band_nor_a_fingerprint_component(spark):
    """Found by search: nine shingles each, eight of them shared, yet no band of the forty is equal
    and the fingerprints are six bits or more apart."""
    from scarpline.llm import similar

    line = " ".join(f"w{k}" for k in range(11))
    pairs = [("x1775 a0", "y216"), ("x1723 a3", "y2875"), ("x2974 a3", "y509"), ("x1057 a5", "y1938")]
    texts = [t for x, y in pairs for t in (f"{x} {line}", f"{x.split()[1]} {line} {y}")]
    for a, b in zip(texts[::2], texts[1::2]):
        one, two = (similar.shingles(t.encode()) for t in (a, b))
        assert len(one) == len(two) == 9 and len(np.intersect1d(one, two)) == 8
        assert not (similar.bands(one) == similar.bands(two)).any()
        assert bin((plain_fingerprint(a) ^ plain_fingerprint(b)) & (2**64 - 1)).count("1") > 3
    kept = {t: simhash.without_near_duplicates(spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")).collect() for t, (a, b) in enumerate(zip(texts[::2], texts[1::2]))}
    assert [[r.doc_id for r in rows] for rows in kept.values()] == [[1]] * 4


@pytest.mark.parametrize("hot", [2, 5, 256])
def test_all_links_without_bands(spark, monkeypatch, hot):
    """Bands that never meet: what their pairs leave out must be found all the same, in small and
    large buckets, by lists of pairs and in blocks, against all pairs."""
    from scarpline.llm import similar

    monkeypatch.setattr(similar, "HOT", hot)
    monkeypatch.setattr(similar, "FLUSH", 3000)
    rng = random.Random(hot)
    common = [f"c{k}" for k in range(40)]
    words = []
    for g in range(6):
        base = [f"g{g}.{k}" for k in range(60)] + common[: 8 * g]
        for i in range(20):
            cut = set(rng.sample(range(len(base)), rng.randint(0, 5)))
            words.append([f"x{g}.{i}.{k}" if k in cut else w for k, w in enumerate(base)] + [f"e{g}.{i}.{k}" for k in range(rng.randint(0, 12))])
    words += [[f"l{k}" for k in range(n)] for n in range(1, 30)] + [["one"], ["l0", "x"], common]
    texts = list(dict.fromkeys(" ".join(w) for w in words))
    held = [similar.shingles(t.encode()) for t in texts]
    sizes, both = np.array([len(h) for h in held]), similar.overlaps(held, held)
    links = [(a, b) for a, b in np.argwhere(both + 1e-9 >= 0.8 * (sizes[:, None] + sizes - both)) if a < b]
    roots = plain_roots(links, len(texts))
    rows = spark.createDataFrame(list(enumerate(texts)), "node bigint, text string").repartition(3)
    points = similar._with_sketch(rows, "text", 5).select("node", "__s.n", F.array(F.col("node") * 2 + 1_000_003).alias("bands"))
    got = {r.node: r.root for r in similar.similar_roots(points, rows, 0.8, 5, block=8).collect()}
    assert got == {i: r for i, r in enumerate(roots) if roots.count(r) > 1}
