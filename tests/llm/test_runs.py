"""Operator 12 against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from scarpline.llm import queries, runs


def brute(w, least, power):
    n, out = len(w), set()
    for q in range(1, n // power + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            s = i - q
            while i < n and w[i] == w[i - q]:
                i += 1
            smaller = any(all(w[k] == w[k - d] for k in range(s + d, i)) for d in range(1, q))
            if i - s >= max(least, power * q) and not smaller:
                out.add((s, i - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def sample(rng):
    n, k = rng.choice((0, 1, 5, 6, 7, 12, 30, 60)), rng.choice((1, 2, 3, 8))
    w = [rng.randrange(k) for _ in range(n)]
    if n > 6 and rng.random() < 0.5:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 3))
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    return [b"w%d" % x for x in w]


@pytest.mark.parametrize("least,power", [(6, 4), (2, 2), (4, 3)])
def test_runs_equal_brute_force(least, power):
    rng = random.Random(least)
    for _ in range(1500):
        words = sample(rng)
        assert runs.find_runs(words, least, power) == brute(words, least, power)


def test_segments_are_last_occurrences():
    """Each square that access reports: the words before both ends agree that far and no farther,
    and do not occur in between."""
    rng = random.Random(4)
    for _ in range(300):
        w = [rng.randrange(3) for _ in range(rng.randint(2, 40))]
        for end, length, distance in runs.squares(w, 2):
            u = w[end - length : end]
            assert w[end - distance - length : end - distance] == u and length >= distance
            assert end - distance - length == 0 or w[end - length - 1] != w[end - distance - length - 1]
            assert all(w[e - length : e] != u for e in range(end - distance + 1, end) if e >= length)


def test_stretches_keep_every_run():
    rng = random.Random(5)
    for _ in range(800):
        words = sample(rng)
        kept = runs.stretches(words)
        assert all(any(a <= s and s + n <= b for a, b in kept) for s, n, _ in brute(words, 6, 4))


def test_long_repetitions():
    cycle = [b"%d" % i for i in range(40)]
    assert runs.find_runs([b"x", *cycle * 600, b"39"]) == [(1, 24_000, 40)]
    assert runs.find_runs([b"a"] * 30_000) == [(0, 30_000, 1)]
    assert runs.find_runs(cycle * 3 + cycle[:39]) == [] and runs.find_runs(cycle * 4) == [(0, 160, 40)]


def test_frame(spark, docs, corpus):
    got = runs.with_runs(docs.withColumn("runs", F.lit("old"))).collect()
    assert len(got) == len(corpus) and {"n_tokens", "score", "lang"} <= set(got[0].asDict())
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for r in got:
        own = words(r.text)
        found = brute(own, 6, 4) if len(own) < 5000 else [(0, len(own), 2)]  # the long text is "a b " again and again
        assert (r.n_words, [tuple(x) for x in r.runs]) == (len(own), found)
        dropped = {i for s, n, q in found for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(x for i, x in enumerate(own) if i not in dropped)
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (r.strongest and tuple(r.strongest)) == best
    assert runs.with_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.with_runs(docs, power=1)


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w, 6, 4)
    best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_query_equals_brute_force(spark, small):
    rows = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_runs"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs) and sum(r[1] > 0 for r in rows.values()) > 5
    for r in docs:
        assert rows[r.doc_id] == expected(r.doc_id, r.text)


def test_query_on_flawed_rows(spark, tmp_path):
    from scarpline.session import scratch_path

    folder = scratch_path(spark, "flawed")
    rows = [(i, t) for i in range(60) for t in (None, "", " \n", "one", "a a a a a a", "x y " * 30, "no run here at all, really")]
    spark.createDataFrame([*rows, (None, "b " * 9)], "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES["op12_runs"](spark, folder).collect()), key=repr)
    want = [expected(i, t) for i, t in rows] + [(None, *expected(3, "b " * 9)[1:])]
    assert zlib.crc32(b"3") % 10 and got == sorted(want, key=repr)
