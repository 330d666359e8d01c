"""Operator 8 against plain counting and numpy."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scarpline.llm import queries, robust_quality
from scarpline.session import through_table
from tests.llm.conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    grams = list(zip(w, w[1:], w[2:]))
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark, docs, corpus):
    rng = random.Random(1)
    tricky = ["a a a", "a a a a", "a b c a b c", "a b c d a b c\n\na b c\na b c \n", "{a, b} c, d {a, b} c, d", " x y z x y z x y"]
    tricky += [" ".join(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(60)]
    rows = robust_quality.with_statistics(spark.createDataFrame([(t,) for t in tricky], "text string").unionByName(docs.select("text"))).collect()
    assert len(rows) == len(tricky) + len(corpus)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(r.text), r.text[:80]


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(60, 300)), rng.choice(["en", None]), rng.choice(["a", "a", "b", None])) for i in range(900)]
    junk = [(1000 + i, re.sub(r"(\w+)", r"\1###", prose(rng, 100)), "en", "a") for i in range(60)]
    junk += [(2000 + i, prose(rng, 100).upper(), "en", "b") for i in range(20)]
    frame = spark.createDataFrame([*rows, *junk, rows[0], (None, None, None, None)], "doc_id bigint, text string, lang string, source string")
    return through_table(robust_quality.with_statistics(frame.withColumn("distance", F.lit("mine"))), "statistics")


def test_outliers_go_and_clean_texts_stay(judged):
    rows = robust_quality.with_verdict(judged.withColumns({c: F.lit(c) for c in ("center", "inv", "z_length", "c", "bin", "all")})).collect()
    assert len(rows) == 982
    clean = [r for r in rows if r.doc_id is not None and r.doc_id < 1000 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.995 * len(clean)
    assert not any(r.kept for r in rows if r.doc_id is None or r.doc_id >= 1000)


def test_estimate_equals_numpy(judged):
    """The same steps in numpy: histogram ranks, moments, consistency factor, groups drawn to the language."""
    names, p = list(robust_quality.VECTOR), len(robust_quality.VECTOR)
    part, steps, prior = 0.6, 3, 150.0
    table = through_table(judged.where("doc_id IS NOT NULL").withColumns({"lang": F.lit("x"), "source": F.when(F.col("doc_id") % 9 == 0, "small").when(F.col("doc_id") == 7, "one").otherwise("large")}), "grouped")
    rows = robust_quality.with_vector(robust_quality.with_verdict(table, part=part, steps=steps, prior=prior)).collect()
    x = np.array([[r[z] for z in names] for r in rows], float) / 1000
    fair, source = np.array([not r.base_failed for r in rows]), np.array([r.source for r in rows])
    floor = np.array(list(robust_quality.VECTOR.values()))
    cut = lambda v, q: np.sort(np.floor(np.round(v * 1000) / 10))[int(np.ceil(q * len(v))) - 1] * 10 / 1000
    bound = robust_quality.chi2_at(part, p)
    factor = part / robust_quality.chi2_below(bound, p + 2)
    far = lambda v, mid, cov: np.einsum("ni,ij,nj->n", v - mid, np.linalg.inv(cov), v - mid)

    def estimate(v, base=None):
        own = len(v) / (len(v) + prior)
        drawn = lambda mid, cov: (mid, cov) if base is None else (own * mid + (1 - own) * base[0], own * cov + (1 - own) * base[1])
        sd = np.maximum([(cut(c, 0.75) - cut(c, 0.25)) / 1.349 for c in v.T], floor)
        mid, cov = drawn(np.array([cut(c, 0.5) for c in v.T]), np.diag(sd**2))
        for _ in range(steps):
            bins = np.floor(50 * np.log(far(v, mid, cov) + 1e-6))
            near = v[bins <= np.sort(bins)[int(np.ceil(part * len(v))) - 1]]
            mid, cov = drawn(near.mean(0), factor * np.cov(near.T, bias=True).reshape(p, p) + np.diag(floor**2))
        return mid, cov

    language = estimate(x[fair])
    assert {"small", "one", "large"} == set(source)
    for name in set(source):
        own = source == name
        if (own & fair).any():
            assert np.allclose(far(x[own], *estimate(x[own & fair], language)), [r.distance for r in rows if r.source == name], rtol=1e-6, atol=1e-9)


def test_chi_square():
    assert abs(robust_quality.chi2_at(0.95, 5) - 11.0705) < 1e-3 and abs(robust_quality.chi2_below(3.84146, 1) - 0.95) < 1e-5


def test_empty_and_small_groups(spark, docs):
    table = through_table(robust_quality.with_statistics(docs.drop("n_tokens", "score")), "statistics")
    assert robust_quality.with_verdict(table).count() == docs.count()
    assert robust_quality.with_verdict(table.limit(0)).count() == 0


def test_query_is_native(spark, small):
    found = queries.QUERIES["op8_robust_quality"](spark, small)
    assert found.count() == spark.read.parquet(f"{small}/documents.parquet").count()
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())


def test_repeats_alone_are_outliers_in_a_clean_source(spark):
    """Texts with 30 to 49% repeated words and nothing else unusual, where no other text repeats."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.choice((4, 5, 6))))
    clean = [(i, " ".join(word() for _ in range(rng.randint(100, 300)))) for i in range(400)]
    odd = []
    for k, share in enumerate((0.30, 0.35, 0.40, 0.45, 0.49)):
        half = [word() for _ in range(int(100 * share))]
        odd.append((1000 + k, " ".join([*half, *(word() for _ in range(200 - 2 * len(half))), *half])))
    frame = spark.createDataFrame(clean + odd, "doc_id bigint, text string").withColumns({"lang": F.lit("en"), "source": F.lit("a")})
    rows = robust_quality.with_verdict(through_table(robust_quality.with_statistics(frame), "statistics")).collect()
    found = [r for r in rows if r.doc_id >= 1000]
    assert all(0.29 <= r.n_repeat_words / r.n_words <= 0.5 and not r.base_failed for r in found)
    assert not any(r.kept for r in found)
    assert sum(r.kept for r in rows if r.doc_id < 1000) >= 390
