"""Operator 10: flow, shares and selection."""

import itertools

import pytest
from pyspark.sql import functions as F

from checks.compare import compare, connect
from scarpline.llm import mixing, queries


def cost_of(patterns, quotas, taken, repeats):
    """Cheapest cost per pattern of a total taken, each copy costing one more than the last."""
    cost = 0
    for p, x in taken.items():
        for k in range(repeats):
            cost += k * max(0, min(patterns[p], x - k * patterns[p]))
    return cost


def feasible(patterns, quotas, taken):
    """Whether pattern totals can be split among their sources (Hall's condition on sources)."""
    for n in range(len(quotas) + 1):
        for some in itertools.combinations(quotas, n):
            if sum(x for p, x in taken.items() if set(p) <= set(some)) > sum(quotas[s] for s in some):
                return False
    return True


@pytest.mark.parametrize("quotas", [{"=a": 5, "=b": 3}, {"=a": 1, "=b": 7}, {"=a": 0, "=b": 0}, {"=a": 20, "=b": 20}])
def test_flow_is_largest_and_cheapest(quotas):
    patterns = {("=a",): 2, ("=b",): 2, ("=a", "=b"): 3}
    taken = mixing.cheapest_flow(patterns, quotas, 2)
    options = [dict(zip(patterns, x)) for x in itertools.product(*(range(2 * n + 1) for n in patterns.values()))]
    options = [o for o in options if feasible(patterns, quotas, o)]
    most = max(sum(o.values()) for o in options)
    assert feasible(patterns, quotas, taken) and sum(taken.values()) == most
    assert cost_of(patterns, quotas, taken, 2) == min(cost_of(patterns, quotas, o, 2) for o in options if sum(o.values()) == most)


def test_shares_refill():
    got = mixing.shares({"a": 10, "b": 100, None: 1000}, lambda i: (3.0, 1.0, 2.0)[i % 3], 1665.0, 2.0)
    assert got == {"a": 20.0, "b": 200.0, None: 1445.0}
    assert mixing.shares({}, lambda i: 1.0, 0.0, 2.0) == {}


def test_mix_of_overlapping_sources(spark, docs, corpus):
    members = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array("source"))
    runs = []
    for _ in range(2):
        mixed, totals = mixing.mix(docs, members, lambda i: 1.0, digits=1)
        rows = mixed.collect()
        runs.append(sorted(((r.doc_id, r.text, r.copies) for r in rows), key=repr))
    assert runs[0] == runs[1] and len(rows) == len(corpus)
    assert all(r.copies in (0, 1, 2) and r.taken == r.copies * r.size == r.copies * len((r.text or "").split()) for r in rows if not set("\x1c\x85") & set(r.text or ""))
    want = sum(r.target for r in totals.collect())
    assert abs(sum(r.taken for r in rows) - want) <= 4 * max(r.size for r in rows)
    assert mixing.mix(docs.limit(0), members, lambda i: 1.0)[0].count() == 0


def test_single_sources_come_near_their_targets(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 7).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("source"))
    mixed, totals = mixing.mix(rows, F.array("source"), lambda i: (3.0, 1.0)[i % 2])
    taken = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    for r in totals.collect():
        assert abs(taken[r.source] - r.target) <= 7


def test_too_many_patterns_are_refused(docs):
    with pytest.raises(ValueError):
        mixing.mix(docs, F.array("source"), lambda i: 1.0, most_patterns=2)


def test_query_equals_sql(spark, small):
    ok, message = compare(spark, connect(small), small, "op10_mixing", queries.QUERIES["op10_mixing"], queries.ORACLES["op10_mixing"])
    assert ok, message
