"""Mixing overlapping sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by membership pattern; pattern
totals are a small graph: a pattern can send its words to each of its sources, once for
nothing, and again at a cost that grows with each repetition, up to `repeats` copies; each
source takes as many words as its quota. The cheapest largest flow says how many words of
each pattern the mix takes. Documents are then selected in a seeded order: whole copies for
all of a pattern, and one more for the first documents of the order until the rest is met.

The order is never sorted as a whole. Words are summed per pattern and leading digits of the
seeded key; only the stretch in which the rest runs out is ordered row by row, and it yields
one threshold per pattern. Every row then decides by itself.

Defined results: a null text has no words; sources order by code point, null last; a null or
empty membership list is the null source; a repeated row is a document of its own; ties of
the seeded order fall to the smaller document, then to the earlier written row, between equal
rows only. An empty table gives an empty mix. Columns named like an output are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline.session import through_table

WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("bigint")


def shares(sizes: dict, weight: Callable[[int], float], budget: float, ceiling: float) -> dict:
    """Source -> target. The budget is shared by weight, a target stops at `ceiling` times its
    source's size, and the excess is shared again: sources fill up in order of size by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    rows = sorted((ceiling * sizes[s] / weight(i), i, s) for i, s in enumerate(order))
    left, rest, targets = budget, sum(weight(i) for _, i, _ in rows), {}
    level = None
    for full, i, s in rows:
        if level is None and full > left / rest:
            level = left / rest
        targets[s] = ceiling * sizes[s] if level is None else level * weight(i)
        if level is None:
            left, rest = left - ceiling * sizes[s], rest - weight(i)
    return targets


def cheapest_flow(patterns: dict[tuple, int], quotas: dict, repeats: int) -> dict[tuple, int]:
    """Words taken of each pattern: a largest flow to the quotas of least cost, by shortest
    augmenting paths. The k-th copy of a word costs k - 1."""
    graph: dict = {}

    def arc(a, b, room, cost):
        graph.setdefault(a, []).append([b, room, cost, len(graph.setdefault(b, []))])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, size in patterns.items():
        for k in range(repeats):
            arc("from", ("p", p), size, k)
        for s in p:
            arc(("p", p), ("s", s), repeats * size, 0)
    for s, quota in quotas.items():
        arc(("s", s), "to", quota, 0)
    level = dict.fromkeys(graph, 0)  # potentials keep costs from being negative
    while graph:
        dist, back, queue, n = {"from": 0}, {}, [(0, 0, "from")], 0
        while queue:
            d, _, a = heapq.heappop(queue)
            if d > dist[a]:
                continue
            for i, (b, room, cost, _) in enumerate(graph[a]):
                far = d + cost + level[a] - level[b]
                if room > 0 and far < dist.get(b, float("inf")):
                    dist[b], back[b], n = far, (a, i), n + 1
                    heapq.heappush(queue, (far, n, b))
        if "to" not in dist:
            break
        most = max(dist.values())
        for a in level:
            level[a] += dist.get(a, most)
        path, b = [], "to"
        while b != "from":
            a, i = back[b]
            path.append((a, i))
            b = a
        amount = min(graph[a][i][1] for a, i in path)
        for a, i in path:
            b, _, _, j = graph[a][i]
            graph[a][i][1] -= amount
            graph[b][j][1] += amount
    taken = dict.fromkeys(patterns, 0)
    for b, room, cost, _ in graph.get("from", []):
        taken[b[1]] += patterns[b[1]] - room
    return taken


def mix(
    df: DataFrame, members: Column, weight: Callable[[int], float], *, id: str = "doc_id", text: str = "text", share: float = 1.5,
    repeats: int = 2, seed: int = 42, digits: int = 3, most_patterns: int = 100_000,
) -> tuple[DataFrame, DataFrame]:
    """(documents with `size`, `copies` and `taken`; targets of the sources).

    `members` is the array of a document's sources, `weight` gives the weight of the i-th source
    in order. The mix takes `share` times all words and no document more than `repeats` times;
    targets have (source, source_size, target). `digits` hexadecimal digits of the key cut the
    seeded order into stretches. The driver sees one row per pattern; more than `most_patterns`
    are refused.
    """
    spark = df.sparkSession
    listed = F.array_sort(F.array_distinct(F.transform(members, lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("")))))
    listed = F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("")))
    table = df.withColumns(
        {
            "size": words(text),
            "__members": listed,
            "__key": F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string")).cast("binary")),
            "__row": F.monotonically_increasing_id(),
        }
    )
    table = through_table(table, "mix").withColumn("__at", F.substring("__key", 1, digits))
    found = table.groupBy("__members").agg(F.sum("size").alias("n")).limit(most_patterns + 1).collect()
    if len(found) > most_patterns:
        raise ValueError(f"more than {most_patterns} membership patterns")
    name = lambda s: s[1:] if s else None
    patterns = {tuple(r["__members"]): r.n for r in found}
    sizes: dict = {}
    for p, n in patterns.items():
        for s in p:
            sizes[name(s)] = sizes.get(name(s), 0) + n
    targets = shares(sizes, weight, share * sum(patterns.values()), float(repeats))
    taken = cheapest_flow(patterns, {s: int(targets[name(s)]) for p in patterns for s in p}, repeats)

    plan = spark.createDataFrame(
        [(list(p), taken[p] // n if n else 0, taken[p] % n if n else 0) for p, n in patterns.items()],
        "__members array<string>, __whole bigint, __rest bigint",
    )
    sums = table.groupBy("__members", "__at").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("__members").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    stretch = sums.join(plan, "__members").where((F.col("before") < F.col("__rest")) & (F.col("before") + F.col("n") >= F.col("__rest")))
    stretch = stretch.groupBy("__members", "__rest").agg(F.min_by(F.struct("__at", "before"), "__at").alias("s"))
    stretch = stretch.select("__members", "__rest", "s.*")
    order = Window.partitionBy("__members").orderBy("__key", "size", "__row").rowsBetween(Window.unboundedPreceding, -1)
    rows = table.select("__members", "__at", "__key", "size", "__row").join(stretch, ["__members", "__at"])
    rows = rows.withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    # A document is in when its middle word is: the total is then as near as whole documents allow.
    last = rows.groupBy("__members").agg(
        F.max(F.when(2 * F.col("before") + F.col("size") <= 2 * F.col("__rest"), F.struct("__key", "size", "__row"))).alias("last"),
        F.min("__at").alias("from"),
    )
    ends = {tuple(r["__members"]): (r["last"], r["from"]) for r in last.collect()}
    end_of = lambda p: tuple(ends[p][0] or (ends[p][1], -1, -1)) if p in ends else (None, None, None)
    plan = spark.createDataFrame(
        [(list(p), taken[p] // n if n else 0, *end_of(p)) for p, n in patterns.items()],
        "__members array<string>, __whole bigint, __k string, __s bigint, __r bigint",
    )
    upto_last = F.struct("__key", "size", "__row") <= F.struct(F.col("__k").alias("__key"), F.col("__s").alias("size"), F.col("__r").alias("__row"))
    # One row per pattern, most_patterns at most: the documents stay where they are.
    chosen = table.join(F.broadcast(plan), "__members").withColumn("copies", F.col("__whole").cast("int") + (F.col("__k").isNotNull() & upto_last).cast("int"))
    chosen = chosen.withColumn("taken", F.col("copies") * F.col("size"))
    out = chosen.select(*[c for c in df.columns if c not in ("size", "copies", "taken")], "size", "copies", "taken")
    totals = spark.createDataFrame([(s, sizes[s], targets[s]) for s in sizes], "source string, source_size bigint, target double")
    return out, totals
