"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

* A tree of k-means splits is fitted on a bounded sample of vectors. Every vector of the table
  goes down to the leaf of its nearest centroids: all rows are indexed.
* A query walks the tree with a priority queue: the open node of the highest estimate is
  opened next, and leaves are visited as they come up.
* How many leaves each query visits is calibrated: a bounded number of queries is answered by
  brute force over all rows, in blocks, and visits are widened until those queries find the
  aimed-at share of their true neighbours.
* A query knows a floor, its k-th best score among a bounded part of the sample in the leaves
  it visits. No cell answers below it, so what cells send on stays near what is kept.
* Visited leaves meet their queries in cells of a bounded block of vectors and of queries, so
  neither a crowded leaf nor a large query set lands in one task. A cell is one matrix product.

Equal vectors are searched once. Of equal ones only the smallest ids can be answers (one more
than asked for, as a query is no answer to itself), so a vector that a third of all rows share
costs what one does; each of its rows still gets its own answer as a query.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no
part, nor do those of another length than most. Nearness is the inner product in double
precision, ties go to the smaller id; an id that repeats counts per row, except as an answer
to itself. Empty tables give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline.session import through_table

SEED = 42


def matrix(column) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


# ---------------------------------------------------------------- the tree


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin((centers**2).sum(1) - 2 * x @ centers.T, axis=1)
        sums, n = np.zeros_like(centers), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centers)
    return centers, np.argmin((centers**2).sum(1) - 2 * x @ centers.T, axis=1)


class Tree:
    """Inner nodes (centroids, spreads, children); a negative child is leaf -child - 1."""

    def __init__(self, x: np.ndarray, leaves: int, branch: int = 8):
        self.nodes: list[tuple[np.ndarray, np.ndarray, list[int]]] = []
        self.leaves = 0
        self.root = self._grow(x, max(2, len(x) // max(1, leaves)), branch, np.random.default_rng(SEED))

    def _grow(self, x, least, branch, rng) -> int:
        k = min(branch, len(x) // least)
        if k >= 2:
            centers, near = _means(x, k, rng)
            held = np.unique(near)
            if len(held) >= 2:
                spread = np.array([np.sqrt(((x[near == c] - centers[c]) ** 2).sum(1).mean()) for c in held])
                at = len(self.nodes)
                self.nodes.append((centers[held], spread, []))
                self.nodes[at][2].extend(self._grow(x[near == c], least, branch, rng) for c in held)
                return at
        self.leaves += 1
        return -self.leaves

    def place(self, x: np.ndarray) -> np.ndarray:
        leaf, todo = np.zeros(len(x), np.int32), [(self.root, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                leaf[rows] = -at - 1
            elif len(rows):
                centers, _, children = self.nodes[at]
                near = np.argmin((centers**2).sum(1) - 2 * x[rows] @ centers.T, axis=1)
                todo += [(child, rows[near == c]) for c, child in enumerate(children)]
        return leaf

    def visits(self, q: np.ndarray):
        """Leaves in best-bin-first order. A node's estimate is the inner product with its centroid
        and the spread of its vectors about it, along the query."""
        norm, heap = np.linalg.norm(q), [(0.0, self.root)]
        while heap:
            _, at = heapq.heappop(heap)
            if at < 0:
                yield -at - 1
                continue
            centers, spread, children = self.nodes[at]
            for value, child in zip(centers @ q + norm * spread / np.sqrt(len(q)), children, strict=True):
                heapq.heappush(heap, (-float(value), child))


# ---------------------------------------------------------------- parts of the search


def _best(scores: np.ndarray, first: np.ndarray, k: int, floor: float) -> np.ndarray:
    """Places of the k highest scores not below the floor, ties to the smaller first id, in order."""
    at = np.flatnonzero(scores >= floor)
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
    return at[np.lexsort((first[at], -scores[at]))][:k]


def _answers(qid: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: list[list[int]], v: np.ndarray, k: int) -> pa.Table:
    """For each query its k best (id, score) among some vectors, equal vectors id by id."""
    first = np.array([i[0] for i in ids], dtype=np.int64)
    out_q, out_v, out_s = [], [], []
    step = max(1, (1 << 22) // max(1, len(v)))
    for i in range(0, len(q), step):
        part = slice(i, i + step)
        for query, scores, least in zip(qid[part], q[part] @ v.T, floor[part], strict=True):
            left = k
            for at in _best(scores, first, k, least):
                own = ids[at][:left]
                out_q += [query] * len(own)
                out_v += own
                out_s += [scores[at]] * len(own)
                left -= len(own)
                if not left:
                    break
    return pa.table({"qid": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})


def floors(q: np.ndarray, visited: np.ndarray, some: np.ndarray, leaf: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k-th best answer cannot be below: its k-th best of some vectors
    that live in leaves it visits, less what rounding may differ by."""
    if len(some) < k or not len(q):
        return np.full(len(q), -np.inf)
    scores = np.where(visited[:, leaf], q @ some.T, -np.inf)
    best = np.partition(scores, -k, axis=1)[:, -k]
    return np.where(np.isfinite(best), best - 1e-9 * np.abs(best) - 1e-12, -np.inf)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each qid; most are dropped before the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def usable(v: Column) -> Column:
    flaw = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~flaw & F.exists(v, lambda x: x != 0), F.lit(False))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(v, id) rows -> each vector with its k smallest ids. A first cut by parts of the ids keeps
    a vector that many rows share from meeting in one task."""
    part = Window.partitionBy("v", F.pmod(F.xxhash64("id"), F.lit(8))).orderBy("id")
    whole = Window.partitionBy("v").orderBy("id")
    for order in (part, whole):
        rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")
    return rows.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


# ---------------------------------------------------------------- the search


def search(
    df: DataFrame, is_query: Column, *, id: str = "vec_id", vector: str = "embedding", k: int = 20, aim: float = 0.96,
    sample: int = 32_768, leaf: int = 1024, trial: int = 96, block: int = 4096,
) -> DataFrame:
    """Each query row's k nearest other rows: query_id, rank (from 1), vec_id, score.

    `sample` bounds the vectors the tree is fitted on and `trial` the queries it is calibrated
    with, both of which the driver gets; `aim` is the recall to reach on those. `leaf` is the
    size aimed at for a leaf (with at most sample / 32 leaves), `block` bounds a cell's vectors.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q")).where(usable(F.col("v")) & F.col("id").isNotNull())
    rows = through_table(rows, "vectors")
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (length.d if length else 0))
    keep = k + 1
    vectors = through_table(distinct_vectors(rows.select("v", "id"), keep), "distinct")
    asked = rows.where("q").groupBy("v").agg(F.min("id").alias("qid"))
    asked = through_table(asked, "queries")
    n, queries = vectors.count(), asked.count()

    part = lambda frame, most, of, by: frame.where(F.pmod(F.xxhash64(F.col(by), F.lit(3)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / max(1, of)))).limit(2 * most)
    points = part(vectors.withColumn("first", F.col("ids")[0]), sample, n, "first").select("first", "v").toArrow().sort_by("first")
    fitted = matrix(points["v"])
    tree = Tree(fitted, max(1, min(n // leaf, sample // 32)))
    shared = spark.sparkContext.broadcast(tree)
    some = fitted[: sample // 2]
    some = spark.sparkContext.broadcast((some, tree.place(some)))

    @F.arrow_udf("int")
    def place(v: pa.Array) -> pa.Array:
        return pa.array(shared.value.place(matrix(v)), pa.int32())

    placed = through_table(vectors.withColumn("leaf", place("v")), "placed")
    sizes = np.zeros(tree.leaves, np.int64)
    for r in placed.groupBy("leaf").count().collect():  # one row per leaf
        sizes[r.leaf] = r["count"]

    # Calibration: true neighbours of the trial queries over all rows, and where they live.
    tried = part(asked, trial, queries, "qid").toArrow().sort_by("qid")
    tq, tv = tried["qid"].to_numpy(), matrix(tried["v"])
    trials = spark.sparkContext.broadcast((tq, tv))

    def truth(batches):
        for batch in batches:
            if batch.num_rows:
                yield from _answers(*trials.value, np.full(len(trials.value[0]), -np.inf), batch.column(1).to_pylist(), matrix(batch.column(0)), keep).to_batches()

    true = _top(placed.select("v", "ids").mapInArrow(truth, "qid bigint, vec_id bigint, score double"), keep)
    homes = placed.select(F.explode("ids").alias("vec_id"), "leaf").dropDuplicates(["vec_id"])
    hits: dict[int, list[int]] = {}
    for r in true.join(homes, "vec_id").where("vec_id != qid").collect():  # trial x k rows
        hits.setdefault(r.qid, []).append(r.leaf)
    places = []
    for query, v in zip(tq, tv, strict=True):
        at = {found: i for i, found in enumerate(tree.visits(v))}
        places += [at[home] for home in hits.get(query, [])]
    places = np.sort(places)
    wide = 1 + int(places[min(len(places) - 1, int(np.ceil(aim * len(places))))]) if len(places) else tree.leaves

    sized = spark.sparkContext.broadcast(sizes)

    @F.arrow_udf("struct<leaves:array<int>, floor:double>")
    def visit(v: pa.Array) -> pa.Array:
        out, asks = [], matrix(v)
        visited = np.zeros((len(asks), len(sized.value)), bool)
        for row, q in enumerate(asks):
            own, held = [], 0
            for found in shared.value.visits(q):
                if len(own) >= wide and held >= keep:
                    break
                own.append(found)
                held += int(sized.value[found])
            out.append(own)
            visited[row, own] = True
        parts = [floors(asks[i : i + 256], visited[i : i + 256], *some.value, keep) for i in range(0, len(asks), 256)] or [np.zeros(0)]
        return pa.StructArray.from_arrays([pa.array(out, pa.list_(pa.int32())), pa.array(np.concatenate(parts))], ["leaves", "floor"])

    groups = -(-queries // (2 * block)) or 1
    blocks = F.array(*(F.lit(int(-(-s // block) or 1)) for s in sizes))
    left = placed.withColumn("b", F.pmod(F.xxhash64("ids"), blocks[F.col("leaf")]).cast("int")).select("leaf", "b", F.explode(F.expr(f"sequence(0, {groups - 1})")).alias("g"), "v", "ids")
    planned = asked.withColumn("plan", visit("v")).select("qid", "v", "plan.floor", "plan.leaves")
    right = planned.select("qid", "v", "floor", F.explode("leaves").alias("leaf")).withColumn("g", F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int"))
    right = right.select("leaf", F.explode(F.sequence(F.lit(0), blocks[F.col("leaf")] - 1)).alias("b"), "g", "qid", "floor", "v")

    def cell(vecs: pa.Table, qs: pa.Table) -> pa.Table:
        if not vecs.num_rows or not qs.num_rows:
            return _answers(np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(0), [], np.zeros((0, 1)), keep)
        return _answers(qs["qid"].to_numpy(), matrix(qs["v"]), qs["floor"].to_numpy(), vecs["ids"].to_pylist(), matrix(vecs["v"]), keep)

    found = left.groupBy("leaf", "b", "g").cogroup(right.groupBy("leaf", "b", "g")).applyInArrow(cell, "qid bigint, vec_id bigint, score double")
    lists = _top(found, keep).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("found"))  # k + 1 at most
    each = rows.where("q").select(F.col("id").alias("query_id"), "v").join(asked, "v").join(lists, "qid")
    each = each.select("query_id", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    each = each.select("query_id", F.posexplode("found").alias("rank", "e"))
    return each.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score"))
