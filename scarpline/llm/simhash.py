"""Near-duplicate texts by SimHash fingerprints and vantage-point trees.

A text's 64-bit fingerprint has a bit set when more than half of its shingle hashes have it.
Fingerprints within `radius` bits link; documents reachable through links form a component.

Exact search without all pairs:

* Equal fingerprints become one first, so exact copies cost nothing.
* A vantage-point tree is fitted on a bounded sample of fingerprints: a node has a vantage
  point and the median distance to it; near ones go left, far ones right. The tree only
  deals out work, so the sample cannot change the result. Where links also bound the ratio
  of sizes, a node may measure the distance in size instead, whichever copies less.
* Each fingerprint lives in one leaf. By the triangle inequality only leaves whose ball or
  shell it can reach within `radius` hold its partners. It visits those behind its own, so
  each pair meets in exactly one leaf: the later one's home.
* A leaf with more fingerprints than a block holds is dealt out as pairs of blocks, and so are
  its visitors: a task holds two blocks, whatever the leaf. Inside a task the tree goes on down
  to small sets, compared in blocks of bits.
* A task keeps a union-find of its links and emits a spanning star of each group, never all
  pairs. `components` joins the stars.

`without_near_duplicates` holds what a component joins against the texts' shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline.session import through_table

from . import similar
from .components import components
from .similar import Groups

SEED = 42


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text; zero when it has no word."""
    import xxhash

    parts = (text or b"").lower().split()
    if not parts:
        return 0
    ends, n = [], -1
    for w in parts:
        n += len(w) + 1
        ends.append(n)
    line, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [hashed(line, SEED)]
    else:
        starts = [0, *(e + 1 for e in ends[:-words])]
        hashes = [hashed(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[i : i + (1 << 14)], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes)).view(">i8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", words: int = 3) -> DataFrame:
    """Add the fingerprint as a signed long. Null and wordless texts get zero, texts of fewer
    words than a shingle one shingle of what there is. A column named like `out` is replaced."""

    @F.arrow_udf("bigint")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array((fingerprint(x.as_py(), words) for x in texts.cast(pa.binary())), pa.int64())

    return df.withColumn(out, prints(F.col(text).cast("string")))


# ---------------------------------------------------------------- the tree


class Points:
    """Fingerprints of one or more words of 64 bits, and the logarithm of a size."""

    def __init__(self, bits: np.ndarray, size: np.ndarray):
        self.bits, self.size = bits, size

    @classmethod
    def of(cls, columns: list[np.ndarray], size: np.ndarray):
        return cls(np.stack([c.view(np.uint64) for c in columns], axis=1), size)

    def __len__(self):
        return len(self.size)

    def __getitem__(self, rows):
        return Points(self.bits[rows], self.size[rows])

    def away(self, v: np.ndarray | None) -> np.ndarray:
        """Distance to a vantage point: in bits to a fingerprint, else in size to none."""
        if v is None:
            return self.size
        return np.bitwise_count(self.bits ^ v).sum(axis=1, dtype=np.int16)


class Reach:
    """What links: at most `bits` differing bits, and sizes at most `size` apart (logarithms)."""

    def __init__(self, bits: int, size: float = np.inf):
        self.bits, self.size = bits, size

    def along(self, v) -> float:
        return self.size if v is None else self.bits

    def split(self, points: Points, rng: np.random.Generator) -> tuple[np.ndarray | None, float, float] | None:
        """(vantage, median distance, share of points that can reach both sides): of the size and
        a few fingerprints as vantage points, the one with the least such share."""
        tries = [points.bits[i] for i in rng.choice(len(points), min(12, len(points)), replace=False)]
        if np.isfinite(self.size):
            tries.append(None)
        best = None
        for v in tries:
            d = points.away(v)
            m = np.sort(d)[(len(d) - 1) // 2]
            if m == d.max():
                below = d[d < m]
                if not len(below):
                    continue
                m = below.max()
            both = float(((d <= m + self.along(v)) & (d > m - self.along(v))).mean())
            if best is None or both < best[2]:
                best = (v, m, both)
        return best


class Tree:
    """Nodes (vantage, median distance, left, right); a negative child is leaf -child - 1. Where
    most points would reach both sides, a split would only copy them: the node stays a leaf."""

    def __init__(self, points: Points, leaves: int, reach: Reach):
        rng = np.random.default_rng(SEED)
        self.nodes: list[list] = []
        self.leaves, self.reach = 0, reach
        self.root = self._grow(points, max(1, len(points) // max(1, leaves)), rng)

    def _grow(self, points: Points, least: int, rng) -> int:
        split = self.reach.split(points, rng) if len(points) >= 2 * least and len(points) > 1 else None
        if split is None or split[2] > 0.9:
            self.leaves += 1
            return -self.leaves
        v, m, _ = split
        at = len(self.nodes)
        self.nodes.append([v, m, 0, 0])
        near = points.away(v) <= m
        self.nodes[at][2] = self._grow(points[near], least, rng)
        self.nodes[at][3] = self._grow(points[~near], least, rng)
        return at

    def visits(self, points: Points) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows at home in it, rows that can reach it)."""
        todo = [(self.root, np.ones(len(points), bool), np.arange(len(points)))]
        while todo:
            at, home, rows = todo.pop()
            if not len(rows):
                continue
            if at < 0:
                yield -at - 1, rows[home], rows
                continue
            v, m, left, right = self.nodes[at]
            d, far = points[rows].away(v), self.reach.along(v)
            for child, own, near in ((left, d <= m, d <= m + far), (right, d > m, d > m - far)):
                todo.append((child, (home & own)[near], rows[near]))


# ---------------------------------------------------------------- inside a task


def link_near(points: Points, members: np.ndarray, queries: np.ndarray, reach: Reach, groups: Groups) -> None:
    """Link each query row to every member row within reach: the tree, down to small sets."""
    rng = np.random.default_rng(SEED)
    todo = [(members, queries)]
    while todo:
        m, q = todo.pop()
        if not len(m) or not len(q):
            continue
        split = reach.split(points[m], rng) if len(m) > 256 else None
        if split:
            v, cut, _ = split
            far, dm, dq = reach.along(v), points[m].away(v), points[q].away(v)
            near, beyond = q[dq <= cut + far], q[dq > cut - far]
            inner, outer = m[dm <= cut], m[dm > cut]
            if len(inner) * len(near) + len(outer) * len(beyond) < 0.85 * len(m) * len(q):
                todo += [(inner, near), (outer, beyond)]
                continue
        held, step = points[m], max(1, (1 << 20) // len(m))
        for i in range(0, len(q), step):
            block = q[i : i + step]
            part, apart = points[block], 0
            for k in range(held.bits.shape[1]):
                apart = apart + np.bitwise_count(part.bits[:, k][:, None] ^ held.bits[:, k][None, :])
            near = apart <= reach.bits
            if np.isfinite(reach.size):
                near &= np.abs(part.size[:, None] - held.size[None, :]) <= reach.size
            x, y = np.nonzero(near)
            groups.link(block[x], m[y])


def _points(table: pa.Table, lanes: list[str]) -> Points:
    column = lambda c: table[c].to_numpy()
    return Points.of([column(c) for c in lanes], column("size"))


def _cell(reach: Reach, lanes: list[str]):
    """Rows of one cell -> spanning stars. Home rows of the first block meet those of the second
    (or each other, in a cell of one block); visitors meet the home rows. Copies of home rows
    that are there for a further block of visitors meet only those."""

    def links(table: pa.Table) -> pa.Table:
        points, side, groups = _points(table, lanes), table["side"].to_numpy(), Groups(table.num_rows)
        first, second, visiting, copies = (np.flatnonzero(side == k) for k in (0, 1, 2, 3))
        if len(second):
            link_near(points, second, first, reach, groups)
        elif table["i"][0].as_py() == table["j"][0].as_py():
            link_near(points, first, first, reach, groups)
        link_near(points, np.concatenate([first, copies]), visiting, reach, groups)
        rows = np.flatnonzero(groups.root != np.arange(len(points)))
        node = table["node"].to_numpy()
        return pa.table({"u": node[rows], "v": node[groups.root[rows]]})

    return links


# ---------------------------------------------------------------- the search


def near_links(nodes: DataFrame, lanes: list[str], radius: int, window: float = float("inf"), leaf: int = 16_384, sample: int = 65_536) -> DataFrame:
    """Different points (a table of `node`, the `lanes` of their bits, and `size`) -> edges (u, v) of
    nodes that span the same components as all pairs within `radius` bits and `window` of size.

    `leaf` is the size aimed at for a leaf and the largest block of one. Large leaves are cheap,
    since the tree goes on inside a task, while each halving of them multiplies the copies that
    visit other leaves. `sample` bounds the points the tree is fitted on (which the driver gets)
    and so the leaves: sample / 16 at most.
    """
    spark, n, reach = nodes.sparkSession, nodes.count(), Reach(radius, window)
    drawn = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, n)))).limit(2 * sample)
    points = _points(drawn.select(*lanes, "size", "node").toArrow().sort_by("node"), lanes)
    shared = spark.sparkContext.broadcast(Tree(points, max(1, min(n // leaf, sample // 16)), reach))

    @F.arrow_udf("struct<home:int, visits:array<int>>")
    def place(size: pa.Array, *columns: pa.Array) -> pa.Array:
        at = Points.of([c.to_numpy(zero_copy_only=False) for c in columns], size.to_numpy(zero_copy_only=False))
        home, rows, leaves = np.zeros(len(at), np.int32), [], []
        for k, own, near in shared.value.visits(at):
            home[own] = k
            rows.append(near)
            leaves.append(np.full(len(near), k, np.int32))
        rows, leaves = (np.concatenate(x) if x else np.zeros(0, int) for x in (rows, leaves))
        later = leaves > home[rows]
        rows, leaves = rows[later], leaves[later]
        order = np.argsort(rows, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(at)))])
        visits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(leaves[order], pa.int32()))
        return pa.StructArray.from_arrays([pa.array(home), visits], ["home", "visits"])

    own = ["node", *lanes, "size"]
    own = list(dict.fromkeys(own))
    placed = through_table(nodes.select(*own, place("size", *lanes).alias("p")).select(*own, "p.home", "p.visits"), "placed")
    # One row per leaf each: how many blocks its own rows and its visitors fill.
    sizes = {r.home: r["count"] for r in placed.groupBy("home").count().collect()}
    guests = {r.at: r["count"] for r in placed.select(F.explode("visits").alias("at")).groupBy("at").count().collect()}

    def filled(counts: dict) -> Column:
        many = {k: -(-c // leaf) for k, c in counts.items() if c > leaf}
        if not many:
            return F.lit(1)
        return F.coalesce(F.create_map(*(F.lit(x) for kv in many.items() for x in kv))[F.col("at")], F.lit(1))

    dealt = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    home = placed.select(*own, F.col("home").alias("at")).withColumns({"n": filled(sizes), "guests": filled(guests)}).withColumn("b", dealt(1, "n"))
    home = home.select(*own, "at", "b", "guests", F.explode(F.expr("sequence(0, n - 1)")).alias("o"))
    # Where the rows of a block meet each other, the leaf's visitors come too, block by block.
    home = home.select(*own, "at", "b", "o", F.explode(F.when(F.col("b") == F.col("o"), F.expr("sequence(0, guests - 1)")).otherwise(F.array(F.lit(0)))).alias("w"))
    part = F.when(F.col("w") > 0, 3).when(F.col("b") <= F.col("o"), 0).otherwise(1)
    home = home.select(*own, "at", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "w", part.alias("side"))
    away = placed.select(*own, F.explode("visits").alias("at")).withColumns({"n": filled(sizes), "guests": filled(guests)}).withColumn("w", dealt(2, "guests"))
    away = away.select(*own, "at", F.explode(F.expr("sequence(0, n - 1)")).alias("i"), "w").select(*own, "at", "i", F.col("i").alias("j"), "w", F.lit(2).alias("side"))
    return home.unionByName(away).groupBy("at", "i", "j", "w").applyInArrow(_cell(reach, lanes), "u bigint, v bigint")


def fingerprint_roots(prints: DataFrame, radius: int = 3, **options) -> DataFrame:
    """Fingerprints `fp` -> (fp, root) for those that have a link to a different one."""
    distinct = through_table(prints.select("fp").distinct().select("fp", F.col("fp").alias("node"), F.lit(0.0).alias("size")), "prints")
    return components(near_links(distinct, ["fp"], radius, **options)).select(F.col("node").alias("fp"), "root")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 3, words: int = 3, **options) -> DataFrame:
    """One row per row of `df`: its id, `fingerprint` (signed long) and `component_id`, the
    smallest id reachable through fingerprints within `radius` bits, its own included.

    Rows without words have fingerprint zero and link like any other. Null ids take part but
    name no component: it is null only where no reachable row has an id. Repeated rows stay.
    """
    prints = through_table(with_fingerprint(df.select(F.col(id), F.col(text).alias("__text")), "__text", "fp", words).select(id, "fp"), "fingerprints")
    roots = through_table(fingerprint_roots(prints, radius, **options), "roots")
    by_print = prints.groupBy("fp").agg(F.min(id).alias("low"))
    linked = by_print.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("low").alias("least"))
    known = by_print.join(roots.join(least, "root").select("fp", "least"), "fp", "left")
    known = known.select("fp", F.coalesce("least", "low").alias("component_id"))
    return prints.join(known, "fp").select(F.col(id), F.col("fp").alias("fingerprint"), "component_id")


def without_near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, ratio: float = 0.8, radius: int = 3, print_words: int = 3, **options) -> DataFrame:
    """The rows of `df` without near copies: of each component of texts whose sets of `words`-word
    shingles share `ratio` of their union, that of the smallest id stays.

    The components of fingerprints within `radius` bits, found as in `near_duplicates`, are held
    against the sets themselves. Fingerprints alone miss a share of the texts at that ratio, so
    `similar` proposes by MinHash bands besides, and by prefixes of the sets what both leave out; what
    any of them proposes links only if it is confirmed.
    `options` are those of `near_links`.
    """

    def grouped(marks: DataFrame) -> DataFrame:
        roots = through_table(fingerprint_roots(marks.select(F.col("mark").alias("fp")), radius, **options), "print-roots")
        met = marks.join(roots.withColumnRenamed("fp", "mark"), "mark", "left")
        return met.select("node", "n", F.coalesce("root", "mark").alias("key")).distinct()

    mark = lambda rows: with_fingerprint(rows, text, "__mark", print_words)
    return similar.without_near_duplicates(df, id, text, words, ratio, mark, grouped)
