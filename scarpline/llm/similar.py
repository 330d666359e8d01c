"""Near-duplicate texts by the exact Jaccard similarity of their shingles.

Texts link when the distinct shingles of both (`words` neighbouring words, lower case) share
`ratio` of their union at least; a component is what links reach. Nothing else decides:

* Texts of equal shingle sets are one node, so exact copies and repeated passages cost nothing.
* Groups given from outside (SimHash components, see `simhash`) and MinHash bands only propose
  pairs. A group is compared like the bucket of one more band. Each of `BANDS` bands hashes the minima of `ROWS` orders.
  Texts that share 0.8 of their shingles meet in none with a chance of (1 - 0.8 ** 5) ** 40 =
  1.2e-7, texts that share more with less. Buckets of one node go at once.
* What these leave out is found by prefixes, without chance. In one order of all shingles, sets
  that share `ratio` of their union share a shingle among the first n - ceil(ratio * n) + 1 of
  each. Common shingles come last in that order, so that prefixes seldom meet; which are common
  is told by a draw of texts, and since any order finds all links the draw decides nothing.
* Every proposed pair is held against the sets themselves before it links.
* Neighbours in a seeded order of each bucket are tried first, in a few bands. Then all pairs of
  each bucket that is not yet connected are compared in blocks; a block emits a spanning star
  of each group. Prefixes list pairs of unconnected texts, at most `HOT` times the rows of a
  bucket or cell, and compare in blocks where there are more.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline.session import through_table

from .components import components

SEED = 42
BANDS, ROWS = 40, 5
GROUPED = -1  # the band of groups that are no MinHash band
DRAWN, COMMON = 8192, 1 << 17  # texts in which common shingles are counted, and the most of these to be told apart
HOT = 64  # rows up to which a bucket lists its pairs
FLUSH, PART = 1 << 18, 1 << 18  # entries of prefixes packed at once, and those a task is meant to hold
FILTER = 1 << 24  # bits in which nodes are looked up before a join
_LOW = np.uint64((1 << 48) - 1)
_MASKS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text; a text of fewer words than a shingle
    has one shingle of what there is, a text without words none."""
    import xxhash

    parts = (text or b"").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    ends, n = [], -1
    for w in parts:
        n += len(w) + 1
        ends.append(n)
    line, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    starts = [0, *(e + 1 for e in ends[:-words])]
    found = {hashed(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :] or ends[-1:])}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def bands(held: np.ndarray) -> np.ndarray:
    """One signed key per band of a set of shingles."""
    least = np.full(len(_MASKS), np.iinfo(np.uint64).max)
    for i in range(0, len(held), 512):
        mixed = (held[i : i + 512, None] ^ _MASKS) * _ODD
        mixed ^= mixed >> np.uint64(29)
        mixed *= _ODD
        least = np.minimum(least, mixed.min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _ODD
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


class Groups:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            hi, lo = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
            np.minimum.at(self.root, hi, lo)
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _with_sketch(df: DataFrame, text: str, words: int) -> DataFrame:
    """Add `__s`: the number of shingles, a digest of their set in two longs, and the bands."""

    @F.arrow_udf("struct<n:int, d1:bigint, d2:bigint, bands:array<bigint>>")
    def sketch(texts: pa.Array) -> pa.Array:
        import xxhash

        sizes, digests, keys = [], [], []
        for x in texts.cast(pa.binary()):
            held = shingles(x.as_py(), words)
            sizes.append(len(held))
            digests.append(np.frombuffer(xxhash.xxh3_128_digest(held.tobytes(), SEED), np.int64))
            keys.append(bands(held))
        flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        both = np.stack(digests) if digests else np.zeros((0, 2), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * BANDS, pa.int32()), pa.array(flat))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), lists], ["n", "d1", "d2", "bands"])

    return df.withColumn("__s", sketch(F.col(text).cast("string")))


def _with_set(df: DataFrame, text: str, words: int) -> DataFrame:
    @F.arrow_udf("array<bigint>")
    def held(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(x.as_py(), words).view(np.int64) for x in texts.cast(pa.binary())], pa.list_(pa.int64()))

    return df.withColumn("held", held(F.col(text).cast("string")))


def _slot() -> Column:
    """Where `_lookup` looks for a node."""
    return F.pmod(F.xxhash64("node"), F.lit(FILTER))


def _lookup(nodes: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Whether the node of a slot may be one of `nodes`: true of all that are, and of some that only
    share a bit of `FILTER` with one. It keeps texts that nobody asks for out of tasks and shuffles."""
    place = nodes.select((_slot() + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    held = np.zeros((FILTER // (1 << 15), 1 << 12), np.uint8)
    for r in place.collect():
        held[r.k - 1] = np.frombuffer(r.bits, np.uint8)
    shared = nodes.sparkSession.sparkContext.broadcast(held.ravel())
    return lambda at: (shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _sets(texts: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """The sets of distinct `nodes`, written once."""
    asked = _lookup(nodes)

    @F.arrow_udf("boolean")
    def may(at: pa.Array) -> pa.Array:
        return pa.array(asked(at.to_numpy(zero_copy_only=False)))

    wanted = texts.where(may(_slot())).join(nodes, "node", "left_semi")
    return through_table(_with_set(wanted, "text", words).select("node", "held"), "sets")


def _neighbours(buckets: DataFrame, round: int) -> DataFrame:
    """Pairs that stand side by side in a seeded order of each bucket. The order is global and cut
    anywhere, also inside a bucket, so no bucket has to fit a task; pairs at cuts are left to the cells."""

    def link(batches):
        key = node = n = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "node", "n"))
            if key is not None:
                keys, nodes, sizes = (np.concatenate([[x], y]) for x, y in ((key, keys), (node, nodes), (n, sizes)))
            key, node, n = keys[-1], nodes[-1], sizes[-1]
            at = np.flatnonzero(keys[1:] == keys[:-1])
            yield pa.record_batch([pa.array(x.astype(np.int64)) for x in (nodes[at], nodes[at + 1], sizes[at], sizes[at + 1])], ["u", "v", "nu", "nv"])

    ordered = buckets.select("key", F.xxhash64("node", F.lit(round)).alias("h"), "node", "n")
    return ordered.repartitionByRange("key", "h").sortWithinPartitions("key", "h").mapInArrow(link, "u bigint, v bigint, nu bigint, nv bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, ratio: float) -> DataFrame:
    """Of pairs (u, v, nu, nv) those whose sets share `ratio` of their union."""
    close = pairs.where(F.least("nu", "nv") + 1e-9 >= ratio * F.greatest("nu", "nv"))
    close = close.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    one, two = (sets.select(F.col("node").alias(c), F.col("held").alias(f"of_{c}")) for c in "uv")
    met = close.join(one, "u").join(two, "v").withColumn("both", F.size(F.array_intersect("of_u", "of_v")))
    return met.where(F.col("both") + 1e-9 >= ratio * (F.size("of_u") + F.size("of_v") - F.col("both"))).select("u", "v")


def _open(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Rows of the buckets whose nodes are not all connected yet, with the number of `rows` of each."""
    if roots is None:
        rooted = buckets.withColumn("root", F.col("node"))
    else:
        rooted = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows")).where("lo != hi").select("key", "rows")
    return rooted.join(keys, "key").select("key", "band", "node", "n", "rows")


def overlaps(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many values each set of `one` shares with each of `two`."""
    seen, at = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    first, second = at[: sum(map(len, one))], at[sum(map(len, one)) :]
    row = [np.repeat(np.arange(len(x)), [len(h) for h in x]) for x in (one, two)]
    both = np.flatnonzero((np.bincount(first, minlength=len(seen)) > 0) & (np.bincount(second, minlength=len(seen)) > 0))
    to = np.full(len(seen), -1)
    to[both] = np.arange(len(both))
    found = np.zeros((len(one), len(two)), np.float32)
    for low in range(0, len(both), 4096):
        parts = []
        for values, rows, n in ((first, row[0], len(one)), (second, row[1], len(two))):
            k = to[values] - low
            inside = (k >= 0) & (k < 4096) & (to[values] >= 0)
            part = np.zeros((n, min(4096, len(both) - low)), np.float32)
            part[rows[inside], k[inside]] = 1
            parts.append(part)
        found += parts[0] @ parts[1].T
    return found


def _blocks(buckets: DataFrame, block: int, *columns: str) -> DataFrame:
    """Buckets (key, node, `columns`, rows) dealt out as pairs (i, j) of blocks; side 0 is of block i."""
    blocks = F.ceil(F.col("rows") / block).cast("int")
    dealt = buckets.select("key", "node", *columns, blocks.alias("blocks")).withColumn("b", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.select("key", "node", *columns, "b", F.explode(F.expr("sequence(0, blocks - 1)")).alias("o"))
    return dealt.select("key", "node", *columns, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side"))


def _cells(buckets: DataFrame, sets: DataFrame, ratio: float, block: int) -> DataFrame:
    """Links that connect what all confirmed pairs of each bucket connect. A bucket is dealt out as
    pairs of blocks; a cell compares its sets all at once and emits a spanning star per group."""

    def links(table: pa.Table) -> pa.Table:
        side, node = table["side"].to_numpy(), table["node"].to_numpy()
        flat = table["held"].combine_chunks()
        held = [flat[k].values.to_numpy() for k in range(len(node))]
        first = np.flatnonzero(side == 0)
        second = np.flatnonzero(side == 1) if table["i"][0].as_py() != table["j"][0].as_py() else first
        groups, sizes = Groups(len(node)), np.array([len(h) for h in held])
        if len(first) and len(second):
            both = overlaps([held[k] for k in first], [held[k] for k in second])
            x, y = np.nonzero(both + 1e-9 >= ratio * (sizes[first][:, None] + sizes[second][None, :] - both.astype(float)))
            groups.link(first[x], second[y])
        rows = np.flatnonzero(groups.root != np.arange(len(node)))
        return pa.table({"u": node[rows], "v": node[groups.root[rows]]})

    return _blocks(buckets, block).join(sets, "node").groupBy("key", "i", "j").applyInArrow(links, "u bigint, v bigint")


def _asked(batches, asked: Callable):
    """(node, text) of the rows (node, at, text) whose slot `asked` knows."""
    for batch in batches:
        rows = np.flatnonzero(asked(batch.column("at").to_numpy(zero_copy_only=False)))
        nodes, texts = batch.column("node"), batch.column("text")
        for k in rows.tolist():
            yield nodes[k].as_py(), texts[k].cast(pa.binary()).as_py()


def _common(texts: DataFrame, n: int, words: int, asked: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The shingles found in several of at most about `DRAWN` texts, sorted, and in how many."""

    def each(batches):
        for at, text in _asked(batches, asked):
            yield pa.record_batch([pa.array(shingles(text, words).view(np.int64))], ["key"])

    drawn = texts.where(F.pmod(F.xxhash64("node", F.lit(2)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, DRAWN / max(1, n))))
    counted = drawn.mapInArrow(each, "key bigint").groupBy("key").count().where("count > 1")
    table = counted.orderBy(F.desc("count"), "key").limit(COMMON).toArrow()
    keys = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table["count"].to_numpy()[order]


def prefix(held: np.ndarray, ratio: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of a sorted set those that come first when common shingles come last: so many that a set
    which shares `ratio` of the union with it has one of them among its own."""
    first = len(held) - int(np.ceil(ratio * len(held) - 1e-6)) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, held), len(common) - 1)
        held = held[np.argsort(np.where(common[at] == held, counts[at], 0), kind="stable")]
    return held[:first]


def _packed(keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> bytes:
    low = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6]
    return pa.Codec("zstd").compress(low.tobytes() + np.diff(nodes, prepend=0).tobytes() + sizes.astype(np.int32).tobytes(), asbytes=True)


def _unpacked(body: bytes, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.Codec("zstd").decompress(body, rows * 18, asbytes=True)
    low = np.zeros((rows, 8), np.uint8)
    low[:, :6] = np.frombuffer(raw, np.uint8, rows * 6).reshape(-1, 6)
    return low.view(np.uint64).ravel(), np.cumsum(np.frombuffer(raw, np.int64, rows, rows * 6)), np.frombuffer(raw, np.int32, rows, rows * 14)


def _prefixed(texts: DataFrame, ratio: float, words: int, parts: int, common: tuple[np.ndarray, np.ndarray], asked: Callable) -> DataFrame:
    """(key, node, n) for shingles that stand in prefixes of several texts whose sizes `ratio`
    allows. Keys are the lower 48 bits of shingles: equal ones propose, the sets decide.

    Entries are dealt into `parts` by key, packed, since most keys are found once and go there. A key
    that fills `HOT` entries of a batch sends one of them there, marked by a negative size, and all go
    straight on, dealt by node: no part holds all entries of a hot key."""
    shared, hot, full = texts.sparkSession.sparkContext.broadcast(common), HOT, FLUSH

    def flushed(keys, nodes, sizes):
        order = np.argsort(keys, kind="stable")
        keys, nodes, sizes = keys[order], nodes[order], sizes[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        runs = np.diff(np.append(starts, len(keys)))
        many, first = np.repeat(runs >= hot, runs), np.zeros(len(keys), bool)
        first[starts] = True
        to = np.concatenate([(keys % np.uint64(parts)).astype(np.int64)[~many | first], parts + nodes[many] % parts])
        keys, nodes, sizes = (np.concatenate([x[~many | first], y[many]]) for x, y in ((keys, keys), (nodes, nodes), (np.where(many, -sizes, sizes), sizes)))
        order = np.lexsort((nodes, to))
        cuts = np.flatnonzero(np.diff(to[order])) + 1
        at = np.split(order, cuts)
        yield pa.record_batch(
            [pa.array([to[x[0]] for x in at], pa.int64()), pa.array([len(x) for x in at], pa.int64()), pa.array([_packed(keys[x], nodes[x], sizes[x]) for x in at], pa.binary())],
            ["part", "rows", "body"],
        )

    def deal(batches):
        found, nodes, sizes, many, held = [], [], [], [], 0

        def entries():
            each = [np.repeat(np.array(x, np.int64), many) for x in (nodes, sizes)]
            return np.concatenate(found) & _LOW, *each

        for node, text in _asked(batches, asked):
            kept = shingles(text, words)
            if not len(kept):
                continue
            found.append(prefix(kept, ratio, *shared.value))
            nodes.append(node)
            sizes.append(len(kept))
            many.append(len(found[-1]))
            held += many[-1]
            if held >= full:
                yield from flushed(*entries())
                found, nodes, sizes, many, held = [], [], [], [], 0
        if held:
            yield from flushed(*entries())

    def meet(table: pa.Table) -> pa.Table:
        bodies = [_unpacked(b.as_py(), r.as_py()) for b, r in zip(table["body"], table["rows"])]
        keys, nodes, sizes = (np.concatenate(x) for x in zip(*bodies))
        if table["part"][0].as_py() < parts:
            order = np.lexsort((np.abs(sizes), keys))
            keys, nodes, sizes = keys[order], nodes[order], sizes[order]
            same, size = keys[1:] == keys[:-1], np.abs(sizes)
            near = same & (size[:-1] + 1e-6 >= ratio * size[1:])
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            known = np.logical_or.reduceat(sizes < 0, starts)
            kept = np.repeat(known, np.diff(np.append(starts, len(keys))))
            kept[1:] |= near
            kept[:-1] |= near
            kept &= sizes > 0
            keys, nodes, sizes = keys[kept], nodes[kept], sizes[kept]
        return pa.table({"key": keys.view(np.int64), "node": nodes, "n": sizes.astype(np.int32)})

    dealt = texts.mapInArrow(deal, "part bigint, rows bigint, body binary")
    return dealt.groupBy("part").applyInArrow(meet, "key bigint, node bigint, n int")


def _crowded(buckets: DataFrame, ratio: float, block: int) -> DataFrame:
    """Pairs (u, v, nu, nv) of different roots in buckets of many rows, which meet as blocks. A cell
    in which more than `HOT` pairs a row could link gives its nodes instead, with a null v."""
    hot = HOT

    def pairs(table: pa.Table) -> pa.Table:
        side, node, n, root = (table[c].to_numpy() for c in ("side", "node", "n", "root"))
        inner = table["i"][0].as_py() == table["j"][0].as_py()
        first = np.flatnonzero(side == 0)
        second = first if inner else np.flatnonzero(side == 1)
        a, b = n[first][:, None], n[second][None, :]
        close = (root[first][:, None] != root[second][None, :]) & (np.minimum(a, b) + 1e-9 >= ratio * np.maximum(a, b))
        if inner:
            close &= node[first][:, None] < node[second][None, :]
        if close.sum() > hot * len(node):
            met = np.union1d(first[close.any(axis=1)], second[close.any(axis=0)])
            u, v = met, None
        else:
            x, y = np.nonzero(close)
            x, y = first[x], second[y]
            u, v = np.where(node[x] < node[y], x, y), np.where(node[x] < node[y], y, x)
        none = pa.nulls(len(u), pa.int64()) if v is None else None
        other = (none, none.cast(pa.int32())) if v is None else (pa.array(node[v]), pa.array(n[v]))
        cell = [pa.array([table[c][0].as_py()] * len(u), t) for c, t in (("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()))]
        return pa.table([pa.array(node[u]), other[0], pa.array(n[u]), other[1], *cell], ["u", "v", "nu", "nv", "key", "i", "j"])

    return _blocks(buckets, block, "n", "root").groupBy("key", "i", "j").applyInArrow(pairs, "u bigint, v bigint, nu int, nv int, key bigint, i int, j int")


def _left_out(texts: DataFrame, rooted: DataFrame, ratio: float, words: int, block: int) -> DataFrame:
    """Links (u, v) that connect what all confirmed pairs of texts of different roots connect.
    `rooted` has node, n and root of all nodes."""
    asked, placed = _lookup(rooted), texts.select("node", _slot().alias("at"), F.col("text").cast("string").alias("text"))
    n, entries = rooted.agg(F.count("*"), F.sum(F.col("n") - F.ceil(ratio * F.col("n") - 1e-6) + 1)).first()
    common = _common(placed, n, words, asked)
    met = through_table(_prefixed(placed, ratio, words, -(-(entries or 1) // PART), common, asked), "prefixes")
    met = met.join(rooted.select("node", "root"), "node")
    keys = met.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows")).where("lo != hi").select("key", "rows")
    met = through_table(met.join(keys, "key").select("key", "node", "n", "root", "rows"), "open")

    few, many = met.where(F.col("rows") <= HOT), met.where(F.col("rows") > HOT)
    one, two = (few.select("key", F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("root").alias(f"r{c}")) for c in "uv")
    listed = one.join(two, "key").where((F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")))
    listed = listed.where(F.least("nu", "nv") + 1e-9 >= ratio * F.greatest("nu", "nv")).select("u", "v", "nu", "nv")
    crowded = through_table(_crowded(many, ratio, 4 * block), "crowded")
    listed = listed.unionByName(crowded.where("v is not null").select("u", "v", "nu", "nv"))
    # Of what both share all but the shingles behind the prefix that ends first is listed here, or
    # compared in blocks: a pair listed too seldom to reach the ratio cannot link.
    least = F.ceil(ratio / (1 + ratio) * (F.col("nu") + F.col("nv")) - 1e-6)
    beyond = F.ceil(ratio * F.greatest("nu", "nv") - 1e-6) - 1
    pairs = through_table(listed.groupBy("u", "v", "nu", "nv").count().where(F.col("count") + beyond >= least).drop("count"), "pairs")
    dense = crowded.where("v is null").select(F.xxhash64("key", "i", "j").alias("key"), F.col("u").alias("node"))
    dense = through_table(dense.join(dense.groupBy("key").agg(F.count("*").alias("rows")), "key"), "dense")
    nodes = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).unionByName(dense.select("node")).distinct()
    sets = _sets(texts, nodes, words)
    return _confirmed(pairs, sets, ratio).unionByName(_cells(dense, sets, ratio, block))


def similar_roots(points: DataFrame, texts: DataFrame, ratio: float, words: int, block: int = 512, groups: DataFrame | None = None) -> DataFrame:
    """Points (node, n, bands) and the texts of all nodes (node, text) -> (node, root) for those
    that link to another. No cell holds more than about two blocks. `groups` (node, n, key) are
    compared beside the bands, and first; prefixes find what both leave out."""
    buckets = points.select("node", "n", F.posexplode("bands").alias("band", "key"))
    if groups is not None:
        buckets = buckets.unionByName(groups.select("node", "n", F.lit(GROUPED).alias("band"), "key"))
    buckets = through_table(_open(buckets, None).drop("rows"), "buckets")
    sets = _sets(texts, buckets.select("node").distinct(), words)
    edges = through_table(_confirmed(_neighbours(buckets.where(F.col("band") < 8), 0), sets, ratio), "links")
    left = through_table(_open(buckets, through_table(components(edges), "roots")), "open")
    roots = components(edges.unionByName(_cells(left, sets, ratio, block)))
    rooted = points.select("node", "n").join(roots, "node", "left")
    rooted = through_table(rooted.select("node", "n", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked")), "rooted")
    more = _left_out(texts, rooted.drop("linked"), ratio, words, block)
    for end in "uv":
        more = more.join(rooted.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end)
    tops = components(more.select(F.col("ru").alias("u"), F.col("rv").alias("v"))).withColumnsRenamed({"root": "top", "node": "root"})
    return rooted.join(tops, "root", "left").where("linked OR top IS NOT NULL").select("node", F.coalesce("top", "root").alias("root"))


def without_near_duplicates(
    df: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, ratio: float = 0.8,
    mark: Callable[[DataFrame], DataFrame] | None = None, grouped: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The rows of `df` of which each component keeps one: that of the smallest id, of equal ids or
    of none the first. Rows are written once with their bands, so that each has a place.

    Texts without words are all alike and link to no others. `mark` adds a column `__mark` to the
    rows, and `grouped` turns (node, n, mark) into the groups (node, n, key) to be compared too.
    """
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    table = through_table(_with_sketch(rows if mark is None else mark(rows), text, words), "rows")
    at = F.struct(F.col(id).isNull().alias("none"), F.col(id).alias("id"), F.col("__row").alias("row"), F.col("__s.bands").alias("bands"))
    points = table.groupBy("__s.n", "__s.d1", "__s.d2").agg(F.min(at).alias("at"))
    points = through_table(points.select(F.col("at.row").alias("node"), "n", "d1", "d2", F.struct("at.none", "at.id", "at.row").alias("at"), F.col("at.bands").alias("bands")), "points")
    groups = None
    if grouped is not None:
        # Texts of one set of shingles may differ in what repeats, and so in their marks: all count.
        marks = table.where("__s.n > 0").select("__s.n", "__s.d1", "__s.d2", F.col("__mark").alias("mark")).distinct()
        groups = grouped(through_table(marks.join(points.select("node", "n", "d1", "d2"), ["n", "d1", "d2"]).select("node", "n", "mark"), "marks"))
    texts = table.select(F.col("__row").alias("node"), F.col(text).alias("text"))
    roots = through_table(similar_roots(points.where("n > 0"), texts, ratio, words, groups=groups), "roots")
    first = points.select("node", "at").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("at").alias("at"))
    return table.join(first.select(F.col("at.row").alias("__row")), "__row", "left_semi").select(*df.columns)
