"""Hard negatives by Four-Russians scoring.

Vectors become whole numbers, floor(scale * x). A candidate is kept as bit planes: its
components in two's complement, eight dimensions of one bit to a byte. An anchor is kept as
tables: for each group of eight dimensions the sums of all 256 subsets of its components. Then
a plane's share of the inner product is one table lookup per byte, and planes are added by
doubling, the highest with a minus:

    score = sum over bits b of (+-) 2^b * sum over groups g of table_g[byte_bg]

Every score is exact and every anchor is scored with every candidate, in cells of a bounded
block of anchors and a bounded block of candidates. The first pass scores rows of the anchor's
own label and keeps its best ones, the positives; the second scores the other rows and keeps,
for each anchor and positive, the best inside the positive's window. A cell sends on at most k
rows per anchor (and positive), of which most are dropped again before the shuffle.

Defined results: rows with a null id or label, a null vector or a null or non-finite component
take no part; rows that share an id count once, as the least (label, vector) of them; a vector
shorter than another counts as continued by zeros; numbers of any size are scored exactly, and
a score beyond 64 bits raises. Anchors without a positive give no rows, empty tables neither.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scarpline.session import through_table

PACKED = "c int, ids array<bigint>, labels array<bigint>, bits int, planes binary"
ANCHORS, TILE = 256, 256


# ---------------------------------------------------------------- numbers, planes, tables


def whole(vectors: list[list[float]], scale: int) -> np.ndarray:
    """floor(scale * x), padded with zeros to groups of eight; Python numbers where 32 bits end."""
    dims = -(-max((len(v) for v in vectors), default=0) // 8) * 8
    out = np.zeros((len(vectors), dims))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    if not out.size or np.abs(out).max() * scale < 1 << 31:
        return np.floor(out * scale).astype(np.int64)
    exact = lambda x: math.floor(scale * x) if abs(x) < 1 << 40 else scale * int(x)
    return np.array([[exact(x) for x in row] for row in out.tolist()], object).reshape(out.shape)


def bit_planes(numbers: np.ndarray) -> tuple[int, np.ndarray]:
    """(bits b, bytes [row, bit, group]) of whole numbers in two's complement of b bits."""
    low, high = (int(numbers.min()), int(numbers.max())) if numbers.size else (0, 0)
    bits = 1 + max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0)
    planes = [np.packbits(((numbers >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(bits)]
    return bits, np.stack(planes, axis=1)


def subset_tables(anchors: np.ndarray, kind) -> list[np.ndarray]:
    """Per group of eight dimensions, [subset, anchor]: the sum of the anchor's components in it."""
    tables = []
    for g in range(0, anchors.shape[1], 8):
        table = np.zeros((256, len(anchors)), kind)
        for k in range(8):
            table[1 << k : 2 << k] = table[: 1 << k] + anchors[:, g + k].astype(kind)
        tables.append(table)
    return tables


def kind_for(anchors: np.ndarray, bits: int):
    """The narrowest type that holds every partial sum of a score."""
    bound = int(np.abs(anchors).sum(axis=1).max() if anchors.size else 0) << bits
    return np.int32 if bound < 1 << 31 else np.int64 if bound * 100 < 1 << 63 else object


def scores(tables: list[np.ndarray], planes: np.ndarray) -> np.ndarray:
    """[candidate, anchor] inner products by table lookups."""
    n, bits, groups = planes.shape
    m, kind = (tables[0].shape[1], tables[0].dtype) if tables else (0, np.int64)
    out = np.zeros((n, m), kind)
    part = np.empty((min(n, TILE), m), kind)
    for i in range(0, n, TILE):
        total, tile = out[i : i + TILE], planes[i : i + TILE]
        some = part[: len(tile)]
        for b in reversed(range(bits)):
            total += total
            for table, byte in zip(tables, tile[:, b].T, strict=False):  # absent groups are zeros
                np.take(table, byte, axis=0, out=some, mode="clip")
                if b == bits - 1:
                    total -= some
                else:
                    total += some
    return out


# ---------------------------------------------------------------- cells


def _found(**columns: list) -> pa.Table:
    return pa.table({name: pa.array(values, pa.int64()) for name, values in columns.items()})


def unpack(packed: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, planes) of the candidates of a block; ids ascend."""
    row = packed.to_pylist()[0]
    ids, labels = np.array(row["ids"], np.int64), np.array(row["labels"], np.int64)
    return ids, labels, np.frombuffer(row["planes"], np.uint8).reshape(len(ids), row["bits"], -1)


def best_of_own_label(packed: pa.Table, anchors: pa.Table, scale: int, k: int) -> pa.Table:
    """Per anchor its k best rows of a block with its own label: anchor_id, vec_id, score."""
    out: dict[str, list] = {"anchor_id": [], "vec_id": [], "score": []}
    if packed.num_rows and anchors.num_rows:
        ids, labels, planes = unpack(packed)
        own, numbers = anchors["label"].to_numpy(), whole(anchors["v"].to_pylist(), scale)
        aid = anchors["id"].to_numpy()
        for label in np.intersect1d(own, labels):
            among, members = np.flatnonzero(labels == label), np.flatnonzero(own == label)
            for i in range(0, len(members), ANCHORS):
                part = members[i : i + ANCHORS]
                got = scores(subset_tables(numbers[part], kind_for(numbers[part], planes.shape[1])), planes[among])
                for j, at in enumerate(part):
                    s, rows = got[:, j] if got.size else np.zeros(len(among), np.int64), among
                    keep = ids[rows] != aid[at]
                    s, rows = s[keep], rows[keep]
                    if len(s) > k:
                        top = s >= np.partition(s, len(s) - k)[len(s) - k]
                        s, rows = s[top], rows[top]
                    order = np.argsort(-s, kind="stable")[:k]  # rows ascend by id
                    out["anchor_id"] += [aid[at]] * len(order)
                    out["vec_id"] += ids[rows[order]].tolist()
                    out["score"] += s[order].tolist()
    return _found(**out)


def best_in_windows(packed: pa.Table, anchors: pa.Table, scale: int, k: int, low: int, high: int) -> pa.Table:
    """Per anchor and positive the k best rows of a block with another label whose score, times
    100, lies between low and high times the positive's."""
    out: dict[str, list] = {"anchor_id": [], "positive_id": [], "negative_id": [], "positive_score": [], "negative_score": []}
    if packed.num_rows and anchors.num_rows:
        ids, labels, planes = unpack(packed)
        own, numbers = anchors["label"].to_numpy(), whole(anchors["v"].to_pylist(), scale)
        aid, positives = anchors["id"].to_numpy(), anchors["positives"].to_pylist()
        for i in range(0, len(aid), ANCHORS):
            part = slice(i, i + ANCHORS)
            tables = subset_tables(numbers[part], kind_for(numbers[part], planes.shape[1]))
            windows = [[(min(low * p["score"], high * p["score"]), p["score"] * high) for p in own_p] for own_p in positives[part]]
            for r in range(0, len(ids), 4 * TILE):
                tile = slice(r, r + 4 * TILE)
                got = scores(tables, planes[tile])
                if not got.size:
                    got = np.zeros((len(ids[tile]), len(aid[part])), np.int64)
                got = got.astype(np.int64) * 100 if got.dtype != object else got * 100
                least = np.array([min(w)[0] for w in windows], got.dtype)
                most = np.array([max(w[1] for w in ws) for ws in windows], got.dtype)
                mask = (got >= least) & (got <= most) & (labels[tile][:, None] != own[part])
                column, row = np.nonzero(mask.T)
                s = got[row, column]
                edges = np.searchsorted(column, np.arange(len(windows) + 1))
                for j in np.flatnonzero(np.diff(edges)):
                    a, b = edges[j], edges[j + 1]
                    order = a + np.argsort(-s[a:b], kind="stable")
                    falling = -s[order]
                    for p in positives[i + j]:
                        first = np.searchsorted(falling, -high * p["score"], side="left")
                        chosen = order[first : first + k]
                        chosen = chosen[s[chosen] >= low * p["score"]]
                        out["anchor_id"] += [aid[i + j]] * len(chosen)
                        out["positive_id"] += [p["id"]] * len(chosen)
                        out["negative_id"] += ids[r + row[chosen]].tolist()
                        out["positive_score"] += [p["score"]] * len(chosen)
                        out["negative_score"] += [int(x) // 100 for x in s[chosen]]
    return _found(**out)


# ---------------------------------------------------------------- the operator


def usable(v: Column) -> Column:
    flaw = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~flaw, F.lit(False))


def _top(found: DataFrame, keys: list[str], id: str, score: str, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc(score), id)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    df: DataFrame, is_anchor: Column, *, id: str = "vec_id", label: str | Column = "label", vector: str = "embedding",
    positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    block: int = 4096, anchors: int = 1024,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    An anchor's positives are its best other rows of its label; the negatives of a positive are
    the best rows of other labels with low% to high% of its score. Ties go to smaller ids.
    `block` and `anchors` bound the candidates and the anchors of a cell.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(F.col(id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).cast("array<double>").alias("v"), is_anchor.alias("is_anchor"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v", "is_anchor")).alias("r")).select("id", "r.*")
    rows = through_table(rows, "vectors")
    n, m = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    wide, tall = max(1, -(-n // block)), max(1, -(-m // anchors))
    share = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        bits, planes = bit_planes(whole(group["v"].to_pylist(), scale))
        lists = [pa.array([group[name].to_pylist()], pa.list_(pa.int64())) for name in ("id", "label")]
        return pa.table([pa.array([group["c"][0].as_py()], pa.int32()), *lists, pa.array([bits], pa.int32()), pa.array([planes.tobytes()], pa.binary())], ["c", "ids", "labels", "bits", "planes"])

    packed = through_table(rows.select("id", "label", "v", share(wide).alias("c")).groupBy("c").applyInArrow(pack, PACKED), "planes")
    asked = rows.where("is_anchor").select("id", "label", "v")

    def cells(queries: DataFrame, cell, schema: str) -> DataFrame:
        """Each block of candidates beside each block of anchors."""
        left = packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(tall - 1))).alias("a")).groupBy("a", "c")
        right = queries.withColumn("a", share(tall)).select("*", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("c")).groupBy("a", "c")
        return left.cogroup(right).applyInArrow(cell, schema)

    own = cells(asked, lambda c, a: best_of_own_label(c, a, scale, positives), "anchor_id bigint, vec_id bigint, score bigint")
    own = _top(own, ["anchor_id"], "vec_id", "score", positives)
    own = own.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct(F.col("vec_id").alias("id"), "score")).alias("positives"))
    asked = through_table(asked.join(own, "id"), "anchors")  # `positives` at most each

    names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
    other = cells(asked, lambda c, a: best_in_windows(c, a, scale, negatives, low, high), ", ".join(f"{x} bigint" for x in names))
    other = _top(other, ["anchor_id", "positive_id"], "negative_id", "negative_score", negatives)
    return other.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
