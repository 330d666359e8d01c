"""Fitted models as tables, and the models of many areas applied in one pass.

A tree ensemble is one row per node:

    key, tree, weight, link, node, feature, cut, mask, left, right, value, samples

`feature` is null at a leaf. A row goes left where its feature is at most `cut`, or, for a
category, where the bit of its code in `mask` is set; otherwise, and for a missing number,
right. Every node has a `value`, the mean of what reached it; a row's margin is the weighted
sum of its leaves' values. `link` says how a margin becomes a probability: `logistic` (twice
the margin, as boosting on -1 / 1 labels has it) or `mean`. Node 0 is a tree's root.

A linear model is one row per term: key, feature (null for the intercept), weight.

Such tables are read from saved models, kept beside them, compared with SQL, and hold the
models of any number of areas under their keys. Rows are scored whatever their area: no filter,
fit object or union branch per area.

Frames are scored by a join: an area's trees are dealt into blocks, its distinct feature vectors
into chunks, every chunk meets every block in one task, and the blocks' margins are added up in
their order. So neither the nodes nor the rows of an area have to fit the driver or a task.
`probability` and `path_contributions` are columns for models known to be small: their nodes, at
most MOST_NODES, travel with the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import models
from ..session import through_table

NODE_COLUMNS = ["key", "tree", "weight", "link", "node", "feature", "cut", "mask", "left", "right", "value", "samples"]
#: Nodes that may travel with the tasks, a few hundred MB of arrays at most.
MOST_NODES = 4_000_000
#: Nodes of a block and feature vectors of a chunk, about; a tree stays in one block.
BLOCK_NODES, CHUNK_ROWS = 1 << 15, 1 << 16


# ---------------------------------------------------------------- models to tables


def save(model: PipelineModel, path: str) -> None:
    """A fitted model in the shared folder, from which `load` and the tables read it."""
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _stage(spark: SparkSession, path: str) -> tuple[str, str]:
    """(class, folder) of a saved pipeline's last stage; folders are numbered."""
    listed = spark.read.text(f"{path}/stages/*/metadata").select(
        F.col("_metadata.file_path").alias("file"), F.get_json_object("value", "$.class").alias("class")
    )
    # `value` does not hold the folder's name; its path does, with the stage's number in front.
    last = listed.withColumn("folder", F.regexp_extract("file", r"^(.*)/metadata/", 1)).withColumn(
        "n", F.regexp_extract("folder", r"/(\d+)_[^/]*$", 1).cast("int")
    ).orderBy(F.desc("n")).first()
    return last["class"].rsplit(".", 1)[-1], last["folder"]


def node_table(spark: SparkSession, saved: dict[str, str], features: list[str]) -> DataFrame:
    """The nodes of saved ensembles, key -> folder, all keys in one table.

    The boosted model's land cover is a category: its codes become a mask. Models are few
    and their folders are listed here; their nodes stay a table.
    """
    out = None
    for key, path in sorted(saved.items()):
        kind, folder = _stage(spark, path)
        if kind not in ("GBTClassificationModel", "RandomForestClassificationModel"):
            raise ValueError(f"{key}: {kind} is not a tree ensemble")
        boosted = kind == "GBTClassificationModel"
        trees = spark.read.parquet(f"{folder}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
        n = F.col("nodeData")
        leaf = n["leftChild"] < 0
        split = n["split"]
        stats = n["impurityStats"]
        share = F.get(stats, F.lit(1)) / F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
        category = split["numCategories"] >= 0
        codes = F.aggregate(
            split["leftCategoriesOrThreshold"], F.lit(0).cast("bigint"),
            lambda a, c: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), c.cast("int") + models.CATEGORY_BASE)),
        )
        names = F.array(*[F.lit(f) for f in features])
        nodes = spark.read.parquet(f"{folder}/data").select(
            F.lit(key).alias("key"), F.col("treeID").alias("tree"), F.lit("logistic" if boosted else "mean").alias("link"),
            n["id"].alias("node"),
            F.when(~leaf, F.get(names, split["featureIndex"])).alias("feature"),
            F.when(~leaf & ~category, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("cut"),
            F.when(~leaf & category, codes).alias("mask"),
            F.when(~leaf, n["leftChild"]).alias("left"), F.when(~leaf, n["rightChild"]).alias("right"),
            (n["prediction"] if boosted else share).alias("value"), n["rawCount"].alias("samples"),
        )
        table = nodes.join(trees, "tree").select(*NODE_COLUMNS)
        if not boosted:  # a forest's trees count alike
            table = table.withColumn("weight", F.lit(1.0) / trees.agg(F.count("*")).scalar())
        out = table if out is None else out.unionByName(table)
    if out is None:
        raise ValueError("no saved model")
    return out


def linear_table(spark: SparkSession, saved: dict[str, str], features: list[str]) -> DataFrame:
    """Coefficients and intercept of saved logistic models, key -> folder."""
    rows = []
    for key, path in sorted(saved.items()):
        kind, _ = _stage(spark, path)
        if kind != "LogisticRegressionModel":
            raise ValueError(f"{key}: {kind} is not linear")
        fitted = load(path).stages[-1]
        rows += [(key, f, float(w)) for f, w in zip(features, fitted.coefficients, strict=True)]
        rows.append((key, None, float(fitted.intercept)))
    return spark.createDataFrame(rows, "key string, feature string, weight double")


# ---------------------------------------------------------------- packed nodes


class Packed:
    """Node arrays of every key: children as places in the same arrays."""

    def __init__(self, nodes: pa.Table, features: list[str]):
        nodes = nodes.sort_by([("key", "ascending"), ("tree", "ascending"), ("node", "ascending")])
        index = {f: i for i, f in enumerate(features)}
        feature = nodes["feature"].to_pylist()
        unknown = {f for f in feature if f is not None} - set(index)
        if unknown:
            raise ValueError(f"the models ask for features that are not given: {sorted(unknown)}")
        self.feature = np.array([-1 if f is None else index[f] for f in feature], np.int32)
        number = lambda name, kind, missing: np.array([missing if v is None else v for v in nodes[name].to_pylist()], kind)
        self.cut, self.mask = number("cut", float, np.nan), number("mask", np.int64, -1)
        self.category = np.array([v is not None for v in nodes["mask"].to_pylist()], bool)
        self.value = number("value", float, np.nan) * number("weight", float, np.nan)
        key, tree, node = nodes["key"].to_pylist(), nodes["tree"].to_pylist(), nodes["node"].to_pylist()
        at = {k: i for i, k in enumerate(zip(key, tree, node, strict=True))}
        if len(at) < len(key):
            raise ValueError("a node is given twice")
        child = lambda name: np.array([0 if c is None else at[k, t, c] for k, t, c in zip(key, tree, nodes[name].to_pylist(), strict=True)], np.int64)
        self.left, self.right = child("left"), child("right")
        self.roots: dict[str, list[int]] = {}
        self.link: dict[str, str] = {}
        for i, (k, n, link) in enumerate(zip(key, node, nodes["link"].to_pylist(), strict=True)):
            if n == 0:
                self.roots.setdefault(k, []).append(i)
                self.link[k] = link

    def walk(self, key: str, x: np.ndarray, contributions: bool = False) -> tuple[np.ndarray, np.ndarray | None, float]:
        """(margins, contributions [row, feature], margin before any split) of the rows of one area."""
        roots = np.array(self.roots[key])
        start = float(self.value[roots].sum())
        margin = np.empty(len(x))
        shares = np.zeros_like(x) if contributions else None
        step = max(1, (1 << 20) // len(roots))
        for i in range(0, len(x), step):
            rows = x[i : i + step]
            at = np.tile(roots, (len(rows), 1))
            line = np.arange(len(rows))[:, None]
            while True:
                feature = self.feature[at]
                inner = feature >= 0
                if not inner.any():
                    break
                seen = rows[line, feature]
                with np.errstate(invalid="ignore"):
                    code = np.where(np.isfinite(seen), seen, -1).astype(np.int64)
                    known = (code >= 0) & (code < 63)
                    member = known & ((self.mask[at] >> np.where(known, code, 0)) & 1 == 1)
                    left = np.where(self.category[at], member, seen <= self.cut[at])
                after = np.where(inner, np.where(left, self.left[at], self.right[at]), at)
                if shares is not None:
                    moved = self.value[after] - self.value[at]
                    where = np.broadcast_to(line, at.shape)[inner]
                    np.add.at(shares, (i + where, feature[inner]), moved[inner])
                at = after
            margin[i : i + step] = self.value[at].sum(axis=1)
        return margin, shares, start

    def probability(self, key: str, margin: np.ndarray) -> np.ndarray:
        return logistic(margin) if self.link[key] == "logistic" else margin


def logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-2 * margin))


def pack(nodes: DataFrame, features: list[str]) -> Packed:
    """Nodes as arrays on the driver; more than MOST_NODES of them stop the job."""
    n = nodes.count()
    if n > MOST_NODES:
        raise ValueError(f"{n} nodes are more than {MOST_NODES}: score the areas in groups")
    return Packed(nodes.select(*NODE_COLUMNS).toArrow(), features)


def _by_key(keys: pa.Array, columns: tuple[pa.Array, ...], packed: Packed):
    """(key, rows, their features) for each key of a batch that has a model."""
    x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
    encoded = keys.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    for code, key in enumerate(encoded.dictionary.to_pylist()):
        if key in packed.roots:
            at = np.flatnonzero(codes == code)
            yield key, at, x[at]


def probability(spark: SparkSession, nodes: DataFrame, key: str | Column, features: list[str], columns: list[Column] | None = None) -> Column:
    """The probability under the row's own model; null for a key without one.

    `columns` stand for the features where they have other names.
    """
    shared = spark.sparkContext.broadcast(pack(nodes, features))

    @F.arrow_udf("double")
    def score(keys: pa.Array, *values: pa.Array) -> pa.Array:
        packed, out = shared.value, np.full(len(keys), np.nan)
        if len(keys):
            for name, at, x in _by_key(keys, values, packed):
                out[at] = packed.probability(name, packed.walk(name, x)[0])
        return pa.array(out, mask=np.isnan(out))

    wanted = columns or [F.col(f) for f in features]
    return score(F.col(key) if isinstance(key, str) else key, *[c.cast("double") for c in wanted])


def path_contributions(spark: SparkSession, nodes: DataFrame, key: str | Column, features: list[str]) -> Column:
    """struct<start, contributions>: what each feature moved the margin by along the row's paths.

    A split moves a row from its node's value to its child's; the difference is the split
    feature's. Start and contributions add up to the margin. Null for a key without a model.
    """
    shared = spark.sparkContext.broadcast(pack(nodes, features))

    @F.arrow_udf("struct<start:double, contributions:array<double>>")
    def explain(keys: pa.Array, *values: pa.Array) -> pa.Array:
        packed = shared.value
        start = np.full(len(keys), np.nan)
        parts = np.zeros((len(keys), len(features)))
        if len(keys):
            for name, at, x in _by_key(keys, values, packed):
                _, parts[at], start[at] = packed.walk(name, x, contributions=True)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * len(features), pa.int32()), pa.array(parts.ravel()))
        return pa.StructArray.from_arrays([pa.array(start), lists], ["start", "contributions"], mask=pa.array(np.isnan(start)))

    return explain(F.col(key) if isinstance(key, str) else key, *[F.col(f).cast("double") for f in features])


# ---------------------------------------------------------------- many rows by many trees


def _stored(nodes: DataFrame, features: list[str]) -> DataFrame:
    """The nodes, written once: they are counted and dealt out."""
    kept = through_table(nodes.select(*NODE_COLUMNS), "nodes")
    unknown = kept.where(F.col("feature").isNotNull() & ~F.col("feature").isin(*features)).select("feature").distinct().limit(9)
    if names := sorted(r.feature for r in unknown.collect()):
        raise ValueError(f"the models ask for features that are not given: {names}")
    return kept


def _vector(key: str, columns: list[Column]) -> list[Column]:
    return [F.col(key).alias("_k"), *[c.cast("double").alias(f"_f{i}") for i, c in enumerate(columns)]]


def _vectors(rows: DataFrame) -> DataFrame:
    """Rows of an area and features alike once, with their number `_n` and an id `_v`, as a table."""
    alike = rows.where("_k IS NOT NULL").groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    return through_table(alike.withColumn("_v", F.monotonically_increasing_id()), "vectors")


def _walked(vectors: DataFrame, nodes: DataFrame, features: list[str], contributions: bool = False) -> DataFrame:
    """(_v, link, margin, parts) of the vectors whose area has a model; parts, what each feature
    moved the margin by, if asked for."""
    blocks = nodes.groupBy(F.col("key").alias("_k")).agg(F.ceil(F.count("*") / BLOCK_NODES).cast("int").alias("_blocks"))
    chunks = vectors.groupBy("_k").agg(F.ceil(F.count("*") / CHUNK_ROWS).cast("int").alias("_chunks"))
    sizes = through_table(blocks.join(chunks, "_k"), "sizes")  # a row per area
    values = [f"_f{i}" for i in range(len(features))]
    rows = vectors.join(sizes, "_k").select(
        "_k", "_v", *values, F.pmod(F.xxhash64("_v"), "_chunks").cast("int").alias("_c"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_b")
    )
    held = nodes.withColumn("_k", F.col("key")).join(sizes, "_k").select(
        "_k", *NODE_COLUMNS, F.pmod(F.xxhash64("tree"), "_blocks").cast("int").alias("_b"), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_c")
    )

    def walk(few: pa.Table, trees: pa.Table) -> pa.Table:
        ids = few["_v"].combine_chunks()
        if not few.num_rows or not trees.num_rows:
            return pa.table({"_v": ids[:0], "block": pa.array([], pa.int32()), "link": pa.array([], pa.string()), "margin": pa.array([], pa.float64()), "parts": pa.array([], pa.list_(pa.float64()))})
        key, packed = trees["key"][0].as_py(), Packed(trees, features)
        x = np.stack([few[v].to_numpy().astype(float) for v in values], axis=1)
        margin, parts, _ = packed.walk(key, x, contributions)
        n = len(margin)
        lists = pa.nulls(n, pa.list_(pa.float64())) if parts is None else pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(values), pa.int32()), pa.array(parts.ravel()))
        return pa.table({"_v": ids, "block": pa.array(np.full(n, trees["_b"][0].as_py(), np.int32)), "link": pa.array([packed.link[key]] * n), "margin": margin, "parts": lists})

    at = ["_k", "_b", "_c"]
    met = rows.groupBy(*at).cogroup(held.groupBy(*at)).applyInArrow(walk, "_v bigint, block int, link string, margin double, parts array<double>")
    summed = met.groupBy("_v").agg(F.max("link").alias("link"), F.sort_array(F.collect_list(F.struct("block", "margin", "parts"))).alias("_m"))
    none = F.array(*[F.lit(0.0) for _ in features])
    parts = F.aggregate("_m", none, lambda a, m: F.zip_with(a, m["parts"], lambda x, y: x + y)) if contributions else F.lit(None)
    return summed.select("_v", "link", F.aggregate("_m", F.lit(0.0), lambda a, m: a + m["margin"]).alias("margin"), parts.alias("parts"))


def _probabilities(vectors: DataFrame, nodes: DataFrame, features: list[str]) -> DataFrame:
    """Distinct feature vectors (_k, _f0, ...) whose area has a model, with their probability `_p`."""

    @F.arrow_udf("double")
    def linked(margins: pa.Array, links: pa.Array) -> pa.Array:
        margin = margins.to_numpy(zero_copy_only=False).astype(float)
        p = np.where(np.array(links.to_pylist(), object) == "logistic", logistic(margin), margin)
        return pa.array(p, pa.float64(), mask=np.isnan(p))

    walked = _walked(vectors, nodes, features).withColumn("_p", linked("margin", "link"))
    return vectors.drop("_n").join(walked.select("_v", "_p"), "_v").drop("_v")


def _matched(df: DataFrame, found: DataFrame, key: str, columns: list[Column], name: str) -> DataFrame:
    """df with the probability of each row's vector as column `name`."""
    on = F.col(key).eqNullSafe(F.col("_k"))
    for i, c in enumerate(columns):
        on = on & c.cast("double").eqNullSafe(F.col(f"_f{i}"))
    return df.join(found.withColumnRenamed("_p", name), on, "left").drop("_k", *[f"_f{i}" for i in range(len(columns))])


# ---------------------------------------------------------------- scored frames


def score(df: DataFrame, nodes: DataFrame, features: list[str], key: str = "state", name: str = "probability") -> DataFrame:
    """Add the probability of rows with status OK, each by the model of its own area.

    Every row stays. A probability outside 0..1 is refused, not clamped, and an OK row whose
    area has no model becomes UNAVAILABLE; both say so in `reasons`. The rows are written once.
    """
    table, columns = through_table(df, "to-score"), [F.col(f) for f in features]
    vectors = _vectors(table.where("status = 'OK'").select(*_vector(key, columns)))
    found = _matched(table, _probabilities(vectors, _stored(nodes, features), features), key, columns, "_p")
    ok = F.col("status") == "OK"
    sane = F.col("_p").between(0.0, 1.0)
    reason = F.when(ok & F.col("_p").isNull(), "no model for this area").when(ok & ~sane, "probability outside 0..1")
    kept = [c for c in df.columns if c not in (name, "status", "reasons")]
    return found.select(
        *kept,
        F.when(ok & ~F.coalesce(sane, F.lit(False)), "UNAVAILABLE").otherwise(F.col("status")).alias("status"),
        F.array_compact(F.concat("reasons", F.array(reason))).alias("reasons"),
        F.when(ok & sane, F.col("_p")).alias(name),
    )


def score_linear(df: DataFrame, terms: DataFrame, features: list[str], key: str = "state", name: str = "probability") -> DataFrame:
    """The same for logistic models kept as terms: one row per area meets the rows in one join."""
    packed = terms.groupBy(F.col("key").alias(key)).agg(
        F.sum(F.when(F.col("feature").isNull(), F.col("weight"))).alias("_intercept"),
        *[F.sum(F.when(F.col("feature") == f, F.col("weight"))).alias(f"_w_{i}") for i, f in enumerate(features)],
    )
    margin = F.col("_intercept")
    for i, f in enumerate(features):
        margin = margin + F.col(f).cast("double") * F.col(f"_w_{i}")
    ok = F.col("status") == "OK"
    kept = [c for c in df.columns if c not in (name, "status", "reasons")]
    joined = df.join(packed, key, "left").withColumn("_p", 1 / (1 + F.exp(-margin)))
    reason = F.when(ok & F.col("_intercept").isNull(), "no model for this area").when(ok & F.col("_p").isNull(), "a feature is missing")
    usable = ok & F.col("_p").isNotNull()
    return joined.select(
        *kept,
        F.when(ok & ~usable, "UNAVAILABLE").otherwise(F.col("status")).alias("status"),
        F.array_compact(F.concat("reasons", F.array(reason))).alias("reasons"),
        F.when(usable, F.col("_p")).alias(name),
    )


def score_scenarios(
    df: DataFrame, nodes: DataFrame, features: list[str], scenarios: tuple[tuple[str, float], ...] = models.SCENARIOS, key: str = "state",
) -> DataFrame:
    """Each row once, with `scenarios`: an array of (scenario, daily_mm, probability).

    The rows are read, placed and sampled once; a scenario replaces the rainfall features
    only, so nothing else can differ between them. Rows that are not OK get null probabilities.
    """
    days = dict(models.SCENARIO_DAYS)
    table = through_table(df, "to-score")
    ways = [[F.lit(mm * days[f]).cast("float") if f in days else F.col(f) for f in features] for _, mm in scenarios]
    ready = table.where("status = 'OK'").select(F.inline(F.array(*[F.struct(*_vector(key, columns)) for columns in ways])))
    found = through_table(_probabilities(_vectors(ready), _stored(nodes, features), features), "probabilities")
    out = table
    for i, columns in enumerate(ways):
        out = _matched(out, found, key, columns, f"_p{i}")
    parts = [
        F.struct(F.lit(name).alias("scenario"), F.lit(float(mm)).alias("daily_mm"), F.when(F.col("status") == "OK", F.col(f"_p{i}")).alias("probability"))
        for i, (name, mm) in enumerate(scenarios)
    ]
    return out.select(*df.columns, F.array(*parts).alias("scenarios"))


def tree_ranking(df: DataFrame, nodes: DataFrame, features: list[str], key: str = "state") -> DataFrame:
    """(key, feature, importance): mean absolute path contribution of each feature per area."""
    vectors = _vectors(df.select(*_vector(key, [F.col(f) for f in features])))
    explained = vectors.join(_walked(vectors, _stored(nodes, features), features, contributions=True), "_v")
    labels = F.array(*[F.lit(f) for f in features])
    each = explained.select(F.col("_k").alias(key), "_n", F.inline(F.arrays_zip(labels.alias("feature"), F.col("parts").alias("c"))))
    return each.groupBy(key, "feature").agg((F.sum(F.abs("c") * F.col("_n")) / F.sum("_n")).alias("importance"))


def linear_ranking(df: DataFrame, terms: DataFrame, features: list[str], key: str = "state") -> DataFrame:
    """(key, feature, importance): mean absolute coefficient x (value - the area's mean)."""
    labels = F.array(*[F.lit(f) for f in features])
    long = df.select(F.col(key), F.inline(F.arrays_zip(labels.alias("feature"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"))))
    means = long.groupBy(key, "feature").agg(F.avg("x").alias("mean"))
    weights = terms.where("feature IS NOT NULL").select(F.col("key").alias(key), "feature", "weight").join(means, [key, "feature"])
    each = long.join(weights, [key, "feature"])  # one row per area and feature
    return each.groupBy(key, "feature").agg(F.avg(F.abs((F.col("x") - F.col("mean")) * F.col("weight"))).alias("importance"))


def attribution(df: DataFrame, model: DataFrame | None, features: list[str], key: str = "state") -> DataFrame:
    """Each area's features by importance under its own stored model, trees or linear terms.

    Without a model one UNAVAILABLE row says so; nothing is invented.
    """
    if model is None:
        nothing = "CAST(NULL AS STRING)"
        return df.sparkSession.sql(f"SELECT 'UNAVAILABLE' AS status, {nothing} AS {key}, {nothing} AS feature, CAST(NULL AS DOUBLE) AS importance, 'no model was supplied' AS reason")
    ranked = tree_ranking(df, model, features, key) if "tree" in model.columns else linear_ranking(df, model, features, key)
    return ranked.select(F.lit("REAL").alias("status"), key, "feature", "importance", F.lit(None).cast("string").alias("reason"))
