"""Susceptibility models on Spark ML: baselines, scoring, attribution, scenarios."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..session import scratch_root
from . import evaluate, matrix

SEED = 42
PRIMARY = "Gradient Boosting"
MODELS = ("Logistic Regression", "Random Forest", PRIMARY)
CATEGORY = "_land_cover_index"
CATEGORY_BASE = 1  # the class of index 0


def _with_category(df: DataFrame, classes=tuple(sorted(vocab.LAND_COVER_GROUP_LABELS))) -> DataFrame:
    """Land cover as a nominal column over its whole vocabulary, known without a pass."""
    attribute = {"ml_attr": {"type": "nominal", "vals": [str(c) for c in classes], "name": CATEGORY}}
    index = (F.col(vocab.LAND_COVER_FEATURE) - CATEGORY_BASE).cast("double")
    return df.withColumn(CATEGORY, index.alias(CATEGORY, metadata=attribute))


def build(name: str, features: list[str], trees: int = 100, seed: int = SEED) -> Pipeline:
    """An unfitted model. Only the boosted one treats land cover as a category."""
    nominal = name == PRIMARY
    inputs = [CATEGORY if nominal and f == vocab.LAND_COVER_FEATURE else f for f in features]
    stages = [VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")]
    common = {"featuresCol": "features", "labelCol": "target"}
    if name == "Logistic Regression":
        stages.append(LogisticRegression(maxIter=1000, **common))
    elif name == "Random Forest":
        stages.append(RandomForestClassifier(numTrees=trees, seed=seed, **common))
    elif name == PRIMARY:
        # Every tenth round is checkpointed, so a lost executor replays ten rounds, not all.
        stages.append(GBTClassifier(maxIter=trees, seed=seed, checkpointInterval=10, **common))
    else:
        raise ValueError(f"unknown model {name!r}")
    return Pipeline(stages=stages)


def fit(name: str, train: DataFrame, features: list[str], trees: int = 100) -> PipelineModel:
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:  # a cluster has named its own
        context.setCheckpointDir(scratch_root(train.sparkSession))
    return build(name, features, trees).fit(_with_category(train))


def fit_by_state(
    name: str, train: DataFrame, states: list[str], features: list[str], trees: int = 100,
) -> dict[str, PipelineModel]:
    """One model per state that has rows of both classes; the states are few and fixed."""
    both = train.groupBy("state").agg(F.count_distinct("target").alias("n")).where("n > 1").select("state")
    able = {r.state for r in both.where(F.col("state").isin(states)).collect()}
    return {s: fit(name, train.where(F.col("state") == s), features, trees) for s in states if s in able}


def score(model: PipelineModel, df: DataFrame, name: str = "probability") -> DataFrame:
    """Positive-class probability; the model's working columns are left out."""
    kept = [c for c in df.columns if c != name]
    scored = model.transform(_with_category(df))
    return scored.select(*kept, vector_to_array("probability")[1].alias(name))


def train_baselines(
    data: DataFrame, splits: dict[str, DataFrame], trees: int = 100,
    feature_sets: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Metrics of every model x feature set x split; each split frame has a `split` column.

    The frames are read many times by the fits, so pass tables, not long lineages.
    """
    sets = feature_sets or {"static": vocab.STATIC_FEATURES, "static+rain": vocab.MODEL_FEATURES}
    rows = []
    for split_name, frame in splits.items():
        train, test = frame.where("split = 'train'"), frame.where("split = 'test'")
        for set_name, features in sets.items():
            for model_name in MODELS:
                model = fit(model_name, train, features, trees)
                scored = score(model, test, "score").select("score", "target")
                rows.append(
                    evaluate.all_metrics(scored).select(
                        F.lit(split_name).alias("split"), F.lit(set_name).alias("features"),
                        F.lit(model_name).alias("model"), "*",
                    )
                )
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def clean_for_training(m: DataFrame, features=tuple(vocab.MODEL_FEATURES)) -> DataFrame:
    return matrix.drop_missing_features(m, list(features))


def grid_score(model: PipelineModel, cells: DataFrame) -> DataFrame:
    """Score OK cells in one pass; the others keep their reasons and no probability.

    Two disjoint filters and a union: no join back, hence no shuffle.
    """
    usable = score(model, cells.where("status = 'OK'"))
    rest = cells.where("status <> 'OK'").withColumn("probability", F.lit(None).cast("double"))
    return usable.unionByName(rest)


def point_score(models: dict[str, PipelineModel], points: DataFrame) -> DataFrame:
    """Points with status and state, each scored by its own state's model.

    A probability outside 0..1 is refused, not clamped. The states are few and fixed.
    """
    parts = [points.where((F.col("status") != "OK") | ~F.col("state").isin(*models)).withColumn(
        "probability", F.lit(None).cast("double"))]
    for state, model in sorted(models.items()):
        mine = points.where((F.col("status") == "OK") & (F.col("state") == state))
        parts.append(score(model, mine))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    sane = F.col("probability").between(0.0, 1.0)
    refused = F.col("probability").isNotNull() & ~sane
    return out.withColumns({
        "reasons": F.when(refused, F.array_append("reasons", F.lit("probability outside 0..1"))).when(
            (F.col("status") == "OK") & ~F.col("state").isin(*models), F.array_append("reasons", F.lit("no model for this state"))
        ).otherwise(F.col("reasons")),
        "status": F.when(refused | F.col("probability").isNull(), "UNAVAILABLE").otherwise(F.col("status")),
        "probability": F.when(sane, F.col("probability")),
    })


def linear_contributions(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Exact per-row contributions coefficient x (value - mean) of a linear model."""
    weights = [float(w) for w in model.stages[-1].coefficients]
    means = df.agg(F.struct(*[F.avg(f).alias(f) for f in features])).scalar()
    return df.withColumn("_m", means).withColumn(
        "contributions",
        F.array(*[(F.col(f).cast("double") - F.col(f"_m.{f}")) * w for f, w in zip(features, weights)]),
    ).drop("_m")


def tree_importances(spark, model: PipelineModel, features: list[str]) -> DataFrame:
    """Importances of a tree model as (feature, importance), largest first."""
    from .aoi import values_frame

    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, float(v)) for f, v in zip(features, values)]
    return values_frame(spark, "feature, importance", rows).orderBy(F.col("importance").desc(), "feature")


def feature_attribution(
    spark, model: PipelineModel | None, df: DataFrame | None, features: list[str]
) -> DataFrame:
    """Ranked features, or one UNAVAILABLE row saying what is missing; never invented."""
    missing = [t for t, x in (("no model was supplied", model), ("no rows were supplied", df)) if x is None]
    if missing:
        return spark.sql("SELECT 'UNAVAILABLE' AS status, CAST(NULL AS STRING) AS feature, CAST(NULL AS DOUBLE) AS importance").withColumn(
            "reason", F.lit("; ".join(missing))
        )
    if hasattr(model.stages[-1], "coefficients"):
        ranked = evaluate.feature_ranking(linear_contributions(model, df, features), features)
    else:
        ranked = tree_importances(spark, model, features)
    return ranked.select(
        F.lit("REAL").alias("status"), "feature", "importance", F.lit(None).cast("string").alias("reason")
    )


SCENARIOS = (("low", 1.0), ("high", 90.0))
#: How many days of a constant daily amount each rainfall feature sums.
SCENARIO_DAYS = {"rain_1d": 1, "rain_3d": 3, "rain_7d": 7, "antecedent_rain_14d": 14, "rain_intensity_max_3d": 1}


def scenario_cells(cells: DataFrame, scenarios=SCENARIOS) -> DataFrame:
    """Every cell once per rainfall scenario: constant daily mm for the whole window."""
    rows = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(mm).alias("daily_mm")) for n, mm in scenarios])
    kept = [c for c in cells.columns if c not in vocab.RAIN_FEATURES]
    return cells.select(*kept, F.inline(rows)).withColumns(
        {n: F.col("daily_mm") * k for n, k in SCENARIO_DAYS.items()}
    )
