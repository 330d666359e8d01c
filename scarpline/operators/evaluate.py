"""Exact, tie-aware model metrics and the decision they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import vocab
from ..functions.numbers import reasons, rounded
from . import prefix


def _by_score(scored: DataFrame, score: str, target: str) -> DataFrame:
    """Positives and negatives per distinct score: all the curves need."""
    return scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(target) == 1).alias("pos"),
        F.count_if(F.col(target) != 1).alias("neg"),
    )


def binary_metrics(scored: DataFrame, by: list[str] = (), score: str = "score",
                   target: str = "target", threshold: float = vocab.DECISION_THRESHOLD) -> DataFrame:
    """Precision, recall, F1 and false-alarm rate at the threshold, 4 dp.

    An empty denominator gives 0, and so does everything when only one class occurs.
    """
    hit, real = F.col(score) >= threshold, F.col(target) == 1
    counts = scored.groupBy(*by).agg(
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    both = (tp + fn > 0) & (fp + tn > 0)
    only_both = lambda c: F.when(both, rounded(c, 4)).otherwise(0.0)
    return counts.withColumns({
        "precision": only_both(ratio(tp, tp + fp)),
        "recall": only_both(ratio(tp, tp + fn)),
        "f1": only_both(ratio(2 * tp, 2 * tp + fp + fn)),
        "false_alarm_rate": only_both(ratio(fp, fp + tn)),
    })


def roc_auc(scored: DataFrame, score: str = "score", target: str = "target",
            ranges: int = prefix.DEFAULT_RANGES) -> DataFrame:
    """Rank AUC with ties counted half; 0 when only one class occurs."""
    counts = _by_score(scored, score, target)
    placed = prefix.running_totals(counts, "score", ["pos"], descending=True, ranges=ranges)
    # Twice the number of ordered pairs, as an exact integer sum.
    pairs2 = F.sum(F.col("neg").cast("decimal(38,0)") * (2 * F.col("before_pos") + F.col("pos")))
    sums = placed.agg(
        pairs2.alias("pairs2"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    auc = F.try_divide(F.col("pairs2").cast("double"), F.lit(2.0) * pairs)
    return sums.select(
        "positives", "negatives",
        F.when(pairs > 0, rounded(auc, 4)).otherwise(0.0).alias("roc_auc"),
    )


def average_precision(scored: DataFrame, score: str = "score", target: str = "target",
                      ranges: int = prefix.DEFAULT_RANGES) -> DataFrame:
    """Step-wise average precision, not the trapezoid; 0 when only one class occurs."""
    counts = _by_score(scored, score, target)
    placed = prefix.running_totals(counts, "score", ["pos", "neg"], descending=True, ranges=ranges)
    tp = F.col("before_pos") + F.col("pos")
    seen = tp + F.col("before_neg") + F.col("neg")
    out = placed.agg(
        F.sum(F.col("pos") * (tp / seen)).alias("weighted"),
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"),
    )
    ok = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return out.select(
        "positives", "negatives",
        F.when(ok, rounded(F.try_divide("weighted", "positives"), 4)).otherwise(0.0).alias("pr_auc"),
    )


def all_metrics(scored: DataFrame, score: str = "score", target: str = "target",
                threshold: float = vocab.DECISION_THRESHOLD, ranges: int = prefix.DEFAULT_RANGES) -> DataFrame:
    """The six reported numbers as one row, all from one pass over the score counts."""
    counts = _by_score(scored, score, target)
    placed = prefix.running_totals(counts, "score", ["pos", "neg"], descending=True, ranges=ranges)
    pos, neg = F.col("pos"), F.col("neg")
    seen_pos = F.col("before_pos") + pos
    seen = seen_pos + F.col("before_neg") + neg
    hit = F.col("score") >= threshold
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    sums = placed.agg(
        total(F.when(hit, pos)).alias("tp"), total(F.when(hit, neg)).alias("fp"),
        total(F.when(~hit, pos)).alias("fn"), total(F.when(~hit, neg)).alias("tn"),
        F.sum(pos * (seen_pos / seen)).alias("weighted"),
        F.sum(neg.cast("decimal(38,0)") * (2 * F.col("before_pos") + pos)).cast("double").alias("pairs2"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    both = (tp + fn > 0) & (fp + tn > 0)
    ratio = lambda a, b: F.when(both, rounded(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)).otherwise(0.0)
    return sums.select(
        ratio(F.col("weighted"), tp + fn).alias("pr_auc"),
        ratio(F.col("pairs2"), F.lit(2.0) * (tp + fn).cast("double") * (fp + tn)).alias("roc_auc"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(fp, fp + tn).alias("false_alarm_rate"),
    )


def model_decision(evidence: DataFrame) -> DataFrame:
    """Option A only without a reason against it.

    Wants pct_low_accuracy, independent_events, far and pr_auc; missing metrics count
    against the model (rate 1, area 0).
    """
    far, area = F.coalesce("far", F.lit(1.0)), F.coalesce("pr_auc", F.lit(0.0))
    low = F.coalesce("pct_low_accuracy", F.lit(0.0))
    n = F.coalesce("independent_events", F.lit(0))
    why = reasons(
        (low > 50.0, F.format_string("high spatial uncertainty: %.1f%% of events at 5 km or worse", low)),
        (n < vocab.MIN_DATES_DECISION,
         F.format_string("limited temporal sample size: %d independent dates", n)),
        ((far > 0.25) | (area < 0.50),
         F.format_string("temporal validation instability: false-alarm rate %.2f, PR-AUC %.2f", far, area)),
    )
    return evidence.withColumn("justification_reasons", why).withColumn(
        "final_recommendation",
        F.when(F.size("justification_reasons") > 0, vocab.OPTION_C).otherwise(vocab.OPTION_A),
    )


def refit_consistency(refitted: DataFrame, reported: DataFrame, key: list[str], metrics: list[str]) -> DataFrame:
    """The reported rows; a refit that disagrees in any metric stops the job."""
    a = reported.alias("a").join(refitted.alias("b"), key, "left")
    same = F.lit(True)
    for m in metrics:
        same = same & F.col(f"a.{m}").eqNullSafe(F.col(f"b.{m}"))
    guard = F.assert_true(same, F.lit("refitted metrics differ from the reported ones")).isNull()
    return a.where(guard).select("a.*")


def feature_ranking(contributions: DataFrame, names: list[str], column: str = "contributions") -> DataFrame:
    """Features by mean absolute contribution, 6 dp; rows of another length are left out.

    No aligned row gives an empty ranking. Each row contributes its own elements, and
    partial averages form before the shuffle.
    """
    labels = F.array(*[F.lit(n) for n in names])
    aligned = contributions.where(F.size(column) == len(names))
    one = aligned.select(F.posexplode(column).alias("i", "c"))
    return (
        one.groupBy("i").agg(F.avg(F.abs(F.col("c").cast("double"))).alias("_mean"))
        .select(
            F.element_at(labels, F.col("i") + 1).alias("feature"),
            rounded("_mean", 6).alias("importance"),
        )
        .orderBy(F.col("importance").desc(), "feature")
    )
