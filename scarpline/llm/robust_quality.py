"""Quality rules and robust multivariate outliers, in DataFrame functions alone.

Every text gets exact word, symbol, line and repetition counts. Their transformed vector is
held against a minimum-covariance-determinant estimate of its language and source:

* Start from medians and quartile spreads, then repeat concentration steps: rank the rows of
  a group by Mahalanobis distance, take mean and covariance of the nearest part, again,
  until no estimate changes.
* Ranks come from a histogram of the logarithm of the distance. One aggregation per step
  gathers count, sums and products per group and bin, combined before the shuffle; prefix
  sums over the bins then give the moments of the nearest part. No group is ever collected,
  a hot source is only more rows for the partial sums.
* Vectors are whole thousandths, so sums are exact and do not depend on task order.
* A least variance is added on the diagonal, so a statistic that most texts share (no
  symbols at all, say) cannot make every other text an outlier.

A group's estimate is drawn toward that of its language, the more the fewer rows it rests on: with
n of them it counts n / (n + `prior`), the language the rest. So a source of three texts is held
against its language, one of a million against itself, and nothing changes at any size between.
Null languages and sources are groups of their own. Columns may have any name: those called like an
output are replaced, all others pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from scarpline.session import through_table

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Names of the vector, in order, with the least standard deviation of each. Every one is small
#: enough for its statistic to pass the cut alone: the base rules leave z_repeats up to 1.79, and
#: 0.25 lets 1.14 pass (22% repeated words); 0.15 lets z_symbols pass at 10 per 100 words.
VECTOR = {"z_length": 0.15, "z_symbols": 0.15, "z_lines": 0.35, "z_repeats": 0.25, "z_capitals": 0.3}
UNIT = 1000
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals")


# ---------------------------------------------------------------- counts of a text


def _repeat_words(words: Column, window: int = 3) -> Column:
    """Words inside windows that occur twice or more.

    A window is the text of a struct of neighbouring words (no word holds a space, so texts
    are equal only for equal windows). Most texts repeat none, which a distinct count tells;
    the others sort (window, place) and walk the places of repeated ones.
    """
    n = F.size(words)
    windows = F.slice(F.arrays_zip(words, *(F.slice(words, k + 1, n) for k in range(1, window))), 1, n - (window - 1))
    texts = windows.cast("array<string>")
    placed = F.sort_array(F.arrays_zip(texts.alias("w"), F.sequence(F.lit(0), n - window).alias("p")))

    def covered(rows: Column) -> Column:
        m = F.size(rows)
        text = lambda i: F.get(rows, i)["w"]
        twice = F.filter(rows, lambda x, i: (x["w"] == text(i - 1)) | ((i + 1 < m) & (x["w"] == text(i + 1))))
        places = F.sort_array(F.transform(twice, lambda x: x["p"]))
        start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-window).alias("at"))
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(window), p - a["at"])).cast("bigint").alias("n"), p.alias("at"))
        return F.aggregate(places, start, step)["n"]

    none = F.lit(0).cast("bigint")
    return F.when(n < window + 1, none).when(F.size(F.array_distinct(texts)) == n - (window - 1), none).otherwise(
        F.element_at(F.transform(F.array(placed), covered), 1)
    )


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_capitals (long) of the
    whole text; a null text has none of any. Columns of these names are replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    count = lambda pattern: F.regexp_count(body, F.lit(pattern)).cast("bigint")
    words = F.array_remove(F.split(body, SPACE + "+"), "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    return (
        df.withColumn("__words", words)
        .withColumn("__lines", lines)
        .withColumns(
            {
                "n_words": F.size("__words").cast("bigint"),
                "word_chars": F.char_length(body).cast("bigint") - count(SPACE),
                "n_symbols": count(SYMBOLS),
                "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
                "n_repeat_words": _repeat_words(F.col("__words")),
                "n_capitals": count(r"[A-Z!]"),
            }
        )
        .drop("__words", "__lines")
    )


def base_failed() -> Column:
    """Too short, or more than half of the words repeat."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> dict[str, Column]:
    """The vector in thousandths: logarithms of length and of shares of the words."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c, by: F.log1p(by * F.col(c) / n)
    terms = [
        F.log1p(F.col("word_chars") / n),
        share("n_symbols", 10),
        share("n_dup_lines", 100),
        share("n_repeat_words", 10),
        share("n_capitals", 4),
    ]
    return {z: F.round(UNIT * t).cast("bigint") for z, t in zip(VECTOR, terms, strict=True)}


def with_vector(df: DataFrame) -> DataFrame:
    """Add the vector's columns; columns of their names are replaced."""
    return df.withColumns(vector())


# ---------------------------------------------------------------- the estimate


def chi2_below(x: float, p: int) -> float:
    """Chance that a chi-square of p degrees is below x."""
    a, half = p / 2, x / 2
    term = total = 1 / a
    for k in range(1, 2000):
        term *= half / (a + k)
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a)) if x > 0 else 0.0


def chi2_at(share: float, p: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, p) < share else (low, mid)
    return low


def _inverse(matrix: Column, p: int) -> Column:
    """Gauss-Jordan on a positive definite matrix of p rows."""
    unit = F.array(*(F.array(*(F.lit(float(i == j)) for j in range(p))) for i in range(p)))
    both = F.zip_with(matrix, unit, lambda a, b: F.concat(a, b))

    def step(a: Column, k: Column) -> Column:
        pivot = F.transform(F.get(a, k), lambda x: x / F.get(F.get(a, k), k))
        return F.transform(a, lambda row, i: F.when(i == k, pivot).otherwise(F.zip_with(row, pivot, lambda x, y: x - y * F.get(row, k))))

    done = F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), both, step)
    return F.transform(done, lambda row: F.slice(row, p + 1, p))


def _distance(names: list[str], of: str = "") -> Column:
    """Squared Mahalanobis distance to `__center` under the inverse covariance `__inv`."""
    away = [F.col(of + z) / UNIT - F.col("__center")[i] for i, z in enumerate(names)]
    terms = [away[i] * away[j] * F.col("__inv")[i][j] * (1 if i == j else 2) for i in range(len(names)) for j in range(i, len(names))]
    return sum(terms[1:], terms[0])


def _estimate(found: DataFrame, keys: list[str], base: DataFrame | None, prior: float) -> DataFrame:
    """Groups with their row counts, centers and covariances (__n, __mid, __cov) -> drawn toward the
    language's (`base`), with the inverse. Without a base they are taken as they are."""
    p = len(VECTOR)
    center, cov = F.col("__mid"), F.col("__cov")
    if base is not None:
        found = found.join(base.select("__lang", F.col("__center").alias("__c0"), F.col("__cov").alias("__v0")), "__lang")
        own = F.col("__n") / (F.col("__n") + prior)
        mixed = lambda a, b: F.zip_with(a, b, lambda x, y: own * x + (1 - own) * y)
        center, cov = mixed(center, F.col("__c0")), F.zip_with(cov, F.col("__v0"), mixed)
    return found.select(*keys, center.alias("__center"), cov.alias("__cov")).withColumn("__inv", _inverse(F.col("__cov"), p))


def _start(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Per group: its rows, medians, and squared quartile spreads on the diagonal."""
    long = rows.select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(z).alias("v")) for i, z in enumerate(names)))).alias("e"))
    counted = long.groupBy(*keys, F.col("e.i").alias("i"), F.floor(F.col("e.v") / 10).alias("v")).count()
    whole = Window.partitionBy(*keys, "i")
    counted = counted.withColumns({"upto": F.sum("count").over(whole.orderBy("v")), "all": F.sum("count").over(whole)})
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("v"))) * 10 / UNIT
    per = counted.groupBy(*keys, "i").agg(at(0.5).alias("mid"), (at(0.75) - at(0.25)).alias("iqr"), F.max("all").alias("n"))
    least = F.array(*(F.lit(s) for s in VECTOR.values()))
    per = per.withColumn("sd", F.greatest(F.col("iqr") / 1.349, F.get(least, F.col("i"))))
    per = per.groupBy(*keys).agg(F.max("n").alias("__n"), F.array_sort(F.collect_list(F.struct("i", "mid", "sd"))).alias("e"))  # one entry per statistic
    p = len(names)
    return per.select(
        *keys, "__n",
        F.array(*(F.col("e")[i]["mid"] for i in range(p))).alias("__mid"),
        F.array(*(F.array(*((F.col("e")[i]["sd"] ** 2) if i == j else F.lit(0.0) for j in range(p))) for i in range(p))).alias("__cov"),
    )


def _concentrate(rows: DataFrame, estimate: DataFrame, keys: list[str], names: list[str], part: float, factor: float) -> DataFrame:
    """One concentration step: the moments of the nearest `part` of each group."""
    p = len(names)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    near = rows.join(estimate, keys).withColumn("bin", F.floor(50 * F.log(_distance(names) + 1e-6)))
    sums = [F.count("*").alias("c")] + [F.sum(z).alias(f"s{i}") for i, z in enumerate(names)]
    sums += [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}_{j}") for i, j in pairs]
    binned = near.groupBy(*keys, "bin").agg(*sums)
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    columns = ["c", *(f"s{i}" for i in range(p)), *(f"q{i}_{j}" for i, j in pairs)]
    run = binned.select(*keys, "bin", F.sum("c").over(Window.partitionBy(*keys)).alias("all"), *(F.sum(c).over(upto).alias(c) for c in columns))
    run = run.where(F.col("c") >= part * F.col("all"))
    best = run.groupBy(*keys).agg(F.min_by(F.struct("all", *columns), "bin").alias("m")).select(*keys, "m.*")
    mean = [F.col(f"s{i}") / F.col("c") / UNIT for i in range(p)]
    cov = {(i, j): factor * (F.col(f"q{i}_{j}") / F.col("c") / UNIT**2 - mean[i] * mean[j]) for i, j in pairs}
    least = list(VECTOR.values())
    matrix = F.array(*(F.array(*(cov[min(i, j), max(i, j)] + (F.lit(least[i] ** 2) if i == j else 0) for j in range(p))) for i in range(p)))
    return best.select(*keys, F.col("all").alias("__n"), F.array(*mean).alias("__mid"), matrix.alias("__cov"))


def robust_estimate(rows: DataFrame, keys: list[str], base: DataFrame | None = None, part: float = 0.6, prior: float = 200.0, steps: int | None = None) -> DataFrame:
    """Per group `__center`, `__cov` and `__inv`: concentration steps until every estimate stays as it
    is, or so many `steps`. rows: the keys and the vector's columns, read once per step."""
    names = list(VECTOR)
    bound = chi2_at(part, len(names))
    factor = part / chi2_below(bound, len(names) + 2)
    estimate = through_table(_estimate(_start(rows, keys, names), keys, base, prior), "estimate")
    seen, taken = set(), 0
    while taken != steps:
        moved, told = _estimate(_concentrate(rows, estimate, keys, names, part, factor), keys, base, prior), Observation()
        moved = moved.observe(told, F.sum(F.xxhash64(*keys, "__center", "__inv").cast("decimal(38,0)")).alias("state"))
        estimate = through_table(moved, "estimate")  # told as it is written: no second query per step
        taken += 1
        state = told.get["state"]
        if steps is None and state in seen:
            break
        seen.add(state)
    return estimate


def with_verdict(
    table: DataFrame, lang: str = "lang", source: str = "source", part: float = 0.6, steps: int | None = None, prior: float = 200.0, tail: float = 0.999
) -> DataFrame:
    """Add `base_failed`, `distance` (squared) and `kept` to rows of `with_statistics`.

    `table` is read once per step, so write it first (`through_table`). Only rows that pass the
    base rules shape the estimates. `part` is the share of a group in its estimate, `steps` the
    concentration steps (None: until every estimate stays as it is), `prior` the rows that a
    language's estimate counts for in each of its sources; rows whose squared distance is beyond
    the chi-square quantile `tail` are rejected. A group without a row that passes the base rules
    has no estimate, and its rows no distance.
    """
    names, keys = list(VECTOR), ["__lang", "__source"]
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    rows = table.withColumns({"base_failed": base_failed(), "__lang": group(lang), "__source": group(source), "__v": F.struct(*[c.alias(z) for z, c in vector().items()])})
    fair = rows.where(~F.col("base_failed")).select(*keys, "__v.*")
    language = robust_estimate(fair, ["__lang"], None, part, prior, steps)
    estimate = robust_estimate(fair, keys, language, part, prior, steps)
    judged = rows.join(estimate.drop("__cov"), keys, "left").withColumn("distance", _distance(names, "__v."))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_at(tail, len(names)), F.lit(True))
    return judged.withColumn("kept", kept).drop(*keys, "__v", "__center", "__inv")
