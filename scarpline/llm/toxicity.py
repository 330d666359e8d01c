"""Toxicity by a classifier that is regularised with counterfactual sentences.

A logistic model over the distinct words of a text is fitted on labelled rows. Wherever a
labelled text names a group of people, its identity terms are swapped: each term for the
others of its kind, and for nothing. The fit adds the mean squared change of the score's
logit under such swaps to its loss. So a group's name itself cannot carry a verdict, and a
neutral mention of one group scores like one of another, or of none.

Fitting sees a bounded sample of labelled rows, `sample` of them, drawn by a hash of the id;
only these come to the driver. Scoring is one narrow pass over whole texts, and the weights
it broadcasts are bounded by `most_words`.

Defined results: null and empty texts score as a text without known words; rows with a null
label or id teach nothing; rows labelled twice teach twice; without a positive or a negative
label the score is the smoothed share of positives. Columns named like an output are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline.session import through_table

#: Identity terms by kind; a term is swapped for others of its kind.
IDENTITY = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "deaf", "blind", "elderly", "young"),
)
WORDS = re.compile(r"[^\W\d_]+").findall


def distinct_words(text: str | None) -> set[str]:
    return set(WORDS(text.lower())) if text else set()


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def logit(self, words: set[str]) -> float:
        return self.bias + sum(self.weights[w] for w in words & self.weights.keys())


def counts(codes: np.ndarray, size: int) -> np.ndarray:
    """How often each code occurs; piece by piece, as a count of all at once copies them twice as wide."""
    found = np.zeros(size, np.int64)
    for i in range(0, len(codes), Rows.PIECE):
        found += np.bincount(codes[i : i + Rows.PIECE], minlength=size)
    return found


class Rows:
    """A sparse matrix by rows, of ones if no values are given: just the products a gradient needs.

    Its entries, in the order of rows, and again in that of columns, are kept as one number each and
    where each row or column begins. Both products run over pieces of entries cut between rows, or
    between columns, so no temporary is as long as the matrix, and every sum adds the same numbers in
    the same order.
    """

    PIECE = 1 << 18

    def __init__(self, lengths: np.ndarray, col: np.ndarray, width: int, val: np.ndarray | float = 1.0):
        self.n, self.width = len(lengths), width
        starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        self.by_row = starts, col.astype(np.int32, copy=False), val
        self.by_col = self._turned(starts, self.by_row[1], width, val)

    @staticmethod
    def _part(starts: np.ndarray, i: int, j: int) -> tuple[int, np.ndarray]:
        """The first row of the entries i to j, and their rows counted from it."""
        first, last = (int(np.searchsorted(starts, at, "right")) - 1 for at in (i, j - 1))
        sizes = np.minimum(starts[first + 1 : last + 2], j) - np.maximum(starts[first : last + 1], i)
        return first, np.repeat(np.arange(last + 1 - first), sizes)

    def _turned(self, starts: np.ndarray, col: np.ndarray, width: int, val: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
        begin = np.concatenate([[0], np.cumsum(counts(col, width))])
        free, of = begin[:-1].copy(), np.empty(len(col), np.int32)
        out = val if np.isscalar(val) else np.empty(len(col))
        for i in range(0, len(col), self.PIECE):
            j = min(i + self.PIECE, len(col))
            first, row = self._part(starts, i, j)
            at = np.argsort(col[i:j], kind="stable")
            to = col[i:j][at]
            place = free[to] + np.arange(j - i) - np.searchsorted(to, to)
            of[place] = first + row[at]
            if not np.isscalar(val):
                out[place] = val[i:j][at]
            free += np.bincount(to, minlength=width)
        return begin, of, out

    def _sums(self, entries: tuple, w: np.ndarray, size: int) -> np.ndarray:
        starts, of, val = entries
        out, i = np.zeros(size), 0
        while i < len(of):
            j = min(i + self.PIECE, len(of))
            if j < len(of):  # back to where its row begins, or on to the end of a longer one
                row = int(np.searchsorted(starts, j, "right")) - 1
                j = int(starts[row] if starts[row] > i else starts[row + 1])
            part = w[of[i:j]] if np.isscalar(val) and val == 1 else (val if np.isscalar(val) else val[i:j]) * w[of[i:j]]
            first, to = self._part(starts, i, j)
            found = np.bincount(to, part)
            out[first : first + len(found)] += found
            i = j
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._sums(self.by_row, w, self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return self._sums(self.by_col, g, self.width)


def swaps(words: set[str], identity=IDENTITY) -> list[set[str]]:
    """The word sets of the counterfactual sentences: each kind's terms for each other term of it,
    or for nothing."""
    out = []
    for kind in identity:
        named = words.intersection(kind)
        if named:
            rest = words - named
            out += [rest | {term} for term in kind if term not in named] + [rest]
    return out


def fit(texts: list[set[str]], labels, **options) -> Model:
    """`fit_codes` on word sets."""
    words = sorted(set().union(*texts))
    at = {w: i for i, w in enumerate(words)}
    codes = [sorted(at[w] for w in t) for t in texts]
    flat = np.array([c for row in codes for c in row], dtype=np.int64)
    return fit_codes(flat, np.array([len(row) for row in codes], dtype=np.int64), words, labels, **options)


def fit_codes(flat: np.ndarray, lengths: np.ndarray, words: list[str], labels, *, identity=IDENTITY, penalty: float = 5.0, ridge: float = 2e-4, least: int = 3, most_words: int = 100_000, steps: int = 300) -> Model:
    """Full-batch Adam on logistic loss + ridge + `penalty` x mean squared counterfactual change.

    Rows are runs of `lengths` codes of distinct words. Words of at least `least` texts take part,
    the most frequent `most_words` of them. A word enters scaled by its smoothed log ratio between
    the classes, so the ridge holds down words that tell nothing.
    """
    y = np.asarray(labels, dtype=float)
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5)))
    found = counts(flat, len(words))
    used = sorted(np.flatnonzero(found >= least).tolist(), key=lambda c: (-found[c], words[c]))[:most_words]
    if not used or not 0 < y.sum() < len(y):
        return Model({}, prior)
    names, width = [words[c] for c in used], len(used)
    place = np.full(len(words), -1, np.int32)
    place[used] = np.arange(width)
    col, starts = place[flat], np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    if (col < 0).any():
        row = np.repeat(np.arange(len(y), dtype=np.int32), lengths)
        x = Rows(counts(row[col >= 0], len(y)), col[col >= 0], width)
        del row
    else:
        x = Rows(lengths, col, width)
    del col

    # Only texts that name a group have counterfactuals.
    at = {n: i for i, n in enumerate(names)}
    terms = {t for kind in identity for t in kind}
    named = np.isin(flat, [c for c in range(len(words)) if words[c] in terms])
    parts = []
    for r in np.unique(np.searchsorted(starts, np.flatnonzero(named), "right") - 1):
        own = {words[c] for c in flat[starts[r] : starts[r + 1]]}
        for other in swaps(own, identity):
            gone, come = ([at[w] for w in sorted(part) if w in at] for part in (own - other, other - own))
            if gone or come:
                parts.append((gone + come, [1.0] * len(gone) + [-1.0] * len(come)))
    joined = lambda k, kind: np.array([v for p in parts for v in p[k]], dtype=kind)
    d = Rows(np.array([len(p[0]) for p in parts], np.int64), joined(0, np.int64), width, joined(1, float))

    pos, all_ = x.back(y), x.back(np.ones(len(y)))
    scale = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((all_ - pos + 0.5) / (len(y) - y.sum() + 1))
    w, b = np.zeros(width), prior
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w * scale) + b, -30, 30)))
        g = x.back((p - y) / len(y))
        if d.n:
            g += 2 * penalty / d.n * d.back(d.times(w * scale))
        g = np.append(g * scale + 2 * ridge * w, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model({n: float(x) for n, x in zip(names, w * scale, strict=True) if abs(x) > 1e-6}, float(b))


def known_words(found: DataFrame, *, identity=IDENTITY, least: int = 3, most_words: int = 100_000) -> list[str]:
    """In order, the words of `found` (w: array of distinct words) that a fit may weigh, and the
    identity terms however rare: these tell which texts have counterfactuals."""
    counted = found.select(F.explode("w").alias("w")).groupBy("w").count()
    weighed = counted.where(F.col("count") >= least).orderBy(F.desc("count"), "w").limit(most_words)
    named = counted.where(F.col("w").isin([t for kind in identity for t in kind]))
    return sorted(weighed.union(named).select("w").distinct().toArrow()["w"].to_pylist())


def with_codes(found: DataFrame, names: list[str]) -> DataFrame:
    """Add `codes`: the places in `names` of the words that are there, in the order of `w`."""
    shared = found.sparkSession.sparkContext.broadcast(names)

    @F.arrow_udf("array<int>")
    def codes(words: pa.Array) -> pa.Array:
        at = pc.index_in(words.flatten(), value_set=pa.array(shared.value, words.type.value_type)).fill_null(-1).to_numpy()
        row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        ends = np.cumsum(np.bincount(row[at >= 0], minlength=len(words)))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(at[at >= 0], pa.int32()))

    return found.withColumn("codes", codes("w"))


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, *, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 12_000, **options) -> Model:
    """Fit on labelled rows of `docs` for which `use` holds, `sample` at most.

    The drawn labels are bounded by `sample`, so they are broadcast to the texts; the texts stay
    where they are. Their distinct words are written once and counted there, and the driver gets the
    words it may weigh and a number per text and such word, not the words of every text.
    """
    labels = labels.select(F.col(id).alias("__id"), F.col(label).cast("int").alias("__y")).where("__id IS NOT NULL AND __y IS NOT NULL")
    if use is not None:
        labels = labels.withColumn(id, F.col("__id")).where(use).drop(id)
    n = labels.count()
    drawn = labels.where(F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 0.9 * sample / max(1, n)))) if n > sample else labels
    drawn = drawn.limit(sample)

    @F.arrow_udf("array<string>")
    def words(texts: pa.Array) -> pa.Array:
        return pa.array((sorted(distinct_words(x.as_py())) for x in texts), pa.list_(pa.string()))

    rows = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(drawn), "__id")
    found = through_table(rows.select("__id", "__y", words("__text").alias("w")), "labelled-words")
    names = known_words(found, **{k: options[k] for k in ("identity", "least", "most_words") if k in options})
    table = with_codes(found, names).select("__id", "__y", "codes").toArrow()
    order = pc.sort_indices(table, sort_keys=[("__id", "ascending"), ("__y", "ascending")]).to_numpy()
    labelled, lists = table["__y"].to_numpy()[order], table["codes"].chunks
    del table
    lengths = np.concatenate([np.zeros(0, np.int64), *(pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in lists)]).astype(np.int64)
    numbers = np.concatenate([np.zeros(0, np.int32), *(x.flatten().to_numpy(zero_copy_only=False) for x in lists)]).astype(np.int32, copy=False)
    del lists
    flat, starts, at = np.empty_like(numbers), np.concatenate([[0], np.cumsum(lengths)]), 0
    for row in order:
        flat[at : at + lengths[row]] = numbers[starts[row] : starts[row + 1]]
        at += lengths[row]
    del numbers
    return fit_codes(flat, lengths[order], names, labelled, **options)


def with_score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability, from 0 to 1, that the whole text would be labelled toxic."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        logit = shared.value.logit
        logits = np.array([logit(distinct_words(x.as_py())) for x in texts], dtype=float)
        return pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500))))

    return df.withColumn(out, score(F.col(text)))
