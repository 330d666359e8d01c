"""Maximal repetitions of words by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q that is at least `power` periods and `least`
words long and that no neighbouring word extends. They are found as follows:

* The words' suffix automaton is built; its suffix links are a tree in which the ancestors of
  the state of a prefix are that prefix's suffixes.
* Every state is coloured with the place where its strings occurred last. When word i is
  appended, the path from the prefix's state to the root takes the colour i. The tree is kept
  in paths of equal colour, each a splay tree; `access` goes up path by path and recolours,
  which costs a logarithmic number of colour changes on average.
* A path segment met on the way, of last end r and longest string L, says that the L words
  before r are also the L words before i, and that no longer ones are: with d = i - r <= L the
  last L + d words have period d, begin exactly where that period begins, and d is their
  smallest period (a smaller one would be a later occurrence). Such a square is a run as soon
  as the next word breaks the period; its length is L + d.

Only words that a run can contain go into an automaton. In a run of at least four periods and
six words every three neighbouring words occur three times or more, so a text is first cut,
without loss, into the stretches all of whose three-word windows do. Other texts than those
with such runs leave nothing, and a stretch holds a run or it does not, with its boundaries.

One narrow pass without a shuffle. Memory is that of the longest such stretch of one text.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; a null text has none; a text without runs has
an empty list and is only joined anew by single spaces; other columns, repeated rows and null
ids pass through; an input column named like an output is replaced.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = "struct<start:bigint,length:bigint,period:bigint>"


# ---------------------------------------------------------------- the automaton


def suffix_automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(link, longest length, state of each prefix) over states from 1; the root is 1."""
    link, size, after = [0, 0], [0, 0], [None, {}]
    prefix, last = [], 1
    for c in word:
        state = len(link)
        link.append(1)
        size.append(size[last] + 1)
        after.append({})
        p = last
        while p and c not in after[p]:
            after[p][c] = state
            p = link[p]
        if p:
            q = after[p][c]
            if size[q] == size[p] + 1:
                link[state] = q
            else:
                clone = len(link)
                link.append(link[q])
                size.append(size[p] + 1)
                after.append(dict(after[q]))
                link[q] = link[state] = clone
                while p and after[p].get(c) == q:
                    after[p][c] = clone
                    p = link[p]
        prefix.append(state)
        last = state
    return link, size, prefix


def squares(word: list[int], least_periods: int):
    """(end, longest repeated length, distance) of the squares that end at each word, at least
    `least_periods` distances long: the segments that `access` meets and recolours."""
    link, size, prefix = suffix_automaton(word)
    n = len(link)
    up = link  # parent inside a splay tree, or above it the node its path hangs from
    left, right = [0] * n, [0] * n  # towards the root of the links, and away from it
    colour = [0] * n  # of a splay tree's root: where the strings of its path ended last
    fewer = least_periods - 1

    def rotate(x: int, p: int) -> None:
        g = up[p]
        if left[p] == x:
            b = right[x]
            left[p] = b
            right[x] = p
        else:
            b = left[x]
            right[p] = b
            left[x] = p
        if b:
            up[b] = p
        up[p] = x
        up[x] = g
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x

    for end, state in enumerate(prefix, 1):
        deeper, x = 0, state
        while x:
            # Splay x to the root of its path's tree, which carries the path's colour.
            while True:
                p = up[x]
                if not p or (left[p] != x and right[p] != x):
                    break
                g = up[p]
                if g and (left[g] == p or right[g] == p):
                    colour[x] = colour[g]
                    if (left[g] == p) == (left[p] == x):
                        rotate(p, g)
                        rotate(x, p)
                    else:
                        rotate(x, p)
                        rotate(x, g)
                else:
                    colour[x] = colour[p]
                    rotate(x, p)
            past = colour[x]
            if past:
                distance = end - past
                if size[x] >= fewer * distance:
                    yield end, size[x], distance
            # What lies below x stays a path of its own, of the old colour.
            below = right[x]
            if below:
                colour[below] = past
            right[x] = deeper
            deeper, x = x, up[x]
        colour[deeper] = end


def runs_of(word: list[int], least: int, power: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence, by start, then period."""
    n, found = len(word), []
    for end, length, period in squares(word, power):
        length += period
        if length >= least and (end == n or word[end] != word[end - period]):
            found.append((end - length, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


# ---------------------------------------------------------------- whole texts

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _frequent(codes: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of a sequence in which every three-word window may occur three times.

    Windows are counted by the high bits of a hash, over eight places a word: equal windows
    share a place, so none that occurs three times is missed."""
    windows = codes[:-2] * ODD[0] + codes[1:-1] * ODD[1] + codes[2:] * ODD[2]
    windows ^= windows >> np.uint64(29)
    windows *= ODD[0]
    place = (windows >> np.uint64(64 - (8 * len(codes)).bit_length())).astype(np.int64)
    often = np.bincount(place)[place] >= 3
    edges = np.flatnonzero(np.diff(often, prepend=False, append=False))
    return [(int(a), int(b) + 2) for a, b in edges.reshape(-1, 2) if b - a >= 4]


def stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """Where runs of four periods and six words can lie; each lies in one of them whole."""
    if len(words) < 6:
        return []
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    todo, done = [(0, len(words))], []
    while todo:
        a, b = todo.pop()
        inner = _frequent(codes[a:b])
        if inner == [(0, b - a)]:
            done.append((a, b))
        else:
            todo += [(a + i, a + j) for i, j in inner]
    return sorted(done)


def find_runs(words: list[bytes], least: int = 6, power: int = 4) -> list[tuple[int, int, int]]:
    found = []
    for a, b in stretches(words) if least >= 6 and power >= 4 else [(0, len(words))]:
        ids: dict[bytes, int] = {}
        inner = [ids.setdefault(w, len(ids)) for w in words[a:b]]
        found += [(a + start, length, period) for start, length, period in runs_of(inner, least, power)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def strongest(found: list[tuple[int, int, int]]) -> int | None:
    """Which run has most periods; ties: the smallest start, then period."""
    return max(range(len(found)), key=lambda i: (Fraction(found[i][1], found[i][2]), -found[i][0], -found[i][2]), default=None)


def with_runs(df: DataFrame, text: str = "text", least: int = 6, power: int = 4) -> DataFrame:
    """Add `n_words`, `runs` (start, length, period in words, by start, then period), `strongest`
    (the run of most periods) and `collapsed` (the text with each run cut to one period).

    `least` is the fewest words and `power` the fewest periods of a run, two at least.
    """
    if power < 2:
        raise ValueError("a run repeats its period")

    @F.arrow_udf(f"struct<n_words:bigint, runs:array<{RUN}>, strongest:{RUN}, collapsed:string>")
    def search(texts: pa.Array) -> pa.Array:
        n, runs, best, kept = [], [], [], []
        names = ("start", "length", "period")
        for x in texts:
            words = (x.as_py() or "").encode().split()
            found = find_runs(words, least, power)
            n.append(len(words))
            runs.append([dict(zip(names, r, strict=True)) for r in found])
            top = strongest(found)
            best.append(None if top is None else runs[-1][top])
            kept.append(b" ".join(collapse(words, found)).decode())
        one = pa.struct([(name, pa.int64()) for name in names])
        arrays = [pa.array(n, pa.int64()), pa.array(runs, pa.list_(one)), pa.array(best, one), pa.array(kept, pa.string())]
        return pa.StructArray.from_arrays(arrays, ["n_words", "runs", "strongest", "collapsed"])

    fields = ("n_words", "runs", "strongest", "collapsed")
    found = df.withColumn("__runs", search(F.col(text)))
    return found.withColumns({f: F.col(f"__runs.{f}") for f in fields}).drop("__runs")
