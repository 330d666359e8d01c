"""Packing documents into training windows by an order-preserving dynamic program.

Documents become token ids with an end id after each, and follow one another in the order of
their ids. Where that stream is cut into windows is chosen by

    best(j) = penalty(j) + min over i of best(i) + padding(j - i),   j - window <= i < j

`padding` is what fills a window up to its full size; a window whose length is a power of two
is not filled. `penalty` is what a cut breaks: nothing between documents, little between
sentences, more inside a sentence; opening a window costs a little too, so that short windows of
a power of two are made where they save padding, not for nothing. For lengths that are filled, padding(j - i) is
window - j + i, so the best i is the least best(i) + i among the places in reach: a monotone
queue gives it in constant time. The powers of two are a handful of single transitions beside it.

Places to cut are the ends of documents and sentences, every `stride` ids where a stretch has
none, and every id in the last two windows of a stretch, where a rest can so be cut in powers
of two.

The stream is cut into stretches of about `stretch` ids by exact running totals, one task plans
one stretch from lengths and places alone, and the plan meets the written ids in one join. So
ids are shuffled once, texts never, and no task holds more than some stretches.

Defined results: a null text is empty and gives the end id alone; a null id comes first;
repeated rows are documents of their own; other columns play no part; an empty table gives no
rows. The text is encoded whole, whatever its length; special strings inside it are what the
library makes of them. Reruns over the same files give the same windows.
"""

from __future__ import annotations

import json
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scarpline.operators.prefix import running_totals
from scarpline.session import scratch_path

from .token_counts import PLAIN, byte_letters

#: Penalties in ids of padding: a cut between sentences, inside a sentence, and any window.
SENTENCE, INSIDE, OPENING = 1, 8, 4
#: The byte-level pre-tokenizer's own pattern, less its one look-ahead: a run of white space ends
#: before its last character where a word follows. Texts are cut there beforehand, if ever.
PRETOKEN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
LONG_WHITE, BEFORE_ITS_LAST = regex.compile(r"\s\s"), regex.compile(r"(?V1)(?<=\s)(?=\s\S)")
STOPS = regex.compile(r"[.!?…。！？][\"'”’)\]]*$")


# ---------------------------------------------------------------- ids


class Encoder:
    """Texts -> ids, as the library that owns the vocabulary file gives them.

    Texts whose letters every version of Unicode cuts alike go through tiktoken over the same
    vocabulary: with ids in the order of the merges, and each token made by its own merges,
    merging the pair whose union has the least id is merging by rank. Others go to the library.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        letters = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.cut_and_merged = tiktoken.Encoding("merged", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        size = 1 + max([*ranks.values(), *(t["id"] for t in spec["added_tokens"])])
        self.stops, self.opens, self.breaks = (np.zeros(size, bool) for _ in range(3))
        for token, i in ranks.items():
            text = token.decode("utf-8", "ignore")
            self.stops[i] = bool(STOPS.search(text))
            self.opens[i] = text[:1].isspace()
            self.breaks[i] = text.endswith("\n")

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def merged(self, text: str) -> np.ndarray:
        if not LONG_WHITE.search(text):
            return self.cut_and_merged(text)
        return np.concatenate([self.cut_and_merged(part) for part in BEFORE_ITS_LAST.split(text)])

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        if not PLAIN.fullmatch(text):
            return self.encode(text)
        if self.special is None or not self.special.search(text):
            return self.merged(text)
        return np.concatenate([self.encode(part) if i % 2 else self.merged(part) for i, part in enumerate(self.special.split(text))])

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Places after which a sentence or line of the text is over, its own end left out."""
        if len(ids) < 2:
            return np.zeros(0, np.int64)
        return 1 + np.flatnonzero((self.stops[ids[:-1]] & self.opens[ids[1:]]) | self.breaks[ids[:-1]])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def largest_id(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])


# ---------------------------------------------------------------- the dynamic program


def places_to_cut(sizes: np.ndarray, inner: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a stretch of documents, ascending from 1, and the penalty of cutting there.

    `inner` are the places between sentences, counted from the stretch's first id."""
    after = np.cumsum(sizes)
    total = int(after[-1])
    cost = np.full(total + 1, INSIDE, np.int8)
    cost[inner] = SENTENCE
    cost[after] = 0
    cut = cost < INSIDE
    known = np.flatnonzero(cut)
    gaps = np.diff(known, prepend=0)
    for i in np.flatnonzero(gaps > stride):
        cut[known[i] - gaps[i] + stride : known[i] : stride] = True
    cut[max(1, total - 2 * window) :] = True
    cut[0] = False
    places = np.flatnonzero(cut)
    penalty = cost[places].astype(np.int64)
    return places, penalty


def choose_cuts(places: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """The places at which the windows of least total cost end; the last place is one of them.

    `places` ascend from 1, no two neighbours further apart than a window."""
    starts = np.concatenate([[0], places])
    # Transitions of a power of two between two places, found for all places at once.
    index = np.full(int(starts[-1]) + 1, -1, np.int32)
    index[starts] = np.arange(len(starts))
    after, before = [], []
    for k in range(window.bit_length()):
        from_ = np.searchsorted(starts, 1 << k)
        found = index[starts[from_:] - (1 << k)]
        after.append(from_ + np.flatnonzero(found >= 0))
        before.append(found[found >= 0])
    after, before = np.concatenate(after), np.concatenate(before)
    order = np.argsort(after, kind="stable")
    after, before = [*after[order].tolist(), -1], before[order].tolist()

    at, cost = starts.tolist(), (penalty + OPENING).tolist()
    best, back = [0] * len(at), [0] * len(at)
    # The queue: keys best(i) + i and their i, both ascending, from `head` on.
    keys, holds, head, edge = [0], [0], 0, 0
    for j in range(1, len(at)):
        here = at[j]
        while at[holds[head]] < here - window:
            head += 1
        i = holds[head]
        value = keys[head] + window - here
        while after[edge] == j:
            if best[before[edge]] < value:
                i = before[edge]
                value = best[i]
            edge += 1
        value += cost[j - 1]
        best[j], back[j] = value, i
        value += here
        while len(keys) > head and keys[-1] >= value:
            keys.pop()
            holds.pop()
        keys.append(value)
        holds.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def pieces_of(sizes: np.ndarray, cuts: list[int]) -> tuple[np.ndarray, ...]:
    """(document, start, length, window, offset) of each piece of documents laid end to end."""
    after = np.cumsum(sizes)
    ends = np.unique(np.concatenate([after, cuts]))
    begins = np.concatenate([[0], ends[:-1]])
    doc = np.searchsorted(after, begins, side="right")
    window = np.searchsorted(cuts, begins, side="right")
    opened = np.concatenate([[0], cuts])[window]
    return doc, begins - (after - sizes)[doc], ends - begins, window, begins - opened


# ---------------------------------------------------------------- the operator

PLAN = "key bigint, pieces array<struct<start:int,length:int,sequence_id:bigint,offset:int>>"


def pack(
    df: DataFrame, path: str, *, id: str = "doc_id", text: str = "text", window: int = 2048, end: int = 1,
    stretch: int = 1 << 20, stride: int = 64,
) -> DataFrame:
    """One row per piece: the id column, start, length, ids (little-endian 32-bit), doc_tokens,
    sequence_id, offset.

    `path` is a byte-level vocabulary file on every machine, `end` the id that closes each
    document, `window` the most ids of a sequence. `stretch` bounds what is planned together;
    it and `stride` decide which of the good packings is taken, never what is packed.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")

    kind = np.dtype("<u2" if max(end, largest_id(path)) < 1 << 16 else "<u4")

    @F.arrow_udf("struct<ids:binary, n:int, ends:array<int>>")
    def encoded(texts: pa.Array) -> pa.Array:
        coder, close = encoder(path), np.array([end], np.uint32)
        ids, n, ends = [], [], []
        for x in texts:
            own = coder.ids(x.as_py() or "")
            ids.append(np.concatenate([own, close]).astype(kind).tobytes())
            n.append(len(own) + 1)
            ends.append(np.diff(coder.sentence_ends(own), prepend=0))
        offsets = np.cumsum([0, *map(len, ends)])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*ends, np.zeros(0, np.int64)]), pa.int32()))
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(n, pa.int32()), lists], ["ids", "n", "ends"])

    docs = df.select(F.col(id).cast("bigint").alias("doc"), F.monotonically_increasing_id().alias("key"), encoded(F.col(text)).alias("e"))
    docs = docs.select("doc", "key", "e.*")
    stored = scratch_path(df.sparkSession, "encoded")
    docs.write.option("compression", "zstd").parquet(stored)
    docs = df.sparkSession.read.schema(docs.schema).parquet(stored)

    # Where each document lies in the whole order. An id that very many rows share is dealt
    # over as many stretches as its rows fill.
    place = F.coalesce("doc", F.lit(-(1 << 63)))
    sizes = docs.groupBy(place.alias("place")).agg(F.sum("n").alias("n"))
    order = running_totals(sizes, "place", ["n"])
    parts = F.ceil(F.col("total") / stretch)
    order = order.select("place", F.col("n").alias("total"), F.floor(F.col("before_n") / stretch).alias("first"))
    lengths = docs.select(place.alias("place"), "key", "n", "ends").join(order, "place")
    lengths = lengths.withColumn("stretch", F.col("first") + F.pmod(F.xxhash64("key"), parts))

    def plan(group: pa.Table) -> pa.Table:
        group = group.sort_by([("place", "ascending"), ("key", "ascending")])
        n = group["n"].to_numpy().astype(np.int64)
        ends = group["ends"].combine_chunks()
        # Distances between sentence ends, document by document -> places in the stretch.
        at = ends.offsets.to_numpy() - ends.offsets[0].as_py()
        run = np.concatenate([[0], np.cumsum(ends.flatten().to_numpy().astype(np.int64))])
        inner = run[1:] + np.repeat(np.cumsum(n) - n - run[at[:-1]], np.diff(at))
        doc, start, length, local, offset = pieces_of(n, choose_cuts(*places_to_cut(n, inner, window, stride), window))
        sequence = (int(group["stretch"][0].as_py()) << 32) + local
        each = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int32())], ["start", "length", "sequence_id", "offset"])
        lists = pa.ListArray.from_arrays(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32), each)
        return pa.table({"key": group["key"].combine_chunks(), "pieces": lists})

    planned = lengths.select("stretch", "place", "key", "n", "ends").groupBy("stretch").applyInArrow(plan, PLAN)

    @F.arrow_udf("array<binary>")
    def sliced(ids: pa.Array, pieces: pa.Array) -> pa.Array:
        # A document's pieces follow one another, so all ids in a row are the parts in a row.
        ends = np.cumsum(4 * pieces.flatten().field("length").to_numpy(zero_copy_only=False).astype(np.int64))
        raw = np.frombuffer(b"".join(ids.to_pylist()), kind).astype("<u4")
        borders = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64))
        parts = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, borders, pa.py_buffer(raw)])
        offsets = pieces.offsets.to_numpy()
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), parts).cast(pa.list_(pa.binary()))

    met = docs.select("doc", "key", "ids", "n").join(planned, "key")
    met = met.select("doc", "n", "pieces", sliced("ids", "pieces").alias("parts"))
    rows = met.select("doc", "n", F.explode(F.arrays_zip("pieces", "parts")).alias("p"))
    return rows.select(
        F.col("doc").alias(id),
        F.col("p.pieces.start").cast("bigint").alias("start"),
        F.col("p.pieces.length").cast("bigint").alias("length"),
        F.col("p.parts").alias("ids"),
        F.col("n").cast("bigint").alias("doc_tokens"),
        F.col("p.pieces.sequence_id").alias("sequence_id"),
        F.col("p.pieces.offset").cast("bigint").alias("offset"),
    )


def sequences(pieces: DataFrame, window: int = 2048, id: str = "doc_id") -> DataFrame:
    """One row per sequence: sequence_id, ids (little-endian, unpadded), n_tokens, padding and
    the spans (id, start, length, offset) of its pieces. A sequence is at most a window."""
    part = F.struct("offset", "start", "length", F.col(id), "ids")
    rows = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum("length").alias("n_tokens"))
    power = F.expr("n_tokens & (n_tokens - 1)") == 0
    return rows.select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"),
        "n_tokens",
        F.when(power, 0).otherwise(window - F.col("n_tokens")).alias("padding"),
        F.transform("parts", lambda p: F.struct(p[id].alias(id), p["start"].alias("start"), p["length"].alias("length"), p["offset"].alias("offset"))).alias("spans"),
    )
