"""Language-model scores from Brown classes: class transitions times word emissions.

A text is its words, A-Z in lower case, and one end. Over the training texts

    P(text) = product of P(class of token | class of the token before) * P(token | its class)

where the token before the first is an end. Everything is counted over all training texts:

* Texts are written once as codes: the place of each token in a dictionary of up to `frequent`
  words, drawn from about `drawn` texts, or else the word itself. The dictionary only says how
  texts are stored; all words are then counted over all texts. No later pass reads a text.
* Exchange clustering. The `units` most frequent words of all training texts (the end among them;
  those the draw missed get a code, and the texts are coded anew) are moved one by one, round after
  round, to the class that raises the likelihood of the class transitions most. Their bigram counts, at most units^2 numbers at any size of the corpus, are one table
  on the driver, so each move sees its neighbours' classes as they are; all other words are one
  more unit with a class of its own. The likelihood rises with every move, and rounds stop
  when a round moves nothing or hardly raises it.
* Every other word that occurs `least` times or more gets the class that its own contexts make
  likeliest, given the classes of the units before and after its occurrences: occurrences are
  gathered by word in parallel, a byte or two each, and scored against the class transitions.
* Rarer and unseen words have the class of their ending: that of most tokens of the classed
  words that end alike, or of most tokens at all.
* Words outside the dictionary meet their counts and classes in one join; from then on a
  text is a string of class numbers, from which transitions are counted and texts scored.

Emissions are smoothed by `add` per word of the class and one unseen word, transitions toward
the class's share by `pull`. With no training text every count is zero and the scores follow
from the smoothing alone.

Defined results: a null text is an empty one, an end alone; repeated rows and null ids stay,
each row is scored by itself; a null held-out mark is false. Columns may have any name: those
called like an output are replaced, all others pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scarpline.session import scratch_path, through_table

END = b""
RARE = 0xFFFF  # the code of a word that stands beside the codes
SPARSE = 96  # occurrences of a word in a task up to which its contexts are listed, not counted
BUCKETS = 4096  # words share a bucket of contexts; raised with the vocabulary
OUT = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def texts_of(batches, column: int = 0) -> Iterator[bytes | None]:
    for batch in batches:
        for x in batch.column(column).cast(pa.binary()):
            yield x.as_py()


# ---------------------------------------------------------------- counts and codes


def dictionary(texts: DataFrame, frequent: int, drawn: int) -> list[bytes]:
    """The end, then the most frequent words of about `drawn` texts, drawn by a hash of the text."""
    share = min(1.0, drawn / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64("__text"), F.lit(1 << 20)) < int(share * (1 << 20))).select("__text")

    def count(batches):
        found: Counter = Counter()
        for text in texts_of(batches):
            found.update(tokens(text))
        yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "c"])

    counts = some.mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))
    most = min(frequent, RARE)
    top = counts.orderBy(F.desc("c"), "word").limit(most).collect()
    return [END, *(w for w in (bytes(r.word) for r in top) if w != END)][:most]


def coded(df: DataFrame, text: str, words: list[bytes]) -> DataFrame:
    """In place of the text: `codes` (16 bits a token), `rare` (the different words behind the code
    RARE, as they come up) and `at` (32 bits for each such token: its place among `rare`)."""
    shared = df.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    @F.arrow_udf("struct<codes:binary, at:binary, rare:array<binary>>")
    def encode(texts: pa.Array) -> pa.Array:
        get, codes, at, rare, offsets = shared.value.get, [], [], [], [0]
        for x in texts.cast(pa.binary()):
            found = tokens(x.as_py())
            own = np.fromiter(map(get, found, repeat(RARE)), np.uint16, len(found))
            local: dict[bytes, int] = {}
            at.append(np.array([local.setdefault(found[i], len(local)) for i in np.flatnonzero(own == RARE)], np.uint32).tobytes())
            codes.append(own.tobytes())
            rare += local
            offsets.append(len(rare))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rare, pa.binary()))
        return pa.StructArray.from_arrays([pa.array(codes, pa.binary()), pa.array(at, pa.binary()), lists], ["codes", "at", "rare"])

    return df.withColumn("__e", encode(F.col(text).cast("string"))).select(*[c for c in df.columns if c != text], "__e.*")


def flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of binaries in a row, and where each row's begin (and the end)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw.view(kind) if raw.ctypes.data % np.dtype(kind).itemsize == 0 else np.frombuffer(raw.tobytes(), kind), (offsets - offsets[0]) // np.dtype(kind).itemsize


def rare_places(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """(the rare words of all rows, for each token behind RARE its place among them)."""
    rare = batch["rare"]
    rare = rare.combine_chunks() if isinstance(rare, pa.ChunkedArray) else rare
    begins = rare.offsets.to_numpy()
    at, row = flat(batch["at"], np.uint32)
    return rare.flatten(), at + np.repeat(begins[:-1] - begins[0], np.diff(row))


def word_counts(codes: DataFrame, words: list[bytes]) -> DataFrame:
    """(word binary, c): how often each token occurs in the training texts; 0 where it does only in others."""
    shared = codes.sparkSession.sparkContext.broadcast(words)
    schema = "word binary, c bigint"

    def count(batches):
        sums = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            learns = batch["__train"].to_numpy(zero_copy_only=False)
            own, row = flat(batch["codes"], np.uint16)
            kept = own[np.repeat(learns, np.diff(row))]
            sums += np.bincount(kept[kept != RARE], minlength=len(sums))
            rare, place = rare_places(batch)
            n = np.bincount(place, minlength=len(rare)) * np.repeat(learns, np.diff(batch["rare"].offsets.to_numpy()))
            yield pa.record_batch([rare.cast(pa.binary()), pa.array(n.astype(np.int64))], ["word", "c"])
        yield pa.record_batch([pa.array(shared.value, pa.binary()), pa.array(sums)], ["word", "c"])

    return codes.select("codes", "at", "rare", "__train").mapInArrow(count, schema).groupBy("word").agg(F.sum("c").alias("c"))


# ---------------------------------------------------------------- classes of the frequent words


def unit_bigrams(texts: DataFrame, unit_of: np.ndarray) -> np.ndarray:
    """[before, after] counts over coded texts. `unit_of` gives the unit of a code; the last unit is
    that of all other words. Code 0 is the end, which closes every text and so stands before the next."""
    side = int(unit_of.max()) + 1
    shared = texts.sparkSession.sparkContext.broadcast(unit_of)

    def tally(batches):
        sums = np.zeros(side * side, np.int64)
        for batch in batches:
            line = shared.value[np.concatenate([np.zeros(1, np.uint16), flat(batch["codes"], np.uint16)[0]])]
            cells, n = np.unique(line[:-1] * side + line[1:], return_counts=True)
            sums[cells] += n
        at = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(at), pa.array(sums[at])], ["cell", "n"])

    found = texts.select("codes").mapInArrow(tally, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(side * side, np.int64)
    sums[found["cell"].to_numpy()] = found["n"].to_numpy()
    return sums.reshape(side, side)


def _f(x):
    return x * np.log(np.maximum(x, 1))


def likelihood(bigrams: np.ndarray, classes: np.ndarray, count: int) -> float:
    """Of the class transitions, less the part that no assignment changes."""
    table = np.zeros((count, count))
    np.add.at(table, (classes[:, None], classes[None, :]), bigrams)
    return float(_f(table).sum() - _f(table.sum(1)).sum() - _f(table.sum(0)).sum())


def exchange(bigrams: np.ndarray, classes: np.ndarray, count: int, fixed: int = 1, rounds: int = 40, least_gain: float = 1e-5) -> tuple[np.ndarray, list[float], list[int]]:
    """Move units between classes 0 .. count - 1, one at a time, each where the likelihood is
    highest, until a round moves none or raises it by less than `least_gain` of itself.

    The last `fixed` units stay in classes of their own, after the others. Gives the classes, the
    likelihood after each round (the first is the start's) and how many units moved."""
    classes, n = classes.copy(), len(bigrams)
    classes[n - fixed :] = count + np.arange(fixed)
    total = count + fixed
    counts = bigrams.astype(np.float64)
    one = np.zeros((n, total))
    one[np.arange(n), classes] = 1
    after, before = counts @ one, counts.T @ one  # [unit, class]: neighbours by class
    table = one.T @ after
    rises, moved = [likelihood(bigrams, classes, total)], []
    for _ in range(rounds):
        moves = 0
        for u in np.argsort(-after[: n - fixed].sum(1), kind="stable"):
            a, own = classes[u], counts[u, u]
            r, c = after[u].copy(), before[u].copy()
            if not r.any() and not c.any():
                continue
            r[a] -= own
            c[a] -= own  # neighbours other than itself
            table[a] -= r
            table[:, a] -= c
            table[a, a] -= own
            out, into = table.sum(1) + c, table.sum(0) + r  # what stays there, wherever the unit goes
            rows, columns, square = _f(table + r) - _f(table), _f(table + c[:, None]) - _f(table), np.diag(table)
            gain = rows.sum(1) + columns.sum(0) - np.diag(rows) - np.diag(columns) + _f(square + r + c + own) - _f(square)
            gain -= _f(out + r.sum() + own) - _f(out) + _f(into + c.sum() + own) - _f(into)
            b = int(np.argmax(gain[:count]))
            if gain[b] <= gain[a] + 1e-9 * max(1.0, abs(gain[a])):
                b = a
            table[b] += r
            table[:, b] += c
            table[b, b] += own
            if b != a:
                moves += 1
                classes[u] = b
                after[:, a] -= counts[:, u]
                after[:, b] += counts[:, u]
                before[:, a] -= counts[u]
                before[:, b] += counts[u]
        rises.append(float(_f(table).sum() - _f(table.sum(1)).sum() - _f(table.sum(0)).sum()))
        moved.append(moves)
        if not moves or rises[-1] - rises[-2] < least_gain * abs(rises[-1]):
            break
    return classes, rises, moved


# ---------------------------------------------------------------- classes of all other words


def context_weights(bigrams: np.ndarray, classes: np.ndarray, count: int, fixed: int = 1) -> np.ndarray:
    """[context, class] in whole millionths: what a neighbour adds to the log likelihood of a word's
    class. Context k is a unit of class k before the word, count + k one after it."""
    table = np.full((count + fixed, count + fixed), 0.5)
    np.add.at(table, (classes[:, None], classes[None, :]), bigrams)
    inner = table[:count, :count]
    before = np.log(inner / table.sum(0)[:count])  # of the class before, given the word's
    after = np.log(inner.T / table.sum(1)[:count])
    return np.rint(1e6 * np.concatenate([before, after])).astype(np.int64)


def word_classes(texts: DataFrame, words: list[bytes], unit_of: np.ndarray, classes: np.ndarray, weights: np.ndarray, distinct: int) -> DataFrame:
    """(word, k): for each word of coded texts that is no unit, the class its contexts make likeliest.

    A task sends each of its words with its contexts listed or, if they are many, counted. So a
    bucket of words holds a bounded number of bytes per word and task."""
    units, contexts = len(classes) - 1, len(weights)
    count = contexts // 2
    class_of = classes[unit_of]  # `count` for codes that are no unit, RARE's among them
    shared = texts.sparkSession.sparkContext.broadcast((words, unit_of, class_of, weights))

    def gather(batches):
        names, unit, of, _ = shared.value
        local: dict[bytes, int] = {}
        ids, found, held = [], [], 0
        for batch in batches:
            own, _ = flat(batch["codes"], np.uint16)
            rare, place = rare_places(batch)
            mine = np.fromiter((local.setdefault(w, len(local)) for w in rare.to_pylist()), np.int64, len(rare))
            word = own.astype(np.int64)
            word[own == RARE] = RARE + 1 + mine[place]
            # An end closes the text before; nothing known follows the last end.
            k = np.concatenate([of[:1], of[own], [count]])
            spot = np.flatnonzero(unit[own] == units)
            for shift, base in ((0, 0), (2, count)):
                near = k[spot + shift]
                met = near < count
                ids.append(word[spot[met]])
                found.append((near[met] + base).astype(np.uint8))
            held += 2 * len(spot)
            if held > 1 << 23:
                yield from pack(names, local, ids, found)
                local, ids, found, held = {}, [], [], 0
        yield from pack(names, local, ids, found)

    def pack(names, local, ids, found):
        ids, found = np.concatenate([*ids, np.zeros(0, np.int64)]), np.concatenate([*found, np.zeros(0, np.uint8)])
        order = np.argsort(ids, kind="stable")
        ids, found = ids[order], found[order]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        ends = np.append(first[1:], len(ids))[: len(first)]
        own = ids[first]
        every = pa.array([*names, *local], pa.binary())
        word = every.take(pa.array(np.where(own > RARE, own - RARE - 1 + len(names), own)))
        few = ends - first <= 4 * SPARSE
        # The contexts of the words lie one after the other: they are the listed bytes as they are.
        listed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first, len(ids)).astype(np.int32)), pa.py_buffer(found)])
        yield from pa.table({"word": word.filter(pa.array(few)), "contexts": listed.filter(pa.array(few))}).to_batches(max_chunksize=50_000)
        many = [b"\xff" + np.bincount(found[a:b], minlength=contexts).astype("<i8").tobytes() for a, b in zip(first[~few], ends[~few], strict=True)]
        yield pa.record_batch([word.filter(pa.array(~few)), pa.array(many, pa.binary())], ["word", "contexts"])

    sent = texts.select("codes", "at", "rare").mapInArrow(gather, "word binary, contexts binary")
    buckets = max(16, -(-distinct // BUCKETS))

    def choose(group: pa.Table) -> pa.Table:
        weights = shared.value[3]
        names = group["word"].combine_chunks().dictionary_encode()
        which = names.indices.to_numpy()
        score = np.zeros((len(names.dictionary), count), np.int64)
        flat, owner = [], []
        for w, raw in zip(which.tolist(), group["contexts"].to_pylist(), strict=True):
            if raw[:1] == b"\xff":
                score[w] += np.frombuffer(raw, "<i8", offset=1) @ weights
            else:
                flat.append(raw)
                owner.append(w)
        cells, owners = np.frombuffer(b"".join(flat), np.uint8), np.repeat(owner, [len(x) for x in flat]).astype(np.int64)
        seen = np.bincount(owners * contexts + cells, minlength=len(score) * contexts).reshape(len(score), contexts)
        score += seen.astype(np.int64) @ weights
        return pa.table({"word": names.dictionary, "k": pa.array(score.argmax(1), pa.int32())})

    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets))
    return sent.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(choose, "word binary, k int")


# ---------------------------------------------------------------- the model


class Model:
    """Every training word with its count and class, the classes of endings, and log tables."""

    def __init__(self, words: DataFrame, frequent: list[bytes], units: list[bytes], table: tuple[np.ndarray, np.ndarray], endings: DataFrame, usual: int, total: int, distinct: int, add: float, length: int):
        self.words, self.frequent, self.units, self.table, self.endings, self.usual = words, frequent, units, table, endings, usual
        self.total, self.distinct, self.add, self.length = total, distinct, add, length
        self.moves = self.emit = None
        self.rises: list[float] = []
        self.moved: list[int] = []


def _ending(length: int) -> Column:
    return F.expr(f"substring(word, -{length}, {length})")


def _written(texts: DataFrame, words: list[bytes]) -> DataFrame:
    """All texts coded, each with a unique `__row`, as a table."""
    path = scratch_path(texts.sparkSession, "coded")
    codes = coded(texts.withColumn("__row", F.monotonically_increasing_id()), "__text", words)
    codes.write.option("compression", "zstd").parquet(path)
    return texts.sparkSession.read.schema(codes.schema).parquet(path)


def _learn_classes(texts: DataFrame, *, frequent: int, drawn: int, classes: int, units: int, least: int, length: int, add: float, rounds: int) -> tuple[Model, DataFrame]:
    """A model without its log tables, and all of `texts` (__text, __train, other columns) coded."""
    spark = texts.sparkSession
    words = dictionary(texts.where("__train"), frequent, drawn)
    codes = _written(texts, words)
    counts = through_table(word_counts(codes, words), "counts")
    top = [bytes(r.word) for r in counts.where("c > 0").orderBy(F.desc("c"), "word").limit(units).collect()]
    top = [END, *(w for w in top if w != END)][: min(units, frequent, RARE)]
    held = set(words)
    if not held.issuperset(top):
        # The draw missed words that are among the most frequent of all texts: they get a code too.
        words = list(dict.fromkeys([*top, *words]))[: min(frequent, RARE)]
        codes = _written(texts, words)
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    place = {w: i for i, w in enumerate(words)}
    within = F.broadcast(spark.createDataFrame([(bytearray(w),) for w in words], "word binary"))  # at most RARE rows
    chosen = np.array([place[w] for w in top])  # the end is a unit always, and the first
    unit_of = np.full(RARE + 1, len(chosen), np.int64)
    unit_of[chosen] = np.arange(len(chosen))
    learned = codes.where("__train")
    bigrams = unit_bigrams(learned, unit_of)
    of, rises, moved = exchange(bigrams, np.arange(len(chosen) + 1) % classes, classes, rounds=rounds)
    found = word_classes(learned, words, unit_of, of, context_weights(bigrams, of, classes), distinct)
    named = [words[i] for i in chosen]
    listed = lambda rows, schema: spark.createDataFrame(rows, schema)
    own = listed([(bytearray(w), int(k)) for w, k in zip(named, of[:-1], strict=True)], "word binary, k int")
    known = counts.join(found.where("word is not null").withColumn("unit", F.lit(False)).unionByName(own.withColumn("unit", F.lit(True))), "word", "left")
    enough = F.col("unit") | (F.col("c") >= least)
    known = through_table(known.select("word", "c", F.when(enough, F.col("k")).alias("k")), "classed")
    votes = known.where("k IS NOT NULL").groupBy(_ending(length).alias("ending"), "k").agg(F.sum("c").alias("n"))
    # One number to choose by: most tokens, then the smaller class.
    endings = through_table(votes.groupBy("ending").agg(F.max_by("k", F.col("n") * 1024 - F.col("k")).alias("ke")), "endings")
    most = votes.groupBy("k").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k").first()
    usual = most.k if most else 0
    every = known.withColumn("ending", _ending(length)).join(endings, "ending", "left")
    every = through_table(every.select("word", "c", F.coalesce("k", "ke", F.lit(usual)).alias("k"), F.col("k").isNotNull().alias("by_context")), "words")
    table = np.zeros(len(words), np.int64), np.full(len(words), usual, np.int64)
    for r in every.join(within, "word", "left_semi").select("word", "c", "k").collect():
        table[0][place[bytes(r.word)]], table[1][place[bytes(r.word)]] = r.c, r.k
    model = Model(every, words, named, table, endings, usual, total, distinct, add, length)
    model.rises, model.moved = rises, moved
    return model, codes


def classed(texts: DataFrame, model: Model, all_known: bool) -> DataFrame:
    """Coded rows with a unique `__row` -> `line` (a class number per token), `seen` (tokens that occur
    in training) and `logs` (the sum of log10(count + add)) in place of the codes.

    all_known: the model's words hold every word of these texts, so that none is looked up by its
    ending here."""
    rare = texts.select("__row", F.posexplode("rare").alias("place", "word"))
    met = rare.join(model.words.select("word", "c", "k"), "word", "left")
    if not all_known:
        # A known word keeps to itself in this join; it would be a hot key otherwise.
        key = F.when(F.col("k").isNull(), _ending(model.length)).otherwise(F.col("word"))
        met = met.withColumn("ending", key).join(model.endings, "ending", "left").withColumn("k", F.coalesce("k", "ke"))
    found = F.struct("place", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("k", F.lit(model.usual)).alias("k"))
    each = met.groupBy("__row").agg(F.collect_list(found).alias("held"))  # the words of one text
    shared = texts.sparkSession.sparkContext.broadcast((model.table, model.add))

    @F.arrow_udf("struct<line:binary, seen:bigint, logs:double>")
    def line(codes: pa.Array, at: pa.Array, held: pa.Array) -> pa.Array:
        (counts, of), add = shared.value
        own, row = flat(codes, np.uint16)
        beside = own == RARE
        inside = np.where(beside, 0, own)
        c, k = counts[inside], of[inside]
        # Each text's rare words in their order: the place within the text, after those before it.
        n = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        begins = np.cumsum(n) - n
        values = held.flatten()
        where = values.field("place").to_numpy(zero_copy_only=False) + np.repeat(begins, n)
        rare_c, rare_k = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        rare_c[where], rare_k[where] = values.field("c").to_numpy(zero_copy_only=False), values.field("k").to_numpy(zero_copy_only=False)
        spot, spots = flat(at, np.uint32)
        spot = spot + np.repeat(begins, np.diff(spots))
        c[beside], k[beside] = rare_c[spot], rare_k[spot]
        some = len(own) > 0
        logs = np.add.reduceat(np.log10(c + add), row[:-1]) if some else np.zeros(0)
        seen = np.add.reduceat((c > 0).astype(np.int64), row[:-1]) if some else np.zeros(0, np.int64)
        lines = pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(row.astype(np.int32)), pa.py_buffer(k.astype(np.uint8))])
        return pa.StructArray.from_arrays([lines, pa.array(seen), pa.array(logs)], ["line", "seen", "logs"])

    rest = [c for c in texts.columns if c not in ("codes", "at", "rare")]
    return texts.drop("rare").join(each, "__row", "left").withColumn("__l", line("codes", "at", "held")).select(*rest, "__l.*")


def transitions(lines: DataFrame, model: Model, classes: int, pull: float) -> None:
    """Set the model's log tables from the class lines of the training texts."""

    def tally(batches):
        sums = np.zeros(classes * classes, np.int64)
        for batch in batches:
            own = flat(batch["line"], np.uint8)[0].astype(np.int64)
            # Every text ends with an end, which so stands before the next text's first token.
            sums += np.bincount(np.concatenate([own[-1:], own[:-1]]) * classes + own, minlength=classes * classes)
        yield pa.record_batch([pa.array(range(classes * classes)), pa.array(sums)], ["cell", "n"])

    found = lines.select("line").mapInArrow(tally, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    moves = np.zeros(classes * classes)
    moves[found["cell"].to_numpy()] = found["n"].to_numpy()
    moves = moves.reshape(classes, classes)
    sizes = np.zeros((2, classes))
    for r in model.words.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        sizes[:, r.k] = r.n, r.v
    share = (sizes[0] + 1) / (sizes[0].sum() + classes)
    model.moves = np.log10((moves + pull * share) / (moves.sum(1, keepdims=True) + pull))
    model.emit = -np.log10(sizes[0] + model.add * (sizes[1] + 1))


def _scored(lines: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    shared = lines.sparkSession.sparkContext.broadcast((model.moves, model.emit))

    @F.arrow_udf("struct<n:bigint, path:double>")
    def path(line: pa.Array) -> pa.Array:
        moves, emit = shared.value
        own, row = flat(line, np.uint8)
        steps = moves[np.concatenate([own[-1:], own[:-1]]), own] + emit[own]
        sums = np.add.reduceat(steps, row[:-1]) if len(own) else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(np.diff(row).astype(np.int64)), pa.array(sums)], ["n", "path"])

    base = float(np.log10(model.total + model.add * (model.distinct + 1)))
    rows = lines.withColumn("__p", path("line"))
    return rows.select(
        *[F.col(f"__row_of.`{c}`").alias(c) for c in columns if c not in OUT],
        F.col("__p.n").alias("n_tokens"),
        F.col("seen").alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("__p.n") * base).alias("base_score"),
        (F.col("logs") + F.col("__p.path")).alias("score"),
    )


SETTINGS = dict(classes=48, units=2048, frequent=65_000, drawn=20_000, least=5, length=3, add=0.1, rounds=40)


def _rows(df: DataFrame, text: str, train: Column, keep: list[str] | None) -> tuple[DataFrame, list[str]]:
    """The text beside one struct of the columns that pass, so that none can clash with another."""
    keep = df.columns if keep is None else keep
    passing = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    return df.select(passing.alias("__row_of"), F.col(f"`{text}`").cast("string").alias("__text"), train.alias("__train")), keep


def train(texts: DataFrame, text: str = "text", pull: float = 20.0, **settings) -> Model:
    """Learn from every text of a frame. `settings`: SETTINGS, by default."""
    settings = SETTINGS | settings
    rows, _ = _rows(texts, text, F.lit(True), [])
    model, codes = _learn_classes(rows, **settings)
    transitions(through_table(classed(codes, model, True), "lines"), model, settings["classes"], pull)
    return model


def with_scores(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Any texts scored by a model: n_tokens, n_known (tokens seen in training), train_tokens (long),
    base_score (word counts alone) and score (log10 probability of the whole text).

    `keep` names the columns that pass, all of them by default; texts are heavy, name few."""
    rows, keep = _rows(df, text, F.lit(False), keep)
    codes = through_table(coded(rows.withColumn("__row", F.monotonically_increasing_id()), "__text", model.frequent), "coded")
    return _scored(classed(codes, model, False), model, keep)


def score_by(df: DataFrame, held_out: Column, text: str = "text", keep: list[str] | None = None, pull: float = 20.0, **settings) -> DataFrame:
    """Train on the rows that are not held out and score all; the texts are coded once for both."""
    settings = SETTINGS | settings
    rows, keep = _rows(df, text, ~F.coalesce(held_out, F.lit(False)), keep)
    model, codes = _learn_classes(rows, **settings)
    lines = through_table(classed(codes, model, True), "lines")
    transitions(lines.where("__train"), model, settings["classes"], pull)
    return _scored(lines, model, keep)
