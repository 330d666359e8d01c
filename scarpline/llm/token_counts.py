"""Token counts from a tokenizer compiled to a deterministic finite-state transducer.

The vocabulary file (byte-level BPE with an end-of-word mark) is compiled on demand into a
transducer whose transitions carry the change in the number of emitted tokens:

* A BPE encoding is prefix-stable: the encoding of a word's prefix ends with exactly one
  token, and that token is the suffix for which the merges leave the pair (token before it,
  token) as it is. So what reading one more symbol does depends only on the longest suffix
  that can still grow into a token, and on the last token at each position inside it.
  That is a state; there are finitely many, and they are built when first reached.
* A transition adds +1 when the symbol opens a token, 0 when it extends one, and less when
  tokens collapse into a longer one. The sum along a word is its token count.

Long texts are cut into chunks. White space always brings the machine back to its start
state, so the state map of a chunk is constant beyond its first white space: it is kept as
(text before the first white space, count between, text after the last one). Such maps
compose associatively, so a text's maps are reduced pairwise, in a scan of logarithmic depth.

Defined results: a null text counts as empty (0 bytes, 0 tokens); other columns, repeated
rows and null ids pass through; input columns named like an output are replaced.
"""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space of Unicode, on which a text is cut; no token crosses it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts of these letters are cut alike by every version of Unicode, and by str.split().
PLAIN = regex.compile(r"[^\x1c-\x1f̀-\U0010ffff]*")
CHUNK = 1 << 15
MEMO = 400_000
TRANSITIONS = 800_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Transducer:
    """Word -> number of tokens, over symbols of which the last of a word is marked."""

    MARK = 0xE000  # a marked symbol is its letter moved to the private area
    LAST = chr(MARK)

    def __init__(self, merges: list[tuple[str, str]], end: str, memory: int = TRANSITIONS):
        self.end, self.memory = end, memory
        self.rank = {(self.symbols(a), self.symbols(b)): i for i, (a, b) in reversed(list(enumerate(merges)))}
        self.tokens = {a + b for a, b in self.rank}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.made = {a + b: ((a, b), i) for (a, b), i in self.rank.items()}
        if len(self.made) < len(self.rank):
            raise ValueError("two merges make the same token")
        self.whole: dict[str, bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.clear()

    def symbols(self, token: str) -> str:
        if self.end and token.endswith(self.end):
            token = token[: -len(self.end)]
            return token[:-1] + chr(self.MARK + ord(token[-1]))
        return token

    def clear(self) -> None:
        """Only the start state: nothing read, no token before."""
        self.keys = [("", ((None, 0),))]
        self.index = {self.keys[0]: 0}
        self.next: list[dict[str, tuple[int, int]]] = [{}]
        self.forms: dict[str, tuple] = {}
        self.stable: dict[tuple, bool] = {}
        self.size = 0

    def merge(self, text: str) -> list[str]:
        parts = list(text)
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.rank.get(p, len(self.rank)))
            if best not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def edge(self, token: str, last: bool) -> list[tuple[str, float]]:
        """The symbols that stand at the last (or first) place of a token while it is merged,
        each with the rank of the merge that ends it; the token itself is never ended."""
        known = self.edges[last].get(token)
        if known is None:
            known, inner, dies = [], token, float("inf")
            while True:
                known.append((inner, dies))
                if len(inner) == 1:
                    break
                pair, dies = self.made[inner]
                inner = pair[last]
            self.edges[last][token] = known = known[::-1]
        return known

    def keeps(self, before: str | None, token: str) -> bool:
        """Whether the merges leave these two tokens next to each other as they are.

        Merges run by rank, and of equal rank from the left. So the pair stays apart if at
        no time the two symbols at the border merge before one of them merges inwards.
        """
        whole = self.whole.get(token)
        if whole is None:
            whole = self.whole[token] = self.merge(token) == [token]
        if before is None or not whole:
            return whole
        left, right = self.edge(before, True), self.edge(token, False)
        i = j = 0
        while True:
            (a, a_dies), (b, b_dies) = left[i], right[j]
            rank = self.rank.get((a, b))
            if rank is not None and rank < a_dies and rank <= b_dies:
                return False
            if a_dies == b_dies == float("inf"):
                return True
            if a_dies <= b_dies:
                i += 1
            else:
                j += 1

    def open_lengths(self, suffix: str) -> list[int]:
        """Lengths of the ends of `suffix` that can still grow into a token, 0 included."""
        return [n for n in range(len(suffix) + 1) if not n or suffix[-n:] in self.prefixes]

    def form(self, grown: str) -> tuple:
        """What reading the last symbol of `grown` allows, whatever tokens came before: the tokens
        that may end here, longest first, the suffix kept, and where its positions were."""
        place = {n: i for i, n in enumerate(self.open_lengths(grown[:-1]))}
        ending = [(grown[-n:], place[n - 1]) for n in range(len(grown), 0, -1) if n == 1 or grown[-n:] in self.tokens]
        keep = next((grown[i:] for i in range(len(grown)) if grown[i:] in self.prefixes), "")
        return ending, keep, [place[n - 1] for n in self.open_lengths(keep)[1:]]

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """Compile one transition: the state after the symbol and the change in tokens."""
        suffix, history = self.keys[state]
        grown = suffix + symbol
        form = self.forms.get(grown)
        if form is None:
            form = self.forms[grown] = self.form(grown)
        ending, keep, places = form
        for token, place in ending:
            pair = (history[place][0], token)
            stays = self.stable.get(pair)
            if stays is None:
                stays = self.stable[pair] = self.keeps(*pair)
            if stays:
                break
        else:
            raise ValueError(f"no token ends at {symbol!r}")
        count = history[place][1] + 1
        if symbol >= self.LAST:
            target = 0  # a word is over
        else:
            key = (keep, ((token, 0), *[(history[p][0], history[p][1] - count) for p in places]))
            target = self.index.get(key)
            if target is None:
                target = self.index[key] = len(self.keys)
                self.keys.append(key)
                self.next.append({})
        self.size += 1
        self.next[state][symbol] = found = (target, count)
        return found

    def count(self, word: str) -> int:
        if self.size > self.memory:
            self.clear()
        if self.end:
            word = word[:-1] + chr(self.MARK + ord(word[-1]))
        state = total = 0
        for symbol in word:
            state, change = self.next[state].get(symbol) or self.step(state, symbol)
            total += change
        return total


class Memo(dict):
    """Word -> count, asked from the transducer when missing."""

    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word):
        if len(self) > MEMO:
            self.clear()
        self[word] = n = self.count(word)
        return n


class Counter:
    """Texts -> token counts, as the library that owns the vocabulary file gives them."""

    def __init__(self, path: str, chunk: int = CHUNK):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library, self.chunk = Tokenizer.from_file(path), chunk
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.machine = Transducer(merges, spec["model"].get("end_of_word_suffix") or "")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", WHITE)).findall
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        letters = byte_letters()
        self.letters = Memo(
            lambda w: self.machine.count(w if w.isascii() and w.isalpha() else "".join(map(letters.__getitem__, w.encode())))
        )
        self.plain = Memo(lambda run: sum(map(self.letters.__getitem__, self.words(run))))
        self.mapped = Memo(self.machine.count)
        self.white = regex.compile(f"[{WHITE}]")

    def closed(self, text: str) -> int:
        """Tokens of a piece that ends where words end."""
        return sum(map(self.plain.__getitem__, text.split()))

    def state_map(self, chunk: str) -> tuple:
        first = self.white.search(chunk)
        if not first:
            return (chunk, None, "")
        last = max(chunk.rfind(c) for c in set(self.white.findall(chunk)))
        return (chunk[: first.start()], self.closed(chunk[first.start() : last]), chunk[last + 1 :])

    def compose(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None and b[1] is None:
            return (a[0] + b[0], None, "")
        if a[1] is None:
            return (a[0] + b[0], b[1], b[2])
        if b[1] is None:
            return (a[0], a[1], a[2] + b[0])
        return (a[0], a[1] + self.closed(a[2] + b[0]) + b[1], b[2])

    def segment(self, text: str) -> int:
        if not PLAIN.fullmatch(text):
            normal = self.library.normalizer.normalize_str(text)
            return sum(self.mapped[w] for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal))
        text = text.lower()
        if len(text) <= self.chunk:
            return self.closed(text)
        maps = [self.state_map(text[i : i + self.chunk]) for i in range(0, len(text), self.chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, inner, tail = maps[0]
        return self.closed(head) + (inner or 0) + self.closed(tail)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.segment(text)
        return len(self.special.findall(text)) + sum(map(self.segment, filter(None, self.special.split(text))))


@lru_cache(maxsize=2)
def counter(path: str, chunk: int = CHUNK) -> Counter:
    return Counter(path, chunk)


def with_token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 2048, chunk: int = CHUNK) -> DataFrame:
    """Add `n_bytes`, `n_tokens` and `over_limit` for the whole text of each row.

    One narrow pass without a shuffle. `path` is the vocabulary file on every machine, `limit`
    the count above which `over_limit` is set, `chunk` the characters of one state map.
    """

    @F.arrow_udf("bigint")
    def tokens(texts: pa.Array) -> pa.Array:
        count = counter(path, chunk).count
        return pa.array((count(x.as_py()) for x in texts), pa.int64())

    return (
        df.withColumns({"n_bytes": F.coalesce(F.octet_length(text).cast("bigint"), F.lit(0).cast("bigint")), "n_tokens": tokens(F.col(text))})
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
