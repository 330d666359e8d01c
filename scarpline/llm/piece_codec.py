"""SentencePiece encoding and decoding through a table of distinct chunks.

A BPE model whose pieces never hold a word marker after another letter cannot join letters
across the start of a marked word. A text is therefore cut before each run of markers, and
around line ends, which no piece holds either; every distinct chunk of a task is segmented
once by the library, and the ids are joined back by position. The table lives in the task:
a table of all chunks of the corpus would shuffle every word of it to save one segmentation
per task and word. It is emptied at a fixed number of entries, which bounds memory and
cannot change a result.

Defined results: a null or empty text has no ids and decodes to the empty text; null ids
count as none; other columns and repeated rows pass through; input columns named like an
output are replaced.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
TABLE = 300_000
STEP = 500


class ChunkTable(dict):
    """Chunk -> its ids as the bytes of 32-bit numbers."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces) or len(self.model.encode("\n")) != 2:
            raise ValueError("pieces of this model cross markers or line ends")
        self.chunks = re.compile(f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+").findall

    def encode(self, texts: list[str]) -> list[bytes]:
        """Some texts at a time: those chunks that the table lacks go to the library together."""
        cut = [self.chunks(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self) > TABLE:
            self.clear()
        new = list({c for chunks in cut for c in chunks if c not in self})
        # The line end keeps a chunk apart from the marker that the library puts first.
        for chunk, ids in zip(new, self.model.encode(["\n" + c for c in new], num_threads=1), strict=True):
            self[chunk] = array("i", ids[2:]).tobytes()
        return [b"".join(map(self.__getitem__, chunks)) for chunks in cut]


@lru_cache(maxsize=2)
def table(path: str) -> ChunkTable:
    return ChunkTable(path)


def encode(path: str, texts: pa.Array) -> pa.Array:
    encoded: list[bytes] = []
    for i in range(0, len(texts), STEP):
        encoded += table(path).encode(texts[i : i + STEP].to_pylist())
    offsets = pa.array([0, *accumulate(len(b) // 4 for b in encoded)], pa.int32())
    values = b"".join(encoded)
    return pa.ListArray.from_arrays(offsets, pa.Array.from_buffers(pa.int32(), len(values) // 4, [None, pa.py_buffer(values)]))


def decode(path: str, lists: pa.Array) -> pa.Array:
    model, texts = table(path).model, []
    for i in range(0, len(lists), STEP):
        part = lists[i : i + STEP].fill_null([])
        values, ends = part.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(part).to_numpy().cumsum()
        texts += [model.decode(x.tolist()) if len(x) else "" for x in np.split(values, ends[:-1])]
    return pa.array(texts, pa.string())


def with_piece_ids(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the ids of the whole text, without begin or end ids, as array<int>."""
    return df.withColumn(ids, F.arrow_udf(lambda x: encode(path, x), "array<int>")(F.col(text)))


def with_decoded(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text that the library decodes from the ids."""
    return df.withColumn(decoded, F.arrow_udf(lambda x: decode(path, x), "string")(F.col(ids)))


def with_round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Both columns in one call of Python: chained, the plan would encode once for each of them."""

    @F.arrow_udf(f"struct<{ids}:array<int>, {decoded}:string>")
    def both(texts: pa.Array) -> pa.Array:
        lists = encode(path, texts)
        return pa.StructArray.from_arrays([lists, decode(path, lists)], [ids, decoded])

    return df.withColumn("__coded", both(F.col(text))).withColumns({c: F.col("__coded")[c] for c in (ids, decoded)}).drop("__coded")
