"""Query op11. A tokenizer's merges and a dynamic program are not SQL; it is tested against the
library and brute force."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import packing
from .registry import query, read


@query("op11_packing")
def op11(spark, sf_dir):
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), window=2048, end=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
