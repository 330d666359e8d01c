"""Query op8. The verdict iterates to a fixed estimate; it is tested against numpy."""

from __future__ import annotations

from scarpline.session import through_table

from . import robust_quality
from .registry import query, read


@query("op8_robust_quality")
def op8(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    table = through_table(robust_quality.with_statistics(docs).drop("text"), "statistics")
    judged = robust_quality.with_verdict(table)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )
