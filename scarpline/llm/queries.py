"""All registered queries of this package."""

from . import (  # noqa: F401
    q_language,
    q_mixing,
    q_near,
    q_negatives,
    q_packing,
    q_pages,
    q_quality,
    q_runs,
    q_tokens,
    q_toxicity,
    q_vectors,
)
from .registry import ORACLES, QUERIES  # noqa: F401
