"""Registered queries over the given tables, each with its SQL counterpart."""

from . import q_places, q_catalog, q_risk, q_raster, q_rain, q_matrix, q_status, q_models, q_areas, q_stream  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
