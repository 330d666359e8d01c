"""Which grid cells are at HIGH or EXTREME fused risk on a day?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import raster
from . import grid


def fused_cells(boxes: DataFrame, wide: DataFrame, meta: raster.RasterMeta, rain: DataFrame,
                step: float = 0.05) -> DataFrame:
    """Every cell of every box with its fused risk, or its status and reasons.

    wide: the terrain table plus a susceptibility column per cell; rain: one row per
    state with antecedent features, rain_status and rain_reasons.
    """
    cells = grid.cell_features(boxes, wide, meta, rain, step, also=("susceptibility",))
    return grid.fused_grid(cells, F.col("susceptibility"))


def risk_overview(cells: DataFrame) -> DataFrame:
    """Cells per state, status and warning level, with the steepest slope and the scores' total."""
    ten_thousandths = F.rint(F.col("final_risk_score") * 1e4).cast("long")
    return cells.groupBy("state", "status", "warning_level").agg(
        F.count("*").alias("cells"),
        F.max("slope").alias("max_slope"),
        F.max("final_risk_score").alias("max_risk"),
        F.min("rain_1d").alias("rain_1d"),
        F.sum(ten_thousandths).alias("risk_sum_e4"),
    )
