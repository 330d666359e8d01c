"""Physical plans: no nested loops, no window over raw rows in one task, pushed filters."""

import re

import pytest
from pyspark.sql import functions as F

import checks
from checks.fixtures import CELL_METRES, SIKKIM, Inputs
from scarpline.operators import raster
from scarpline.session import scratch_path
from scarpline.sources import rain_documents

LAZY = sorted(k for k in checks.ORACLES if not k.startswith("stream_"))
# Tree ensembles are walked in Arrow batches, in one pass whatever the number of areas.
WALKED = {"grid_score", "point_score", "feature_attribution", "scenario_compare", "refit_consistency"}
# Windows over at most 256 range totals, never over data rows.
RANGE_TOTALS = {"roc_auc", "average_precision", "spatial_holdout"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", LAZY)
def test_plan_is_distributed(spark, small, key):
    plan = plan_of(checks.QUERIES[key](spark, small))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    if key in WALKED:
        assert plan.count("ArrowEvalPython ") <= 1 or key == "feature_attribution"
    else:
        assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
    if key not in RANGE_TOTALS:
        lines = plan.splitlines()
        below = [n for i, x in enumerate(lines) if re.search(r"\bWindow \[", x) for n in lines[i + 1 : i + 4]]
        assert not any("Exchange SinglePartition" in n for n in below)


def test_stencil_shuffles_once(spark, small):
    nine = raster.with_gradients(raster.neighbourhood(Inputs(spark, small).dem), CELL_METRES)
    assert len(re.findall("Exchange hashpartitioning", plan_of(nine))) == 1


def test_region_filter_reaches_the_scan(spark, small):
    plan = plan_of(checks.QUERIES["aoi_mean_precip"](spark, small))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_quantity:double,l_shipdate" in plan


def test_precip_grid_prunes_partitions_and_row_groups(spark, small):
    grid = Inputs(spark, small).precip_grid.withColumn("run_type", F.lit("Early")).where("month(day) = 3")
    path = scratch_path(spark, "grid")
    rain_documents.write_precip_grid(grid, path)
    busiest = grid.where(
        F.col("lat_idx").between(1170, 1179) & F.col("lon_idx").between(2680, 2688)
    ).groupBy("day").count().orderBy(F.desc("count"), "day").first()
    got = rain_documents.read_precip_grid(spark, path, "Early", str(busiest["day"]), SIKKIM)
    plan = plan_of(got)
    assert re.search(r"PartitionFilters: \[[^\]]*run_type[^\]]*day", plan)
    assert re.search(r"PushedFilters: \[[^\]]*lat_idx[^\]]*lon_idx", plan)
    index = lambda v, offset: round((v + offset) * 10)
    want = grid.where(
        (F.col("day") == F.lit(busiest["day"]))
        & F.col("lat_idx").between(index(SIKKIM["min_lat"], 89.95), index(SIKKIM["max_lat"], 89.95))
        & F.col("lon_idx").between(index(SIKKIM["min_lon"], 179.95), index(SIKKIM["max_lon"], 179.95))
    )
    assert got.count() == want.count() > 0
    assert got.select(*want.columns).exceptAll(want).isEmpty()
