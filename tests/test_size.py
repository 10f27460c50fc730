"""What must not grow with the tables on a single machine: nothing that follows the input goes through the driver, or is done by one task."""

import os

import pytest

from tremorframe.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

#: Queries whose joins have two sides that grow.
GROWING = ["contact_forces", "clip_raster", "documented_forces", "contact_forces_buffer", "relative_position", "walls_in_contact"]


@pytest.mark.parametrize("name", GROWING)
def test_no_growing_side_is_broadcast(spark, name):
    """On small tables both the planner and the adaptive planner would broadcast whatever they may."""
    df = registry.QUERIES[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Broadcast" not in plan


#: Queries that do much work on each row of a small file.
DEALT = ["gndt_beta_6", "gndt_beta_4", "point_in_polygon", "elevation_slenderness", "costa_rica", "inertia_slenderness", "gndt_beta_1", "slenderness_elevation", "eurocode_8", "poly_inertia", "footprint_irregularity", "inertia_circle", "eurocode_8_compat"]


@pytest.mark.parametrize("name", DEALT)
def test_a_small_file_is_worked_on_by_all_tasks(spark, name):
    """A file of one row group is read in one task; what its rows become must not stay there."""
    rdd = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toRdd()
    assert rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["terrain_clean", "knn_gradient"])
def test_slopes_sort_no_pairs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    df.collect()
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_setbacks_are_worked_on_by_all_tasks(spark):
    """The adaptive planner would put all buildings' parts, few bytes and much work, in one task."""
    df = registry.QUERIES["elevation_setback"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert any("hashpartitioning(id" in line and f", {tasks}), REPARTITION_BY_NUM" in line for line in plan.splitlines())
