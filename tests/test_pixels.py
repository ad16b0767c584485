"""Stored pixel tables: folders by day that joins prune, buckets that joins don't shuffle, days replaced as a whole."""

import uuid

import pytest
from pyspark.sql import functions as F

from vinegrid.operators import geometry, merge
from vinegrid.plans import pipelines
from vinegrid.sources import pixels

c = F.col
COLUMNS = "scene_id int, row int, col int, acquired_date date, v double"


def plan_of(df):
    """The plan as run, and (folders read) of each of its scans."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            metric = node.metrics().get("numPartitions")
            found.append(metric.get().value() if metric.isDefined() else None)
        children = node.children()
        todo.extend(children.apply(k) for k in range(children.size()))
    return plan.toString(), found


def scenes_of(spark, days, rows=12, cols=5, first=0):
    """A scene a day, with a pixel for each cell."""
    base = spark.range(days * rows * cols).select((c("id") / (rows * cols)).cast("int").alias("n"), (c("id") % (rows * cols)).cast("int").alias("k"))
    day = F.date_add(F.lit("2025-06-01").cast("date"), c("n") + first)
    return base.select((c("n") + first).alias("scene_id"), (c("k") / cols).cast("int").alias("row"), (c("k") % cols).cast("int").alias("col"), day.alias("acquired_date"), (c("n") * 1000.0 + c("k")).alias("v"))


@pytest.fixture()
def store(spark, tmp_path):
    return lambda df, name, buckets=3: pixels.write_pixels(df, f"{name}_{uuid.uuid4().hex}", str(tmp_path / name), buckets)


def test_join_with_scenes_prunes_days(spark, store):
    px = store(scenes_of(spark, 30), "px")
    scenes = spark.createDataFrame([(k, "ASC" if k % 10 == 3 else "DESC") for k in range(30)], "scene_id int, orbit string")
    scenes = scenes.withColumn("acquired_date", F.date_add(F.lit("2025-06-01").cast("date"), c("scene_id")))
    found = pixels.of_scenes(px, scenes.where("orbit = 'ASC'"))
    plan, folders = plan_of(found)
    assert "dynamicpruning" in plan and 3 in folders
    assert sorted({r["scene_id"] for r in found.collect()}) == [3, 13, 23] and found.count() == 180


def test_days_prune_folders(spark, store):
    plan, folders = plan_of(pixels.of_days(store(scenes_of(spark, 30), "px"), "2025-06-05", "2025-06-08"))
    assert folders == [3] and "PartitionFilters: [isnotnull(acquired_date" in plan


def test_stored_tables_are_combined_without_shuffle(spark, store):
    a, b, d = (store(scenes_of(spark, 6).withColumnRenamed("v", name), name) for name in ("a", "b", "d"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = merge.combine(a, b, d)
        plan, _ = plan_of(joined)
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan and "Bucketed: true" in plan
        assert joined.count() == 360 and joined.where("a = b AND b = d").count() == 360
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_days_are_replaced_as_a_whole(spark, tmp_path):
    name, path = f"px_{uuid.uuid4().hex}", str(tmp_path / "px")
    pixels.write_pixels(scenes_of(spark, 4), name, path, 2)
    again = scenes_of(spark, 1, rows=2, first=2).withColumn("v", F.lit(-1.0))
    for _ in range(2):
        got = pixels.write_pixels(again, name, path, 2)
    assert got.count() == 3 * 60 + 10 and got.where("v = -1").count() == 10
    assert [r["n"] for r in got.select("acquired_date", c("_metadata.file_path").alias("f")).distinct().groupBy("acquired_date").agg(F.count("f").alias("n")).collect()] == [1] * 4


def test_tiles_and_empty_tables(spark, store):
    cells = spark.createDataFrame([(-1, 0), (0, -1), (255, 0), (256, 0), (0, 256), (-257, 3), (511, 511)], "row int, col int")
    got = [tuple(r) for r in cells.select("row", "col", pixels.tile_of()).collect()]
    want = {(r, k): (r // 256, k // 256) for r, k, _ in got}
    assert len({t for _, _, t in got}) == len(set(want.values())) and len({(want[r, k], t) for r, k, t in got}) == len(set(want.values()))
    assert store(spark.createDataFrame([], COLUMNS), "none").count() == 0


def test_tiles_of_boxes_keep_what_parcels_need(spark, small):
    from vinegrid.adapters import adapter

    edges = adapter(spark, small, "parcel_edges").where("parcel_id <= 3")
    px = [adapter(spark, small, x) for x in ("px_s2", "px_cs", "px_cld")]
    inside = geometry.core_cells(edges, geometry.adaptive_core(edges)).select("row", "col").distinct()
    whole, near = (pipelines.clear_pixels(*px, edges=e).join(inside, ["row", "col"]).select("scene_id", "row", "col", "b4") for e in (None, edges))
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, whole.collect())) and near.count() > 0
    assert geometry.in_tiles(px[0], geometry.box_tiles(edges, 20.0)).count() < px[0].count()
