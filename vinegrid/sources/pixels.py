"""Pixel tables on disk: a folder for each day, buckets of scene tiles within it.

Filters on days, also those that come from a join with scenes, reach the scan as folders; tables with the same buckets are
joined where they lie, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
#: Columns of a pixel's place, which all stored tables share; bands follow.
DAY = "acquired_date"
PLACE = ["scene_id", "tile", "row", "col"]
#: Side of a tile in cells: a tile, not a scene, is what one bucket holds whole.
TILE = 256


def tile_of(row: str = "row", col: str = "col") -> Column:
    """Number of the tile of a cell; rows and columns may be negative."""
    return F.shiftleft(F.floor(c(row) / TILE).cast("long"), 32).bitwiseXOR(F.floor(c(col) / TILE).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def write_pixels(px: DataFrame, table: str, path: str, buckets: int = 256) -> DataFrame:
    """Store pixels (scene_id, row, col, acquired_date, bands) under ``path`` and in the catalog as ``table``; returns the table.

    The days at hand are replaced as a whole, others stay, so a run that failed can be run again. A day's bucket is written by one
    task, as one file. Tables that are to be joined need the same number of buckets.
    """
    spark = px.sparkSession
    bands = [x for x in px.columns if x not in (DAY, *PLACE)]
    out = px.withColumn("tile", tile_of()).select(*PLACE, *bands, DAY)
    if not spark.catalog.tableExists(table):
        empty = spark.createDataFrame([], out.schema).write.partitionBy(DAY).bucketBy(buckets, "scene_id", "tile").sortBy(*PLACE)
        empty.option("path", path).option("partitionOverwriteMode", "dynamic").mode("append").saveAsTable(table)
    # the hash that buckets are made by, so that a task writes whole buckets
    dealt = out.repartition(DAY, F.pmod(F.hash("scene_id", "tile"), F.lit(buckets)))
    dealt.write.mode("overwrite").insertInto(table)
    return open_pixels(spark, table)


def of_scenes(px: DataFrame, scenes: DataFrame) -> DataFrame:
    """Stored pixels of the scenes (scene_id, acquired_date): their days prune the folders that are read.

    The days are broadcast, of which there are a few thousand in decades; the scenes, of which there may be any number, are not.
    """
    days = scenes.select(DAY).distinct()
    return px.join(F.broadcast(days), DAY, "left_semi").join(scenes.select("scene_id", DAY), ["scene_id", DAY], "left_semi")


def of_days(px: DataFrame, start: str, end: str) -> DataFrame:
    """Stored pixels from ``start`` up to, without, ``end``."""
    return px.where((c(DAY) >= F.lit(start).cast("date")) & (c(DAY) < F.lit(end).cast("date")))


def open_pixels(spark: SparkSession, table: str) -> DataFrame:
    """A stored table. The session is told that joins may use buckets of some of their keys, which Spark else deals anew.

    Buckets are of (scene, tile), so that a tile's pixels, and with them its neighbourhoods, lie together; joins are on cells.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark.table(table)
