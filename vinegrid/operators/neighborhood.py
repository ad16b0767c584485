"""Neighbourhood operators: rows sent to the shifted cells that need them, one aggregation, no self-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
CELL = ["scene_id", "row", "col"]


def offsets(radius: float, shape: str = "circle") -> list[tuple[int, int]]:
    n = int(radius)
    return [(r, k) for r in range(-n, n + 1) for k in range(-n, n + 1) if shape == "square" or r * r + k * k <= radius * radius]


def _shifted(df: DataFrame, moves: Sequence[tuple[int, int]], keep: Sequence[str]) -> DataFrame:
    steps = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(k).alias("k")) for r, k in moves])).alias("_o")
    return df.select(*keep, "row", "col", steps).select(*keep, (c("row") + c("_o.r")).alias("row"), (c("col") + c("_o.k")).alias("col"), c("_o.r").alias("dr"), c("_o.k").alias("dc"))


def dilate(cells: DataFrame, radius: int = 2, keys: Sequence[str] = ("scene_id",)) -> DataFrame:
    """All cells within ``radius`` cells of one of the rows; (keys, row, col)."""
    return _shifted(cells, offsets(radius), keys).select(*keys, "row", "col").distinct()


def drop_dilated(pixels: DataFrame, cloudy: Column, radius: int = 2) -> DataFrame:
    """Pixels that are not within ``radius`` cells of a cloudy one of the same scene."""
    return pixels.join(dilate(pixels.where(cloudy), radius), ["scene_id", "row", "col"], "left_anti")


def focal_mean(pixels: DataFrame, bands: Sequence[str], radius: float = 2.5, shape: str = "circle", tile: int = 64) -> DataFrame:
    """Mean of each band over the neighbourhood of each existing cell; (scene_id, row, col, bands).

    Pixels are shuffled by scene and tile, those near an edge to the tiles next to it, too (1.16 x for 64 cells and 2.5), and
    meet their neighbours within the tile.
    """
    near = int(radius)
    tiles = lambda x: F.explode(F.sequence(F.floor((c(x) - near) / tile).cast("int"), F.floor((c(x) + near) / tile).cast("int")))
    keys = ["scene_id", "_tr", "_tc"]
    dealt = pixels.select("scene_id", "row", "col", *bands).withColumn("_tr", tiles("row")).withColumn("_tc", tiles("col")).repartition(*keys)
    moved = _shifted(dealt, offsets(radius, shape), [*keys, *bands]).where((F.floor(c("row") / tile) == c("_tr")) & (F.floor(c("col") / tile) == c("_tc")))
    own = F.max(((c("dr") == 0) & (c("dc") == 0)).cast("int"))
    return moved.groupBy(*keys, "row", "col").agg(own.alias("_own"), *[F.avg(b).alias(b) for b in bands]).where("_own = 1").drop("_own", "_tr", "_tc")


def gradients(dem: DataFrame, scale: float = 10.0) -> DataFrame:
    """(row, col, elevation, gx, gy) of the cells that have all four neighbours; central differences."""
    moved = _shifted(dem, [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)], ["elevation"])
    at = lambda r, k: F.max(F.when((c("dr") == r) & (c("dc") == k), c("elevation")))
    sides = moved.groupBy("row", "col").agg(at(0, 0).alias("elevation"), at(0, 1).alias("w"), at(0, -1).alias("e"), at(1, 0).alias("s"), at(-1, 0).alias("n"))
    return sides.dropna().select("row", "col", "elevation", ((c("e") - c("w")) / (2 * scale)).alias("gx"), ((c("n") - c("s")) / (2 * scale)).alias("gy"))


def slope() -> Column:
    return F.degrees(F.atan(F.sqrt(c("gx") * c("gx") + c("gy") * c("gy"))))


def aspect() -> Column:
    """Downslope azimuth, clockwise from north, 0 to 360."""
    a = F.degrees(F.atan2(-c("gx"), -c("gy")))
    return F.when(a < 0, a + 360).otherwise(a)


def hillshade(azimuth: float = 180.0, elevation: float = 70.0) -> Column:
    s, zenith = F.radians(c("slope")), F.radians(F.lit(90.0 - elevation))
    lit = F.cos(zenith) * F.cos(s) + F.sin(zenith) * F.sin(s) * F.cos(F.radians(F.lit(azimuth)) - F.radians(c("aspect")))
    return F.greatest(lit, F.lit(0.0)) * 255


def terrain(dem: DataFrame) -> DataFrame:
    return gradients(dem).select("row", "col", "elevation", slope().alias("slope"), aspect().alias("aspect"))


def glcm(cells: DataFrame, level: str, half_width: int = 3, tile: int = 16) -> DataFrame:
    """Entropy and contrast of grey-level pairs in the window around each cell, four directions together.

    A pair counts for a centre if both its cells are within ``half_width`` of it; (row, col, entropy, contrast). A cell is one row;
    without a level it is in no pair, and centres without a pair are left out. Cells are shuffled once, by tile, with a rim of
    ``half_width`` cells (1.9 x for 16: small beside the hundreds of pairs of a cell, and tasks for small grids, too). Within the tile pairs are counted along their row first, which puts equal ones together,
    and those counts then along the columns.
    """
    moves = [(0, 1), (1, 0), (1, 1), (1, -1)]
    tiles = lambda x: F.explode(F.sequence(F.floor((c(x) - half_width) / tile).cast("int"), F.floor((c(x) + half_width) / tile).cast("int")))
    inside = lambda x, t: F.floor(c(x) / tile) == c(t)
    key = ["_tr", "_tc"]
    dealt = cells.select("row", "col", c(level).alias("_level")).withColumn("_tr", tiles("row")).withColumn("_tc", tiles("col")).repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    moved = _shifted(dealt, [(0, 0), *((-r, -k) for r, k in moves)], [*key, "_level"])
    at = lambda r, k: (c("dr") == -r) & (c("dc") == -k)
    sides = moved.groupBy(*key, "row", "col").agg(
        F.max(at(0, 0)).alias("there"), *[F.max(F.when(at(r, k), c("_level"))).alias(f"_{n}") for n, (r, k) in enumerate([(0, 0), *moves])]
    ).where("there")
    # a centre's own mark travels as a pair without an other cell, on a span of one
    pair = lambda n, r, k, w: F.struct(F.lit(r).alias("dr"), F.lit(k).alias("dc"), F.lit(w).alias("w"), (c(f"_{n}") if n else F.lit(None)).alias("other"))
    found = F.array(pair(0, 0, 0, 0), *[pair(n, r, k, half_width) for n, (r, k) in enumerate(moves, 1)])
    pairs = sides.select(*key, "row", "col", c("_0").alias("own"), F.inline(found)).where("w = 0 OR (own IS NOT NULL AND other IS NOT NULL)")
    span = lambda x, d: F.explode(F.sequence(F.greatest(c(x), c(x) + c(d)) - c("w"), F.least(c(x), c(x) + c(d)) + c("w")))
    along = pairs.withColumn("k", span("col", "dc")).where(inside("k", "_tc")).groupBy(*key, "row", "k", "dr", "w", "own", "other").agg(F.count("*").alias("n"))
    spread = along.withColumn("r", span("row", "dr")).where(inside("r", "_tr")).groupBy(*key, "r", "k", "own", "other").agg(F.sum("n").alias("n"))
    # per centre: sum p ln p = (sum n ln n - N ln N) / N, so that one aggregation does
    real = lambda x: F.sum(F.when(c("other").isNotNull(), x))
    n = spread.groupBy(*key, c("r").alias("row"), c("k").alias("col")).agg(
        F.max(c("other").isNull()).alias("there"), real(c("n")).alias("total"), real(c("n") * F.ln(c("n").cast("double"))).alias("n_ln"), real((c("own") - c("other")) * (c("own") - c("other")) * c("n")).alias("c2")
    )
    entropy = F.ln(c("total").cast("double")) - c("n_ln") / c("total")
    return n.where("there AND total > 0").select("row", "col", entropy.alias("entropy"), (c("c2") / c("total")).alias("contrast"))


def shadows(cloudy: DataFrame, dark: DataFrame, azimuth: float, zenith: float, heights: Sequence[float] = (500.0, 1000.0, 2000.0), scale: float = 10.0) -> DataFrame:
    """Dark cells under the clouds' shadow for any of the heights, widened by a cell; (scene_id, row, col)."""
    from math import cos, floor, radians, sin, tan

    back = radians(azimuth + 180)
    moves = [(floor(h * tan(radians(zenith)) * cos(back) / scale + 0.5), floor(h * tan(radians(zenith)) * sin(back) / scale + 0.5)) for h in heights]
    cast = _shifted(cloudy, moves, ["scene_id"]).select("scene_id", "row", "col").distinct()
    return dilate(cast.join(dark.select("scene_id", "row", "col"), ["scene_id", "row", "col"]), 1)


def shadow_moves(angles: DataFrame, heights: Sequence[float] = (500.0, 1000.0, 2000.0), scale: float = 10.0) -> DataFrame:
    """(scene_id, r, k): by how many cells each scene's own sun moves the shadow of a cloud of each height; equal moves once.

    ``angles``: scene_id, azimuth and zenith in degrees, a row a scene. A scene without angles or with the sun at the horizon or
    below it has no row.
    """
    reach = lambda h: F.tan(F.radians("zenith")) * (h / scale)
    back = F.radians(c("azimuth") + 180.0)
    cells = lambda x: F.floor(x + 0.5).cast("int")
    moves = F.array(*[F.struct(cells(reach(h) * F.cos(back)).alias("r"), cells(reach(h) * F.sin(back)).alias("k")) for h in heights])
    seen = angles.where(c("azimuth").isNotNull() & (c("zenith") >= 0) & (c("zenith") < 90))
    return seen.select("scene_id", F.inline(F.array_distinct(moves)))


def scene_shadows(core: DataFrame, dark: DataFrame, angles: DataFrame, heights: Sequence[float] = (500.0, 1000.0, 2000.0), scale: float = 10.0, widen: int = 1) -> DataFrame:
    """Dark cells on which a cloud of any of the heights casts its shadow, by each scene's own sun, widened; (scene_id, row, col).

    Each cloud core's row is moved a few times and meets the dark cells by an equality of keys; nothing is joined within a scene.
    """
    moved = core.select("scene_id", "row", "col").join(shadow_moves(angles, heights, scale), "scene_id")
    cast = moved.select("scene_id", (c("row") + c("r")).alias("row"), (c("col") + c("k")).alias("col"))
    return dilate(dark.select("scene_id", "row", "col").join(cast, CELL, "left_semi"), widen)
