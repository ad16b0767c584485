"""Sensor pipelines from pixel tables to per-pixel time series, and the monthly backfill."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vinegrid.config import DEFAULTS, Params
from vinegrid.functions import indices as ix
from vinegrid.operators import geometry, merge, neighborhood, stats
from vinegrid.sources import files

c = F.col


def geo() -> Column:
    """Cell centre in metres, as GeoJSON."""
    return ix.geo_point((c("col") * 10 + 5).cast("double"), (c("row") * 10 + 5).cast("double"))


def dated(pixels: DataFrame, first_day: str = "2025-06-01") -> DataFrame:
    """The acquisition date of a pixel's scene: scene numbers count days from the first."""
    return pixels.withColumn("date", F.date_add(F.lit(first_day).cast("date"), c("scene_id")))


def sentinel1(px_s1: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Despeckled VV, VH and their ratio (as written: without despeckling)."""
    calm = px_s1 if params.profile == "as_written" else neighborhood.focal_mean(px_s1, ["vv", "vh"], params.despeckle_radius)
    return dated(calm).select("date", c("vv").alias("VV"), c("vh").alias("VH"), ix.ratio_vh_vv().alias("RATIOVHVV"), geo().alias("geo"), "row", "col")


def clear_pixels(px_s2: DataFrame, px_cs: DataFrame, px_cld: DataFrame, params: Params = DEFAULTS, edges: DataFrame | None = None, sun: DataFrame | None = None) -> DataFrame:
    """Pixels that all three products call clear and that no cloudy one is near to.

    ``edges``: only pixels in these parcels are wanted. Each table is then cut to the tiles of the parcels' boxes, widened by the
    dilation, before anything else is done with it; of the pixels in these tiles but outside the boxes some may come out, too.
    ``sun``: angles by scene (scene_id, azimuth, zenith); pixels in the shadow of a cloud go, too. Clouds far outside the parcels
    cast shadows into them, so cloud cores are taken from whole scenes.
    """
    core = None if sun is None else cloud_core(px_s2, px_cld, params)
    if edges is not None:
        near = geometry.box_tiles(edges, params.dilation_cells * params.scale_m)
        px_s2, px_cs, px_cld = (geometry.in_tiles(px, near, params.scale_m) for px in (px_s2, px_cs, px_cld))
    tested = merge.combine(px_s2, px_cs, px_cld).withColumn("clear", ix.clear_ensemble(params))
    clear = neighborhood.drop_dilated(tested, ~c("clear"), params.dilation_cells).where("clear").drop("clear")
    if core is None:
        return clear
    return clear.join(neighborhood.scene_shadows(core, px_s2.where(ix.dark(params)), sun, params.cloud_heights_m, params.scale_m), merge.CELL, "left_anti")


def cloud_core(px_s2: DataFrame, px_cld: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Cells (scene_id, row, col) of clouds that cast shadows, by probability or class; a cell may come twice."""
    likely = px_cld.where(c("probability") > params.core_probability).select(*merge.CELL)
    return px_s2.where(c("scl").isin(*params.core_classes)).select(*merge.CELL).union(likely)


def parcel_cells(edges: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Cells (row, col) of each parcel's eroded core with parcel_id, erosion_m, is_small_parcel and total_pixels."""
    core = geometry.adaptive_core(edges, params.scale_m**2, params.core_area_min, params.small_pixels)
    core = core.select("parcel_id", "erosion_m", "is_small_parcel", (geometry.core_area() / params.scale_m**2).alias("total_pixels"))
    return geometry.core_cells(edges, core, params.scale_m)


#: What identifies a parcel's observation, and what its parcel gives to it.
OBSERVED = ["parcel_id", "scene_id"]
OF_PARCEL = ["erosion_m", "is_small_parcel", "total_pixels"]


#: Cells of a parcel up to which a task may hold its pixels of one scene or period; statistics of larger ones are found by distributed selection.
LARGE_CELLS = 4096


def by_parcel(px: DataFrame, edges: DataFrame, each: Callable[[DataFrame, list[str]], DataFrame], params: Params = DEFAULTS) -> DataFrame:
    """Pixels beside the parcels whose core they are in, given to ``each`` with the keys that groups by parcel must begin with.

    Parcels of up to LARGE_CELLS cells meet their pixels in chunks of neighbours (key ``chunk``, ``geometry.meet_in_chunks``), and
    there are as many tasks as the parcels ask for. Larger ones, if there are any, meet theirs by cell and have no such key.
    """
    area, limit = geometry.areas(edges), LARGE_CELLS * params.scale_m**2
    facts = area.agg(F.count("*").alias("n"), F.count_if(c("area_m2") > limit).alias("large")).first()
    small = edges
    parts = []
    if facts["large"]:
        large = area.where(c("area_m2") > limit).select("parcel_id")
        small, wide = edges.join(large, "parcel_id", "left_anti"), edges.join(large, "parcel_id", "left_semi")
        parts.append(each(px.join(parcel_cells(wide, params), ["row", "col"]), []))
    if facts["large"] < facts["n"] or not parts:
        tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-facts["n"] // geometry.CHUNK_PARCELS))
        parts.append(each(geometry.meet_in_chunks(px, parcel_cells(small, params), small, tasks, params.scale_m), ["chunk"]).drop("chunk"))
    return reduce(DataFrame.unionByName, parts)


def observations(px: DataFrame, edges: DataFrame, params: Params = DEFAULTS, first_band: str = "b4") -> DataFrame:
    """Quality of each parcel and scene: valid and total pixels of its core, coverage, erosion, and whether it counts as observed."""
    return by_parcel(px, edges, lambda seen, own: stats.validate(stats.coverage(seen, [*own, *OBSERVED, *OF_PARCEL], first_band=first_band), params=params), params)


def observed_pixels(px: DataFrame, edges: DataFrame, params: Params = DEFAULTS, first_band: str = "b4") -> DataFrame:
    """Pixels of each parcel's core beside the quality of its parcel in that scene, which a window counts."""

    def judged(seen: DataFrame, own: list[str]) -> DataFrame:
        counted = seen.withColumn("valid_pixels", F.count(first_band).over(Window.partitionBy(*own, *OBSERVED)))
        return stats.validate(counted.withColumn("coverage_ratio", F.try_divide("valid_pixels", "total_pixels")), params=params)

    return by_parcel(px, edges, judged, params)


def parcel_stats(px: DataFrame, edges: DataFrame, bands: Sequence[str], params: Params = DEFAULTS) -> DataFrame:
    """Statistics of each parcel's core in each scene, a row per band."""
    return by_parcel(px, edges, lambda inside, own: stats.band_stats(inside, [*own, *OBSERVED], bands, small=bool(own)), params)


def pixels_with_stats(px: DataFrame, edges: DataFrame, band: str, params: Params = DEFAULTS, first_band: str = "b4") -> DataFrame:
    """Pixels (scene_id, row, col, band) of each parcel's core beside the band's statistics and the quality of its parcel in that scene."""
    shown, last = ["row", "col", band], lambda df: stats.validate(df.withColumn("coverage_ratio", F.try_divide("valid_pixels", "total_pixels")), params=params).drop("band")

    def joined(inside: DataFrame, own: list[str]) -> DataFrame:
        keys = [*own, *OBSERVED, *OF_PARCEL]
        valid = F.count(first_band)
        if own:
            found = stats.band_stats(inside, keys, [band], small=True, also={"valid_pixels": valid, "_px": F.collect_list(F.struct(*shown))})
            return last(found.select("*", F.inline("_px")).drop("_px"))
        found = stats.band_stats(inside, keys, [band]).join(inside.groupBy(*keys).agg(valid.alias("valid_pixels")), keys)
        return last(inside.select(*OBSERVED, *shown).join(found, OBSERVED))

    return by_parcel(px, edges, joined, params)


def sentinel2(px_s2: DataFrame, px_cs: DataFrame, px_cld: DataFrame, edges: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Cleaned indices of each parcel's core with its quality columns; every band counts for coverage, rows need all indices.

    The core's cells carry the parcel's columns, and a scene's pixels in a parcel are counted by a window, so that each input
    is read once, and only near the parcels. Indices are a pixel's, so they are made before it meets its parcels.
    """
    indices = ["NDVI", "EVI", "GNDVI", "IRECI", "NDMI", "NDRE"]
    named = clear_pixels(px_s2, px_cs, px_cld, params, edges).withColumns({k: v for k, v in ix.s2_indices(params.profile).items() if k in indices})
    seen = observed_pixels(named.select(*merge.CELL, "b4", *indices), edges, params).dropna(subset=indices)
    return dated(seen).select(
        "parcel_id", "date", *indices, "valid_pixels", "total_pixels", "coverage_ratio", "observation_valid", "erosion_m", "is_small_parcel", geo().alias("geo"), "row", "col"
    )


def dated_clear(px_s2: DataFrame, px_cs: DataFrame, px_cld: DataFrame, edges: DataFrame, scenes: DataFrame | None = None, params: Params = DEFAULTS) -> DataFrame:
    """Clear pixels near the parcels with their date and vegetation index.

    ``scenes``: (scene_id, acquired_at) gives the dates; without it scene numbers count days.
    """
    clear = clear_pixels(px_s2, px_cs, px_cld, params, edges)
    if scenes is None:
        named = dated(clear)
    else:
        named = clear.join(scenes.select("scene_id", F.to_date("acquired_at").alias("date")), "scene_id")
    return named.withColumn("ndvi", ix.ndvi())


def parcel_pixels(px_s2: DataFrame, px_cs: DataFrame, px_cld: DataFrame, edges: DataFrame, scenes: DataFrame | None = None, params: Params = DEFAULTS) -> DataFrame:
    """Clear pixels of each parcel's core with their date and vegetation index: what a parcel's time series are made of."""
    return by_parcel(dated_clear(px_s2, px_cs, px_cld, edges, scenes, params), edges, lambda inside, own: inside.drop(*OF_PARCEL), params)


def parcel_periods(pixels: DataFrame, edges: DataFrame, bands: Sequence[str], every: str | int = "week", params: Params = DEFAULTS) -> DataFrame:
    """``stats.period_stats`` of each parcel's core, of dated pixels (``dated_clear``)."""
    return by_parcel(pixels, edges, lambda inside, own: stats.period_stats(inside, bands, [*own, "parcel_id"], every=every, small=bool(own)), params)


def parcel_series(pixels: DataFrame, edges: DataFrame, every: str | int = 1, value: str = "ndvi", median: bool = True, params: Params = DEFAULTS) -> DataFrame:
    """(parcel_id, period, n, mean, median) of a value over each parcel's clear pixels (``dated_clear``) by calendar period, days by default.

    Without ``median`` the pixels are read once, in one aggregation.
    """

    def series(inside: DataFrame, own: list[str]) -> DataFrame:
        keys = [*own, "parcel_id", "period"]
        named = inside.select(*own, "parcel_id", stats.period_start("date", every).alias("period"), value)
        measures = [F.count(value).alias("n"), F.avg(value).alias("mean")]
        if median and own:
            found = named.groupBy(*keys).agg(*measures, F.sort_array(F.collect_list(c(value) + 0.0)).alias("_v")).where("n > 0")
            return found.select(*keys, "n", "mean", stats.quantile_of(c("_v"), c("n"), 0.5).alias("median"))
        means = named.groupBy(*keys).agg(*measures).where("n > 0")
        return means if not median else means.join(stats.quantiles(named, keys, value, [0.5]).select(*keys, F.get("p", 0).alias("median")), keys)

    return by_parcel(pixels, edges, series, params)


def landsat(px_landsat: DataFrame, grid: DataFrame) -> DataFrame:
    """Cloud-masked surface temperature on the fine grid (row, col)."""
    clear = px_landsat.where(ix.bits_unset("qa_pixel", 3, 4)).select("scene_id", "row", "col", ix.lst_landsat().alias("LST")).dropna(subset=["LST"])
    return dated(merge.align_nearest(grid, clear, 30.0)).select("date", "LST", geo().alias("geo"), "row", "col")


def ecostress(px_eco: DataFrame, grid: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Morning and midday scenes in degrees; scene n was taken n * 25 hours after the first midnight."""
    day = F.timestamp_millis(F.unix_millis(F.lit("2025-06-01").cast("timestamp")) + c("scene_id").cast("long") * 25 * 3600 * 1000)
    kept = px_eco.withColumn("ts", day).where(F.hour("ts").between(*params.hours))
    named = kept.select("row", "col", F.to_date("ts").alias("date"), ix.lst_ecostress().alias("LST_eco"))
    return merge.align_nearest(grid, named, 70.0).select("date", "LST_eco", geo().alias("geo"), "row", "col")


def srtm(dem: DataFrame, edges: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Terrain of the cells inside each parcel, derived on the parcel's surroundings."""
    inside = geometry.locate(dem, edges).where("inside").select("parcel_id", "row", "col")
    return neighborhood.terrain(dem).join(inside, ["row", "col"]).select("parcel_id", "elevation", "slope", "aspect", geo().alias("geo"), "row", "col")


def era5(hourly: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Daily table of the season's hours with a row for each day."""
    season = hourly.where(F.month("ts").between(*params.season))
    return stats.day_spine(season, stats.daily_meteo(season))


def merged_dataset(spark: SparkSession, raw: str, out: str, roi: str = "*", months: DataFrame | None = None) -> DataFrame:
    """Merge all CSV time series by date and place and write them by month, or only the ``months`` (year, month); returns the dataset.

    Only files that can hold rows of these months are opened.
    """
    names = None if months is None else [f"{r['year']}-{r['month']:02d}" for r in months.select("year", "month").distinct().collect()]  # a calendar's months
    sources = files.read_sources(spark, raw, roi, names)
    if not sources and months is None:
        raise ValueError(f"no time series under {raw}")
    if sources:
        if months is not None:
            sources = {k: _of_months(v, months) for k, v in sources.items()}
        files.write_partitioned(merge.outer_merge(sources), out)
    return spark.read.parquet(out)


def _of_months(rows: DataFrame, months: DataFrame) -> DataFrame:
    """Rows of those months; there are as many as months between two dates, so their table is small."""
    return merge.with_year_month(rows).join(F.broadcast(months.select("year", "month")), ["year", "month"], "left_semi").drop("year", "month")


def run_pipeline(spark: SparkSession, sensors: dict[str, DataFrame], raw: str, out: str, start: str, end: str, as_of: str, roi: str = DEFAULTS.roi_name) -> DataFrame:
    """Backfill: rows of the months that ``out`` lacks, each sensor written once, then the merge of those months. ``sensors``: source -> export rows.

    All missing months go in one job, by a join with the table of months. A run that failed can be run again: its months are
    still missing, and exports of them are replaced.
    """
    months = merge.missing_months(spark, files.partitions(spark, out), start, end, as_of)
    for source, rows in sensors.items():
        files.write_csv(_of_months(rows, months), raw, roi, source)
    return merged_dataset(spark, raw, out, roi, months)


def static_s2(clear: DataFrame, phases: DataFrame) -> DataFrame:
    """Bands at peak vigour, green-up and senescence slopes, texture."""
    from vinegrid.operators.scenes import in_phase

    named = dated(clear).withColumns({"ndvi": ix.ndvi(), "ndmi": ix.ndmi(), "ndre": ix.ndre()})
    peak = stats.peak_mosaic(named, ["ndvi", "ndmi", "ndre"])
    phased = in_phase(named, phases).withColumn("t", F.datediff("date", "start").cast("double"))
    fit = stats.linear_fit(phased)
    texture = neighborhood.glcm(peak.select("row", "col", (c("ndvi") * 100).cast("int").alias("level")), "level")
    return peak.join(fit, ["row", "col"], "full").join(texture, ["row", "col"], "full")


def static_s1(px_s1: DataFrame, phases: DataFrame) -> DataFrame:
    from vinegrid.operators.scenes import in_phase

    return stats.phase_means(in_phase(dated(px_s1), phases), "vh", "VH_Early", "VH_Late", "VH_Drop")


def static_terrain(dem: DataFrame, flowacc: DataFrame) -> DataFrame:
    """Slope, topographic wetness and solar exposure."""
    t = neighborhood.terrain(dem)
    twi = F.ln(c("b1") / F.greatest(F.tan(F.radians("slope")), F.lit(0.001)))
    return merge.align_nearest(t, flowacc, 160.0).select("row", "col", "slope", twi.alias("TWI"), (neighborhood.hillshade() / 255).alias("Solar_Rad"))
