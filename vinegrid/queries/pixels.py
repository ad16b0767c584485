"""Sources, filters, masks, indices, conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinegrid.adapters import adapter
from vinegrid.functions import indices as ix
from vinegrid.operators import merge, scenes
from vinegrid.plans.pipelines import dated, geo
from vinegrid.queries.registry import query
from vinegrid.sources import pixels
from vinegrid.sources.files import shared_folder

c = F.col
START, END = "1996-01-01", "1998-07-01"
SCENE_COLUMNS = ["scene_id", "acquired_at", "sensor", "cloud_pct"]
_DATES = f"acquired_at >= timestamp '{START}' AND acquired_at < timestamp '{END}'"


def _scenes(spark, sf):
    return adapter(spark, sf, "scenes")


def stored(spark, sf, *names):
    """Pixel tables of a sensor as they are stored: by day, in buckets of scene tiles. A scene's number counts its days from the first."""
    base = shared_folder(spark, "pixels")
    key = base.rsplit("-", 1)[-1]
    return [pixels.write_pixels(dated(adapter(spark, sf, x)).withColumnRenamed("date", pixels.DAY), f"{x}_{key}", f"{base}/{x}", buckets=2) for x in names]


def stored_with_scenes(spark, sf, name):
    """As ``stored``, on the days that the scene table gives."""
    days = _scenes(spark, sf).select("scene_id", F.to_date("acquired_at").alias(pixels.DAY))
    base = shared_folder(spark, "pixels")
    return pixels.write_pixels(adapter(spark, sf, name).join(days, "scene_id"), f"{name}_{base.rsplit('-', 1)[-1]}", f"{base}/{name}", buckets=2)


# 2.1 sources and 2.3 filters on scenes


@query("scan_scenes", f"SELECT scene_id, acquired_at, sensor, cloud_pct FROM scenes WHERE sensor = 'S2' AND {_DATES} AND cloud_pct < 50")
def scan_scenes(spark, sf):
    return scenes.retrieve(_scenes(spark, sf), ["S2"], START, END, cloud_max=50.0).select(*SCENE_COLUMNS)


def _filter(name, column, sql):
    query(name, f"SELECT scene_id, acquired_at, sensor, cloud_pct FROM scenes WHERE {sql}")(lambda spark, sf: _scenes(spark, sf).where(column()).select(*SCENE_COLUMNS))


_filter("flt_bounds", lambda: scenes.in_bounds(100, 300, 50, 200), "min_x <= 300 AND max_x >= 100 AND min_y <= 200 AND max_y >= 50")
_filter("flt_date", lambda: scenes.in_dates(START, END), _DATES)
_filter("flt_cloud", lambda: c("cloud_pct") < 50.0, "cloud_pct < 50")
_filter("flt_season", lambda: scenes.in_season(), "month(acquired_at) BETWEEN 4 AND 9")
_filter("flt_polarisation", lambda: scenes.has_polarisations(["VV", "VH"]), "list_contains(polarisations, 'VV') AND list_contains(polarisations, 'VH')")
_filter("flt_mode", lambda: c("instrument_mode") == "IW", "instrument_mode = 'IW'")
_filter("flt_orbit", lambda: c("orbit_pass") == "ASCENDING", "orbit_pass = 'ASCENDING'")


@query("flt_hour", "SELECT cell_id, ts, hour(ts) AS hour, temperature_2m FROM era5_hourly WHERE hour(ts) BETWEEN 9 AND 15", "temperature_2m")
def flt_hour(spark, sf):
    return adapter(spark, sf, "era5_hourly").where(scenes.in_hours("ts")).select("cell_id", "ts", F.hour("ts").cast("long").alias("hour"), "temperature_2m")


def phases(spark):
    """T1 and T2."""
    return spark.sql("SELECT * FROM VALUES ('T1', date'2025-06-01', date'2025-07-20'), ('T2', date'2025-07-21', date'2025-09-10') AS p(phase, start, end)")


PHASES_SQL = "(SELECT * FROM (VALUES ('T1', date '2025-06-01', date '2025-07-20'), ('T2', date '2025-07-21', date '2025-09-10')) p(phase, start, stop))"
_DAY = "CAST(date '2025-06-01' + scene_id AS date)"


@query("flt_phase", f"SELECT scene_id, row, col, {_DAY} AS date, phase FROM px_s2 JOIN {PHASES_SQL} p ON {_DAY} BETWEEN start AND stop")
def flt_phase(spark, sf):
    return scenes.in_phase(dated(adapter(spark, sf, "px_s2")), phases(spark)).select("scene_id", "row", "col", "date", "phase")


@query("src_s2", f"SELECT scene_id, row, col, {_DAY} AS date, b4, b8, scl FROM px_s2 WHERE {_DAY} >= date '2025-06-10' AND {_DAY} < date '2025-08-01'")
def src_s2(spark, sf):
    (px,) = stored(spark, sf, "px_s2")
    return pixels.of_days(px, "2025-06-10", "2025-08-01").select("scene_id", "row", "col", c(pixels.DAY).alias("date"), "b4", "b8", "scl")


@query("src_cloudscore", "SELECT scene_id, row, col, cs AS cs_cs, cs_cdf AS cs_cs_cdf FROM px_cs", "cs_cs cs_cs_cdf")
def src_cloudscore(spark, sf):
    return adapter(spark, sf, "px_cs").withColumnsRenamed({"cs": "cs_cs", "cs_cdf": "cs_cs_cdf"})


@query("src_cloudprob", "SELECT scene_id, row, col, probability AS cld_probability FROM px_cld", "cld_probability")
def src_cloudprob(spark, sf):
    return adapter(spark, sf, "px_cld").withColumnsRenamed({"probability": "cld_probability"})


@query("src_s1", "SELECT p.scene_id, row, col, vv, vh FROM px_s1 p JOIN scenes s ON p.scene_id = s.scene_id WHERE s.sensor = 'S1' AND list_contains(polarisations, 'VV') AND list_contains(polarisations, 'VH') AND instrument_mode = 'IW' AND orbit_pass = 'ASCENDING'", "vv vh")
def src_s1(spark, sf):
    kept = scenes.retrieve(_scenes(spark, sf), ["S1"], polarisations=["VV", "VH"], mode="IW", orbit="ASCENDING")
    kept = kept.select("scene_id", F.to_date("acquired_at").alias(pixels.DAY))
    return pixels.of_scenes(stored_with_scenes(spark, sf, "px_s1"), kept).select("scene_id", "row", "col", "vv", "vh")


_LANDSAT = "SELECT scene_id, acquired_at, sensor, cloud_pct FROM scenes WHERE sensor = 'L9' AND cloud_pct < 80 UNION ALL SELECT scene_id, acquired_at, sensor, cloud_pct FROM scenes WHERE sensor = 'L8' AND cloud_pct < 80"


@query("src_landsat", f"SELECT p.scene_id, row, col, st_b10, qa_pixel FROM px_landsat p JOIN ({_LANDSAT}) s ON p.scene_id = s.scene_id")
def src_landsat(spark, sf):
    kept = scenes.landsat_scenes(_scenes(spark, sf)).select("scene_id", F.to_date("acquired_at").alias(pixels.DAY))
    return pixels.of_scenes(stored_with_scenes(spark, sf, "px_landsat"), kept).select("scene_id", "row", "col", "st_b10", "qa_pixel")


@query("set_merge", _LANDSAT)
def set_merge(spark, sf):
    return scenes.landsat_scenes(_scenes(spark, sf)).select(*SCENE_COLUMNS)


@query("src_era5", "SELECT cell_id, ts, temperature_2m, dewpoint_temperature_2m FROM era5_hourly WHERE month(ts) BETWEEN 4 AND 9", "temperature_2m dewpoint_temperature_2m")
def src_era5(spark, sf):
    return adapter(spark, sf, "era5_hourly").where(scenes.in_season("ts")).select("cell_id", "ts", "temperature_2m", "dewpoint_temperature_2m")


_ECO_DAY = "(timestamp '2025-06-01 00:00:00' + scene_id * 25 * interval 1 hour)"


@query("src_ecostress", f"SELECT scene_id, row, col, lst, CAST(hour({_ECO_DAY}) AS INTEGER) AS hour FROM px_eco WHERE hour({_ECO_DAY}) BETWEEN 9 AND 15")
def src_ecostress(spark, sf):
    ts = F.timestamp_millis(F.unix_millis(F.lit("2025-06-01").cast("timestamp")) + c("scene_id").cast("long") * 25 * 3600 * 1000)
    return adapter(spark, sf, "px_eco").withColumn("hour", F.hour(ts)).where(c("hour").between(9, 15)).select("scene_id", "row", "col", "lst", "hour")


@query("src_flowacc", "SELECT row, col, b1 FROM flowacc", "b1")
def src_flowacc(spark, sf):
    return adapter(spark, sf, "flowacc")


@query("lim_first", "SELECT scene_id, acquired_at, sensor, cloud_pct FROM scenes ORDER BY acquired_at, scene_id LIMIT 1")
def lim_first(spark, sf):
    return _scenes(spark, sf).orderBy("acquired_at", "scene_id").select(*SCENE_COLUMNS).limit(1)


@query("lim_head", "SELECT scene_id, acquired_at, sensor, cloud_pct FROM scenes ORDER BY scene_id LIMIT 5")
def lim_head(spark, sf):
    return _scenes(spark, sf).orderBy("scene_id").select(*SCENE_COLUMNS).limit(5)


@query("agg_scene_count", "SELECT sensor, count(DISTINCT scene_id) AS n, count(*) = 0 AS is_empty FROM scenes GROUP BY sensor")
def agg_scene_count(spark, sf):
    return _scenes(spark, sf).groupBy("sensor").agg(F.countDistinct("scene_id").alias("n"), (F.count("*") == 0).alias("is_empty"))


# masks

_COMBINED = "px_s2 JOIN px_cs USING (scene_id, row, col) JOIN px_cld USING (scene_id, row, col)"
_CS, _CLD, _SCL = "(cs >= 0.60 AND cs_cdf >= 0.70)", "(probability <= 30)", "(scl IN (4, 5, 6))"


def combined(spark, sf):
    return merge.combine(*(adapter(spark, sf, x) for x in ("px_s2", "px_cs", "px_cld")))


def _mask(name, source, column, sql, of):
    query(name, f"SELECT scene_id, row, col, {sql} AS clear FROM {source}")(lambda spark, sf: of(spark, sf).select("scene_id", "row", "col", column().alias("clear")))


_mask("msk_cloudscore", "px_cs", ix.clear_cloudscore, _CS, lambda s, d: adapter(s, d, "px_cs"))
_mask("msk_cloudprob", "px_cld", ix.clear_probability, _CLD, lambda s, d: adapter(s, d, "px_cld"))
_mask("msk_scl", "px_s2", ix.clear_scl, _SCL, lambda s, d: adapter(s, d, "px_s2"))
_mask("msk_ensemble", _COMBINED, ix.clear_ensemble, f"{_CS} AND {_CLD} AND {_SCL}", combined)
_mask("msk_qa_pixel", "px_landsat", lambda: ix.bits_unset("qa_pixel", 3, 4), "qa_pixel & 8 = 0 AND qa_pixel & 16 = 0", lambda s, d: adapter(s, d, "px_landsat"))
_mask("msk_qa60", "px_landsat", lambda: ix.bits_unset("st_b10", 10, 11), "st_b10 & 1024 = 0 AND st_b10 & 2048 = 0", lambda s, d: adapter(s, d, "px_landsat"))
_mask("msk_dark", "px_s2", ix.dark, "b8 / 10000 < 0.15 AND scl <> 6", lambda s, d: adapter(s, d, "px_s2"))


@query("jn_combine", f"SELECT scene_id, row, col, b4, b8, cs, cs_cdf, probability FROM {_COMBINED}", "cs cs_cdf probability")
def jn_combine(spark, sf):
    return merge.combine(*stored(spark, sf, "px_s2", "px_cs", "px_cld")).select("scene_id", "row", "col", "b4", "b8", "cs", "cs_cdf", "probability")


@query("msk_apply", "SELECT scene_id, row, col, CASE WHEN scl IN (4, 5, 6) THEN b4 END AS b4, CASE WHEN scl IN (4, 5, 6) THEN b8 END AS b8 FROM px_s2")
def msk_apply(spark, sf):
    return adapter(spark, sf, "px_s2").select("scene_id", "row", "col", *[F.when(ix.clear_scl(), c(b)).alias(b) for b in ("b4", "b8")])


@query("flt_drop_masked", "SELECT scene_id, row, col, b4, b8 FROM px_s2 WHERE scl IN (4, 5, 6)")
def flt_drop_masked(spark, sf):
    return msk_apply(spark, sf).dropna(subset=["b4", "b8"])


@query("flt_sanitise", "SELECT scene_id, row, col, b4, b8, b4 BETWEEN 600 AND 3200 AND b8 BETWEEN 600 AND 3200 AS sound FROM px_s2")
def flt_sanitise(spark, sf):
    good, bad = scenes.rejects(adapter(spark, sf, "px_s2").select("scene_id", "row", "col", "b4", "b8"), ["b4", "b8"], 600, 3200)
    return good.withColumn("sound", F.lit(True)).unionByName(bad.withColumn("sound", F.lit(False)))


# indices

INDEX_SQL = {
    "NDVI": "(b8 - b4) / nullif(b8 + b4, 0)",
    "EVI": "2.5::DOUBLE * (b8 / 10000 - b4 / 10000) / nullif(b8 / 10000 + 6 * (b4 / 10000) - 7.5::DOUBLE * (b2 / 10000) + 1, 0)",
    "GNDVI": "(b8 - b3) / nullif(b8 + b3, 0)",
    "IRECI": "(b7 - b4) / nullif(b5 / nullif(b6, 0), 0)",
    "NDMI": "(b8 - b11) / nullif(b8 + b11, 0)",
    "MNDWI": "(b3 - b11) / nullif(b3 + b11, 0)",
    "NDRE": "(b8 - b5) / nullif(b8 + b5, 0)",
    "CIREDEDGE": "b7 / nullif(b5, 0) - 1",
}
AS_WRITTEN_SQL = {"IRECI": "(b5 - b4) / nullif(b11 / nullif(b11, 0), 0)", "NDRE": INDEX_SQL["MNDWI"], "CIREDEDGE": "b5 / nullif(b11, 0) - 1"}
_INDEX = {"NDVI": ix.ndvi, "EVI": ix.evi, "GNDVI": ix.gndvi, "IRECI": ix.ireci, "NDMI": ix.ndmi, "MNDWI": ix.mndwi, "NDRE": ix.ndre, "CIREDEDGE": ix.cirededge}


def _index(name):
    both = name in AS_WRITTEN_SQL
    sql = f"SELECT scene_id, row, col, {INDEX_SQL[name]} AS {name}" + (f", {AS_WRITTEN_SQL[name]} AS {name}_as_written" if both else "") + " FROM px_s2"

    def run(spark, sf):
        columns = {name: _INDEX[name]()} | ({f"{name}_as_written": _INDEX[name]("as_written")} if both else {})
        return ix.add_columns(adapter(spark, sf, "px_s2").select("scene_id", "row", "col", *[b for b in ("b2", "b3", "b4", "b5", "b6", "b7", "b8", "b11")]), columns).select("scene_id", "row", "col", *columns)

    query(f"ix_{name.lower()}", sql, exact=True)(run)


for _name in _INDEX:
    _index(_name)

ALL = ["NDVI", "EVI", "GNDVI", "IRECI", "NDMI", "NDRE", "MNDWI"]


@query("ix_all_s2", "SELECT scene_id, row, col, " + ", ".join(f"{INDEX_SQL[x]} AS {x}" for x in ALL) + f", CAST(epoch_ms(CAST({_DAY} AS timestamp)) AS DOUBLE) AS date_band FROM px_s2", exact=True)
def ix_all_s2(spark, sf):
    df = ix.add_columns(dated(adapter(spark, sf, "px_s2")), ix.s2_indices())
    return df.select("scene_id", "row", "col", *ALL, F.unix_millis(c("date").cast("timestamp")).cast("double").alias("date_band"))


@query("ix_ratio_s1", "SELECT scene_id, row, col, vh / nullif(vv, 0) AS RATIOVHVV, vh - vv AS RATIO_DB FROM px_s1", exact=True)
def ix_ratio_s1(spark, sf):
    return adapter(spark, sf, "px_s1").select("scene_id", "row", "col", ix.ratio_vh_vv().alias("RATIOVHVV"), ix.ratio_vh_vv(db=True).alias("RATIO_DB"))


@query("ix_all_s1", f"SELECT scene_id, row, col, vv AS VV, vh AS VH, vh / nullif(vv, 0) AS RATIOVHVV, CAST(epoch_ms(CAST({_DAY} AS timestamp)) AS DOUBLE) AS date_band FROM px_s1", exact=True)
def ix_all_s1(spark, sf):
    df = dated(adapter(spark, sf, "px_s1"))
    return df.select("scene_id", "row", "col", c("vv").alias("VV"), c("vh").alias("VH"), ix.ratio_vh_vv().alias("RATIOVHVV"), F.unix_millis(c("date").cast("timestamp")).cast("double").alias("date_band"))


# conversions


def _convert(name, source, keys, columns, sql, doubles):
    query(name, f"SELECT {', '.join(keys)}, {sql} FROM {source}", doubles)(lambda spark, sf: adapter(spark, sf, source).select(*keys, *columns()))


_PX, _ERA = ["scene_id", "row", "col"], ["cell_id", "ts"]
LST_SQL = "st_b10 * 0.00341802::DOUBLE + 149.0::DOUBLE - 273.15::DOUBLE"
_convert("cv_lst_landsat", "px_landsat", _PX, lambda: [ix.lst_landsat().alias("LST")], f"{LST_SQL} AS LST", "LST")
_convert("cv_lst_eco", "px_eco", _PX, lambda: [ix.lst_ecostress().alias("LST_eco")], "lst * 0.02::DOUBLE - 273.15::DOUBLE AS LST_eco", "LST_eco")
_convert("cv_lst_dispatch", "px_landsat", _PX, lambda: [ix.to_celsius("landsat").alias("LST")], f"{LST_SQL} AS LST", "LST")
_convert("cv_temp_c", "era5_hourly", _ERA, lambda: [ix.era5_columns()["temp_c"].alias("temp_c"), ix.era5_columns()["dew_c"].alias("dew_c")], "temperature_2m - 273.15::DOUBLE AS temp_c, dewpoint_temperature_2m - 273.15::DOUBLE AS dew_c", "temp_c dew_c")
_convert("cv_water", "era5_hourly", _ERA, lambda: [ix.era5_columns()[x].alias(x) for x in ("precip", "pet", "aet")], "total_precipitation_hourly AS precip, potential_evaporation AS pet, evaporation_from_vegetation_transpiration AS aet", "precip pet aet")
_convert("cv_radiation", "era5_hourly", _ERA, lambda: [ix.era5_columns()["rad"].alias("rad")], "greatest(surface_net_solar_radiation, 0.0::DOUBLE) AS rad", "rad")
WIND_SQL = "sqrt(u_component_of_wind_10m * u_component_of_wind_10m + v_component_of_wind_10m * v_component_of_wind_10m) * 0.748::DOUBLE"
_convert("cv_wind2m", "era5_hourly", _ERA, lambda: [ix.wind_2m().alias("wind2m")], f"{WIND_SQL} AS wind2m", "wind2m")
GDD_SQL = "greatest(temperature_2m - 283.15::DOUBLE, 0.0::DOUBLE) / 24"
_convert("cv_gdd", "era5_hourly", _ERA, lambda: [ix.growing_degree_hour().alias("gdd")], f"{GDD_SQL} AS gdd", "gdd")
_convert("cv_era5", "era5_hourly", _ERA, lambda: [v.alias(k) for k, v in ix.era5_columns().items()], f"temperature_2m - 273.15::DOUBLE AS temp_c, dewpoint_temperature_2m - 273.15::DOUBLE AS dew_c, total_precipitation_hourly AS precip, potential_evaporation AS pet, evaporation_from_vegetation_transpiration AS aet, greatest(surface_net_solar_radiation, 0.0::DOUBLE) AS rad, {WIND_SQL} AS wind2m, {GDD_SQL} AS gdd", "temp_c dew_c precip pet aet rad wind2m gdd")
_convert("cv_hour_prop", "era5_hourly", _ERA, lambda: [F.hour("ts").cast("long").alias("hour")], "hour(ts) AS hour", "")
_convert("cv_scale_int", "px_s2", _PX, lambda: [(ix.ndvi() * 100).cast("int").alias("level")], f"CAST(trunc({INDEX_SQL['NDVI']} * 100) AS INTEGER) AS level", "")
_convert("cv_select_rename", "px_s2", _PX, lambda: [c("b4").alias("red"), c("b8").alias("nir")], "b4 AS red, b8 AS nir", "")
_convert("cv_add_bands", "px_s2", _PX, lambda: ["b4", "b8", ix.ndvi().alias("NDVI"), ix.ndmi().alias("NDMI")], f"b4, b8, {INDEX_SQL['NDVI']} AS NDVI, {INDEX_SQL['NDMI']} AS NDMI", "NDVI NDMI")


@query("cv_tdays", f"SELECT scene_id, row, col, phase, CAST({_DAY} - start AS DOUBLE) AS t FROM px_s2 JOIN {PHASES_SQL} p ON {_DAY} BETWEEN start AND stop", "t")
def cv_tdays(spark, sf):
    df = scenes.in_phase(dated(adapter(spark, sf, "px_s2")), phases(spark))
    return df.select("scene_id", "row", "col", "phase", ix.days_since(c("date").cast("timestamp"), c("start").cast("timestamp")).alias("t"))


@query("cv_date_str", "SELECT scene_id, strftime(acquired_at, '%Y-%m-%d') AS day FROM scenes")
def cv_date_str(spark, sf):
    return _scenes(spark, sf).select("scene_id", F.date_format("acquired_at", "yyyy-MM-dd").alias("day"))


@query("cv_date_band", "SELECT scene_id, CAST(epoch_ms(acquired_at) AS DOUBLE) AS millis FROM scenes")
def cv_date_band(spark, sf):
    return _scenes(spark, sf).select("scene_id", F.unix_millis(c("acquired_at").cast("timestamp")).cast("double").alias("millis"))


@query("cv_year_month", "SELECT scene_id, CAST(year(acquired_at) AS INTEGER) AS year, CAST(month(acquired_at) AS INTEGER) AS month FROM scenes")
def cv_year_month(spark, sf):
    return merge.with_year_month(_scenes(spark, sf), "acquired_at").select("scene_id", "year", "month")


@query("cv_parse_date", "SELECT scene_id, CAST(acquired_at AS date) AS date FROM scenes")
def cv_parse_date(spark, sf):
    return cv_date_str(spark, sf).select("scene_id", F.try_to_date("day").alias("date"))


@query("cv_geo_point", """SELECT scene_id, row, col, '{"type":"Point","coordinates":[' || CAST(CAST(col * 10 + 5 AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST(row * 10 + 5 AS DOUBLE) AS VARCHAR) || ']}' AS geo FROM px_s1""")
def cv_geo_point(spark, sf):
    return adapter(spark, sf, "px_s1").select("scene_id", "row", "col", geo().alias("geo"))


@query("set_flatten", "SELECT scene_id, unnest(polarisations) AS polarisation FROM scenes")
def set_flatten(spark, sf):
    return _scenes(spark, sf).select("scene_id", F.explode("polarisations").alias("polarisation"))


@query("udaf_combined", "SELECT scene_id, min(b8) AS low, avg(b8) AS mean, max(b8) AS high, count(b8) AS n FROM px_s2 GROUP BY 1", "mean")
def udaf_combined(spark, sf):
    return adapter(spark, sf, "px_s2").groupBy("scene_id").agg(F.min("b8").alias("low"), F.avg("b8").alias("mean"), F.max("b8").alias("high"), F.count("b8").alias("n"))


@query("udf_map", f"SELECT scene_id, row, col, {_DAY} AS date, {INDEX_SQL['NDVI']} AS NDVI FROM px_s2 WHERE scl IN (4, 5, 6)", "NDVI")
def udf_map(spark, sf):
    return adapter(spark, sf, "px_s2").transform(dated).transform(lambda df: df.where(ix.clear_scl())).transform(lambda df: ix.add_columns(df, {"NDVI": ix.ndvi()})).select("scene_id", "row", "col", "date", "NDVI")
