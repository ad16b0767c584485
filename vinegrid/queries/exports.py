"""Exports written as CSV or JSON and read back, and the readers' special cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinegrid.adapters import adapter
from vinegrid.config import DEFAULT_RING
from vinegrid.functions import indices as ix
from vinegrid.operators import geometry
from vinegrid.plans import pipelines
from vinegrid.queries.pixels import _DAY, INDEX_SQL
from vinegrid.queries.registry import query
from vinegrid.queries.space import _CLEAR_LST, _FOCAL, _GRID, _NEAR, S2_SQL, TERRAIN_SQL, located_sql
from vinegrid.queries.tables import _ECO, _GEO, _LS, _MERGED, _S1, _VALUES, _tree, shared_folder, sources
from vinegrid.schema import METADATA, STATIC_COLUMNS, export_schema
from vinegrid.sources import files
from vinegrid.streaming import jobs

c = F.col


def _round_trip(spark, df, source):
    """Write a source's export, compressed, and read it as the merge does."""
    base = shared_folder(spark, "export")
    files.write_csv(df, base, "ROI_TEST", source, compression="gzip")
    return files.read_csv(spark, f"{base}/ROI_TEST/{source}", source, static=source in STATIC_COLUMNS, headers=f"{base}/{files.HEADERS}")


def _typed(source, raw):
    return [c(f"`{f.name}`").try_cast(f.dataType).alias("geo" if f.name == ".geo" else f.name) for f in export_schema(source).fields]


def _export(name, source, rows, sql, doubles):
    query(name, sql, doubles)(lambda spark, sf: _round_trip(spark, rows(spark, sf), source))


_export("sink_csv_s1", "sentinel_1", lambda s, d: pipelines.sentinel1(adapter(s, d, "px_s1")), f"WITH {_FOCAL} SELECT {_DAY} AS date, vv AS VV, vh AS VH, vh / nullif(vv, 0) AS RATIOVHVV, {_GEO} AS geo FROM calm", "VV VH RATIOVHVV")

_S2_ROWS = f"SELECT date, NDVI, EVI, GNDVI, IRECI, NDMI, NDRE, valid_pixels, total_pixels, coverage_ratio, observation_valid, erosion_m, is_small_parcel, {_GEO} AS geo FROM ({S2_SQL})"
_S2_DOUBLES = "NDVI EVI GNDVI IRECI NDMI NDRE total_pixels coverage_ratio"


def _s2(spark, sf):
    return pipelines.sentinel2(*(adapter(spark, sf, x) for x in ("px_s2", "px_cs", "px_cld")), adapter(spark, sf, "parcel_edges"))


_export("sink_csv_s2", "sentinel_2", _s2, _S2_ROWS, _S2_DOUBLES)


@query("sink_csv_step2", f"SELECT *, 'output' AS folder FROM ({_S2_ROWS})", _S2_DOUBLES)
def sink_csv_step2(spark, sf):
    """The ad hoc export: one folder of its own, outside the raw tree, replaced by each run."""
    path = f"{shared_folder(spark, 'step2')}/output"
    files.write_single(_s2(spark, sf), path, "sentinel_2", compression="gzip")
    raw = files.csv_rows(spark, path)
    return raw.select(*_typed("sentinel_2", raw), files.folder_of_file().alias("folder"))


@query("src_read_back", f"SELECT CAST(observation_valid AS BIGINT) AS observation_valid, count(*) AS n_rows, count(DISTINCT date) AS dates, avg(coverage_ratio) AS mean_coverage FROM ({_S2_ROWS}) GROUP BY 1", "mean_coverage")
def src_read_back(spark, sf):
    """An exported file read again with types that Spark infers, and summed up."""
    path = f"{shared_folder(spark, 'back')}/output"
    files.write_single(_s2(spark, sf), path, "sentinel_2", compression="gzip")
    back = files.csv_rows(spark, path, infer=True)
    return back.groupBy(c("observation_valid").cast("long").alias("observation_valid")).agg(F.count("*").alias("n_rows"), F.countDistinct("date").alias("dates"), F.avg("coverage_ratio").alias("mean_coverage"))

_LST_ROWS = f"SELECT {_DAY} AS date, LST, f.row, f.col FROM {_GRID} f JOIN ({_CLEAR_LST}) q ON {_NEAR.format(m=30)}"
_export("sink_csv_landsat", "landsat_thermal", lambda s, d: pipelines.landsat(adapter(s, d, "px_landsat"), adapter(s, d, "dem").select("row", "col")), f"SELECT date, LST, {_GEO} AS geo FROM ({_LST_ROWS})", "LST")
_export("sink_csv_srtm", "srtm", lambda s, d: pipelines.srtm(adapter(s, d, "dem"), adapter(s, d, "parcel_edges")), f"WITH {located_sql('dem')}, {TERRAIN_SQL} SELECT elevation, slope, aspect, {_GEO} AS geo FROM terrain JOIN located USING (row, col) WHERE inside", "elevation slope aspect")
_ECO_TS = "(timestamp '2025-06-01 00:00:00' + scene_id * 25 * interval 1 hour)"
_ECO_ROWS = f"SELECT CAST({_ECO_TS} AS date) AS date, lst * 0.02::DOUBLE - 273.15::DOUBLE AS LST_eco, f.row, f.col FROM {_GRID} f JOIN px_eco q ON {_NEAR.format(m=70)} WHERE hour({_ECO_TS}) BETWEEN 9 AND 15"
_export("sink_csv_eco", "ecostress", lambda s, d: pipelines.ecostress(adapter(s, d, "px_eco"), adapter(s, d, "dem").select("row", "col")), f"SELECT date, LST_eco, {_GEO} AS geo FROM ({_ECO_ROWS})", "LST_eco")


@query("sink_csv_eco_empty", "SELECT 'date,LST_eco,.geo' AS header, count(*) AS n_files, (SELECT count(*) FROM px_eco WHERE lst < 0) AS n_rows FROM (SELECT 1)")
def sink_csv_eco_empty(spark, sf):
    """No scene passes: the header alone is written."""
    base = shared_folder(spark, "export")
    files.write_csv(pipelines.ecostress(adapter(spark, sf, "px_eco").where("lst < 0"), adapter(spark, sf, "dem").select("row", "col")), base, "ROI_TEST", "ecostress")
    lines = spark.read.text(f"{base}/ROI_TEST/ecostress")
    rows = files.read_csv(spark, f"{base}/ROI_TEST/ecostress", "ecostress").agg(F.count("*").alias("n_rows"))
    return lines.groupBy(c("value").alias("header")).agg(F.countDistinct("_metadata.file_path").alias("n_files")).crossJoin(F.broadcast(rows))


_ERA = "MIN_TEMP_C MEAN_TEMP_C MAX_TEMP_C RAIN_TOTAL PET_TOTAL AET_TOTAL WDI"
_ERA_SQL = """SELECT CAST(ts AS date) AS date, min(temperature_2m - 273.15::DOUBLE) AS MIN_TEMP_C, avg(temperature_2m - 273.15::DOUBLE) AS MEAN_TEMP_C, max(temperature_2m - 273.15::DOUBLE) AS MAX_TEMP_C,
    sum(total_precipitation_hourly) AS RAIN_TOTAL, sum(potential_evaporation) AS PET_TOTAL, sum(evaporation_from_vegetation_transpiration) AS AET_TOTAL, sum(potential_evaporation) - sum(total_precipitation_hourly) AS WDI, 'cell ' || cell_id AS geo
    FROM era5_hourly WHERE month(ts) BETWEEN 4 AND 9 GROUP BY cell_id, CAST(ts AS date)"""
_export("sink_csv_era5", "era5", lambda s, d: pipelines.era5(adapter(s, d, "era5_hourly")).where("MEAN_TEMP_C IS NOT NULL").withColumn("geo", F.concat(F.lit("cell "), c("cell_id").cast("string"))), _ERA_SQL, _ERA)


@query("src_parent_folder", f"WITH {_S1}, {_ECO}, {_LS} SELECT 'sentinel_1' AS source, count(*) AS n FROM s1 UNION ALL SELECT 'ecostress', count(*) FROM eco UNION ALL SELECT 'landsat_thermal', count(*) FROM ls")
def src_parent_folder(spark, sf):
    """Rows by the folder of their source; a source whose files hold the header alone has none."""
    base = _tree(spark, sf)
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").option("header", True).option("escape", '"').schema("date string").csv(base)
    counted = raw.select(files.parent_folder().alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    folders = files.csv_files(spark, base).select("source").distinct()
    return folders.join(counted, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"))


@query("src_strip_header", f"WITH {_ECO} SELECT date, geo, LST_eco FROM eco", "LST_eco")
def src_strip_header(spark, sf):
    base = shared_folder(spark, "blanks")
    padded = sources(spark, sf)["ecostress"].select(c("date").alias(" date"), c("LST_eco").alias("LST_eco "), c("geo").alias(" .geo "))
    padded.write.option("header", True).option("escape", '"').csv(f"{base}/ROI_TEST/ecostress")
    return files.read_csv(spark, base, "ecostress").select("date", "geo", "LST_eco")


@query("src_skip_static", f"WITH {_ECO}, {TERRAIN_SQL} SELECT 'ecostress' AS source, false AS static, count(*) AS n FROM eco UNION ALL SELECT 'srtm', true, count(*) FROM terrain")
def src_skip_static(spark, sf):
    """Which sources take part in the merge and which are static."""
    from vinegrid.operators import neighborhood

    base = shared_folder(spark, "raw")
    files.write_csv(sources(spark, sf)["ecostress"], base, "ROI_TEST", "ecostress")
    files.write_csv(neighborhood.terrain(adapter(spark, sf, "dem")).withColumn("geo", pipelines.geo()), base, "ROI_TEST", "srtm")
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("source"), F.lit(static).alias("static"), "n") for static, found in ((False, files.read_sources(spark, base)), (True, files.read_static(spark, base))) for k, df in found.items()]
    return counted[0].union(counted[1])


@query("src_skip_bad", f"WITH {_ECO} SELECT date, geo, LST_eco FROM eco WHERE day(date) % 7 <> 0", "LST_eco")
def src_skip_bad(spark, sf):
    """Rows whose date does not parse are left out."""
    base = shared_folder(spark, "bad")
    eco = sources(spark, sf)["ecostress"]
    broken = eco.select(F.when(F.day("date") % 7 == 0, F.lit("no date")).otherwise(c("date").cast("string")).alias("date"), "LST_eco", c("geo").alias(".geo"))
    broken.write.option("header", True).option("escape", '"').csv(f"{base}/ROI_TEST/ecostress")
    return files.read_csv(spark, base, "ecostress").select("date", "geo", "LST_eco")


@query("sink_metadata", "SELECT sensor AS source, count(DISTINCT scene_id) AS image_count, '1995-01-01 to 2001-08-01' AS date_range, 'success' AS status, 'r1' AS run_id, CAST(24 AS INTEGER) AS vertices FROM scenes GROUP BY 1")
def sink_metadata(spark, sf):
    path = shared_folder(spark, "meta")
    bands = {"S1": ["VV", "VH"], "S2": ["NDVI", "EVI"], "L8": ["LST"], "L9": ["LST"], "ECO": ["LST_eco"]}
    files.write_metadata(files.metadata(adapter(spark, sf, "scenes"), "r1", "2025-06-01T00:00:00", "1995-01-01", "2001-08-01", bands, DEFAULT_RING), path)
    return spark.read.schema(METADATA).json(path).select("source", "image_count", "date_range", "status", "run_id", F.size(c("roi_coords")[0]).alias("vertices"))


@query("st_ingest_csv", f"WITH {_S1}, {_ECO}, {_LS} SELECT date, geo, LST_eco, LST, VV, VH, RATIOVHVV FROM ({_MERGED})", _VALUES)
def st_ingest_csv(spark, sf):
    """First two sources arrive, then the third: its months are merged anew."""
    out, raw, state = (shared_folder(spark, x) for x in ("merged", "raw", "state"))
    found = sources(spark, sf)
    for arrived in (("sentinel_1", "landsat_thermal"), ("ecostress",)):
        for source in arrived:
            files.write_csv(found[source], raw, "ROI_TEST", source)
        jobs.ingest_csv(spark, raw, out, state, roi="ROI_TEST")
    return spark.read.option("mergeSchema", True).parquet(out).select("date", "geo", *_VALUES.split())


@query("src_csv_layouts", f"WITH {_S1} SELECT date, geo, VV, VH, CASE WHEN day(date) % 2 = 0 THEN RATIOVHVV END AS RATIOVHVV FROM s1", "VV VH RATIOVHVV")
def src_csv_layouts(spark, sf):
    """Files of one source with other columns in another order, matched by their own headers."""
    base = shared_folder(spark, "layouts")
    rows = sources(spark, sf)["sentinel_1"]
    files.write_csv(rows.where(F.day("date") % 2 == 0), base, "ROI_TEST", "sentinel_1")
    other = rows.where(F.day("date") % 2 == 1).select(c("VH").alias(" VH"), c("geo").alias(".geo"), "date", "VV")
    other.write.option("header", True).option("escape", '"').csv(f"{base}/ROI_TEST/sentinel_1/other")
    return files.read_sources(spark, base)["sentinel_1"].select("date", "geo", "VV", "VH", "RATIOVHVV")


@query("src_unknown_source", f"WITH {_ECO} SELECT date, geo, LST_eco AS canopy FROM eco", "canopy")
def src_unknown_source(spark, sf):
    """A folder whose name is new takes part by its files' headers."""
    base = shared_folder(spark, "unknown")
    sources(spark, sf)["ecostress"].select("date", c("LST_eco").alias("canopy"), c("geo").alias(".geo")).write.option("header", True).option("escape", '"').csv(f"{base}/ROI_TEST/drone")
    return files.read_sources(spark, base)["drone"].select("date", "geo", "canopy")


@query("src_roi_geojson", "SELECT parcel_id, count(*) AS edges, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area_m2 FROM parcel_edges GROUP BY 1", "area_m2")
def src_roi_geojson(spark, sf):
    """Parcels written as GeoJSON text, parsed again to edges."""
    corners = adapter(spark, sf, "parcel_edges").groupBy("parcel_id").agg(F.sort_array(F.collect_list(F.struct("edge_id", F.array("x1", "y1").alias("p")))).alias("s"))
    text = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform("s", lambda x: x["p"])).alias("coordinates")))
    edges = geometry.edges_of_geojson(corners.select("parcel_id", text.alias("geojson")))
    return geometry.areas(edges).join(edges.groupBy("parcel_id").agg(F.count("*").alias("edges")), "parcel_id").select("parcel_id", "edges", "area_m2")


@query("udf_feature_map", f"SELECT scene_id, row, col, {_DAY} AS date, {INDEX_SQL['NDVI']} AS NDVI, 10 AS erosion_m, CAST(scl IN (4, 5, 6) AS INTEGER) AS observation_valid FROM px_s2", "NDVI")
def udf_feature_map(spark, sf):
    df = pipelines.dated(adapter(spark, sf, "px_s2"))
    return ix.add_columns(df, {"NDVI": ix.ndvi(), "erosion_m": F.lit(10), "observation_valid": ix.clear_scl().cast("int")}).select("scene_id", "row", "col", "date", "NDVI", "erosion_m", "observation_valid")
