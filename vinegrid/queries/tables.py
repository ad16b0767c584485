"""Merging, backfill, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinegrid.adapters import adapter, table
from vinegrid.config import DEFAULT_RING
from vinegrid.functions import indices as ix
from vinegrid.operators import merge
from vinegrid.plans import pipelines
from vinegrid.plans.pipelines import dated, geo
from vinegrid.queries.pixels import _DAY
from vinegrid.queries.registry import query
from vinegrid.sources import files
from vinegrid.sources.files import shared_folder
from vinegrid.streaming import jobs

c = F.col
_GEO = """'{"type":"Point","coordinates":[' || CAST(CAST(col * 10 + 5 AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST(row * 10 + 5 AS DOUBLE) AS VARCHAR) || ']}'"""
_S1 = f"s1 AS (SELECT {_DAY} AS date, {_GEO} AS geo, vv AS VV, vh AS VH, vh / nullif(vv, 0) AS RATIOVHVV FROM px_s1)"
_ECO = f"eco AS (SELECT {_DAY} AS date, {_GEO} AS geo, lst * 0.02::DOUBLE - 273.15::DOUBLE AS LST_eco FROM px_eco)"
_LS = f"ls AS (SELECT {_DAY} AS date, {_GEO} AS geo, st_b10 * 0.00341802::DOUBLE + 149.0::DOUBLE - 273.15::DOUBLE AS LST FROM px_landsat WHERE qa_pixel & 8 = 0 AND qa_pixel & 16 = 0)"
_MERGED = "SELECT date, geo, LST_eco, LST, VV, VH, RATIOVHVV FROM eco FULL JOIN ls USING (date, geo) FULL JOIN s1 USING (date, geo)"


def sources(spark, sf):
    """Three exports at their own cells, as the raw tree would hold them."""
    s1 = dated(adapter(spark, sf, "px_s1")).select("date", geo().alias("geo"), c("vv").alias("VV"), c("vh").alias("VH"), ix.ratio_vh_vv().alias("RATIOVHVV"))
    eco = dated(adapter(spark, sf, "px_eco")).select("date", geo().alias("geo"), ix.lst_ecostress().alias("LST_eco"))
    ls = dated(adapter(spark, sf, "px_landsat").where(ix.bits_unset("qa_pixel", 3, 4))).select("date", geo().alias("geo"), ix.lst_landsat().alias("LST"))
    return {"sentinel_1": s1, "ecostress": eco, "landsat_thermal": ls}


_VALUES = "LST_eco LST VV VH RATIOVHVV"


@query("jn_outer_merge", f"WITH {_S1}, {_ECO} SELECT date, geo, LST_eco, VV, VH, RATIOVHVV FROM eco FULL JOIN s1 USING (date, geo)", "LST_eco VV VH RATIOVHVV")
def jn_outer_merge(spark, sf):
    found = sources(spark, sf)
    return merge.outer_merge({k: found[k] for k in ("ecostress", "sentinel_1")}).select("date", "geo", "LST_eco", "VV", "VH", "RATIOVHVV")


@query("jn_nway", f"WITH {_S1}, {_ECO}, {_LS} {_MERGED}", _VALUES)
def jn_nway(spark, sf):
    return merge.outer_merge(sources(spark, sf)).select("date", "geo", *_VALUES.split())


@query("jn_suffix", f"WITH {_ECO}, {_LS} SELECT date, geo, LST_eco AS ecostress_value, LST AS landsat_thermal_value FROM eco FULL JOIN ls USING (date, geo)", "ecostress_value landsat_thermal_value")
def jn_suffix(spark, sf):
    found = sources(spark, sf)
    pair = {"ecostress": found["ecostress"].withColumnRenamed("LST_eco", "value"), "landsat_thermal": found["landsat_thermal"].withColumnRenamed("LST", "value")}
    return merge.outer_merge(pair).select("date", "geo", "ecostress_value", "landsat_thermal_value")


@query("set_stack", f"WITH {_ECO}, {_LS} SELECT date, geo, LST_eco, CAST(NULL AS DOUBLE) AS LST FROM eco UNION ALL SELECT date, geo, NULL, LST FROM ls", "LST_eco LST")
def set_stack(spark, sf):
    found = sources(spark, sf)
    return found["ecostress"].unionByName(found["landsat_thermal"], allowMissingColumns=True)


_PRESENT = "SELECT DISTINCT year(acquired_at) AS year, month(acquired_at) AS month FROM scenes WHERE month(acquired_at) % 3 <> 0"


@query("jn_missing_months", f"""WITH present AS ({_PRESENT}), wanted AS (SELECT CAST(unnest(generate_series(timestamp '1996-02-01', timestamp '1998-03-10', interval 1 month)) AS date) AS month_start)
    SELECT month_start, CAST(year(month_start) AS INTEGER) AS year, CAST(month(month_start) AS INTEGER) AS month FROM wanted WHERE month_start <= date '1998-02-15'
    AND NOT EXISTS (SELECT 1 FROM present p WHERE p.year = year(month_start) AND p.month = month(month_start))""")
def jn_missing_months(spark, sf):
    present = merge.with_year_month(adapter(spark, sf, "scenes"), "acquired_at").where("month % 3 <> 0")
    return merge.missing_months(spark, present, "1996-02-11", "1998-03-10", "1998-02-15")


@query("agg_metadata", "SELECT sensor AS source, count(DISTINCT scene_id) AS image_count, '1995-01-01 to 2001-08-01' AS date_range, 'success' AS status FROM scenes GROUP BY 1")
def agg_metadata(spark, sf):
    bands = {"S1": ["VV", "VH"], "S2": ["NDVI", "EVI"], "L8": ["LST"], "L9": ["LST"], "ECO": ["LST_eco"]}
    return files.metadata(adapter(spark, sf, "scenes"), "run", "2025-06-01T00:00:00", "1995-01-01", "2001-08-01", bands, DEFAULT_RING).select("source", "image_count", "date_range", "status")


def _tree(spark, sf):
    """The raw CSV tree in a shared folder."""
    base = shared_folder(spark, "raw")
    for source, df in sources(spark, sf).items():
        files.write_csv(df, base, "ROI_TEST", source)
    return base


@query("src_csv_tree", f"WITH {_S1} SELECT date, geo, VV, VH, RATIOVHVV FROM s1", "VV VH RATIOVHVV")
def src_csv_tree(spark, sf):
    return files.read_sources(spark, _tree(spark, sf))["sentinel_1"].select("date", "geo", "VV", "VH", "RATIOVHVV")


@query("set_group_source", f"WITH {_S1}, {_ECO}, {_LS} SELECT 'sentinel_1' AS source, count(*) AS n FROM s1 UNION ALL SELECT 'ecostress', count(*) FROM eco UNION ALL SELECT 'landsat_thermal', count(*) FROM ls")
def set_group_source(spark, sf):
    found = files.read_sources(spark, _tree(spark, sf))
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("source"), "n") for k, df in found.items()]
    return counts[0].union(counts[1]).union(counts[2])


_YM = "CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month"


@query("pl_merge", f"WITH {_S1}, {_ECO}, {_LS} SELECT *, {_YM} FROM ({_MERGED})", _VALUES)
def pl_merge(spark, sf):
    return pipelines.merged_dataset(spark, _tree(spark, sf), shared_folder(spark, "merged")).select("date", "geo", *_VALUES.split(), "year", "month")


@query("pl_run", f"WITH {_S1}, {_ECO}, {_LS} SELECT *, {_YM} FROM ({_MERGED}) WHERE date >= date '2025-06-01' AND date < date '2025-09-01'", _VALUES)
def pl_run(spark, sf):
    out = pipelines.run_pipeline(spark, sources(spark, sf), shared_folder(spark, "raw"), shared_folder(spark, "merged"), "2025-06-01", "2025-12-31", "2025-08-31")
    return out.select("date", "geo", *_VALUES.split(), "year", "month")


@query("pl_backfill", f"WITH {_S1}, {_ECO}, {_LS} SELECT date, geo, CASE WHEN month(date) = 7 THEN -1.0::DOUBLE ELSE LST_eco END AS LST_eco, CASE WHEN month(date) = 7 THEN NULL ELSE LST END AS LST, {_YM} FROM ({_MERGED}) WHERE date >= date '2025-06-01' AND date < date '2025-09-01' AND (month(date) <> 7 OR LST_eco IS NOT NULL)", "LST_eco LST")
def pl_backfill(spark, sf):
    """A month that is there stays as it is, whatever the sensors hold for it; those that are missing come."""
    raw, out = shared_folder(spark, "raw"), shared_folder(spark, "merged")
    found = sources(spark, sf)
    there = {"ecostress": found["ecostress"].where(F.month("date") == 7).withColumn("LST_eco", F.lit(-1.0))}
    files.write_partitioned(merge.outer_merge(there), out)
    pipelines.run_pipeline(spark, found, raw, out, "2025-06-01", "2025-12-31", "2025-08-31")
    return spark.read.option("mergeSchema", True).parquet(out).select("date", "geo", "LST_eco", "LST", "year", "month")


@query("sink_parquet_ym", f"WITH {_S1} SELECT date, geo, VV, VH, {_YM} FROM s1", "VV VH")
def sink_parquet_ym(spark, sf):
    path = shared_folder(spark, "sink")
    files.write_partitioned(sources(spark, sf)["sentinel_1"], path)
    return spark.read.parquet(path).select("date", "geo", "VV", "VH", "year", "month")


@query("src_partition_list", f"WITH {_ECO} SELECT DISTINCT {_YM} FROM eco")
def src_partition_list(spark, sf):
    path = shared_folder(spark, "sink")
    files.write_partitioned(sources(spark, sf)["ecostress"], path)
    return files.partitions(spark, path)


@query("st_daily_meteo", "SELECT user_id % 16 AS cell_id, CAST(ts AS date) AS date, min(value % 40) AS MIN_TEMP_C, avg(value % 40) AS MEAN_TEMP_C, max(value % 40) AS MAX_TEMP_C FROM events GROUP BY 1, 2", "MIN_TEMP_C MEAN_TEMP_C MAX_TEMP_C")
def st_daily_meteo(spark, sf):
    out = shared_folder(spark, "meteo")
    events = table(spark, sf, "events")
    feed = shared_folder(spark, "feed")
    events.select("ts", (c("user_id") % 16).alias("cell_id"), (c("value") % 40).alias("temp_c")).write.parquet(feed)
    stream = spark.readStream.schema("ts timestamp_ntz, cell_id long, temp_c double").parquet(feed)
    jobs.daily_meteo(stream, out, shared_folder(spark, "state"))
    return jobs.latest_meteo(spark, out)
