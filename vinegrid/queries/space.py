"""Geometry, neighbourhoods, alignment, terrain, statistics, meteorology."""

from __future__ import annotations

from pyspark.sql import functions as F

from vinegrid.adapters import adapter
from vinegrid.config import Params
from vinegrid.functions import indices as ix
from vinegrid.operators import geometry, merge, neighborhood, scenes, stats
from vinegrid.plans import pipelines
from vinegrid.plans.pipelines import dated
from vinegrid.queries.pixels import _COMBINED, _DAY, GDD_SQL, INDEX_SQL, LST_SQL, PHASES_SQL, phases
from vinegrid.queries.registry import query

c = F.col

# geometry. located: cells in a parcel's box widened by {reach}, with parity and distance

_DIST = """sqrt(pow(x - (x1 + t * (x2 - x1)), 2) + pow(y - (y1 + t * (y2 - y1)), 2))"""
_T = "least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0.0::DOUBLE), 1.0::DOUBLE)"
_CROSS = "CASE WHEN (y1 > y) <> (y2 > y) THEN CASE WHEN x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END ELSE 0 END"


def located_sql(cells: str, reach: float = 0.0) -> str:
    return f"""located AS (
      SELECT parcel_id, row, col, sum(crossing) % 2 = 1 AS inside, min({_DIST}) AS dist FROM (
        SELECT e.*, q.row, q.col, q.x, q.y, {_CROSS} AS crossing, {_T} AS t
        FROM (SELECT parcel_id, min(least(x1, x2)) - {reach} AS ax, max(greatest(x1, x2)) + {reach} AS bx, min(least(y1, y2)) - {reach} AS ay, max(greatest(y1, y2)) + {reach} AS by_ FROM parcel_edges GROUP BY 1) b
        JOIN (SELECT DISTINCT row, col, col * 10.0::DOUBLE + 5 AS x, row * 10.0::DOUBLE + 5 AS y FROM {cells}) q ON x BETWEEN ax AND bx AND y BETWEEN ay AND by_
        JOIN parcel_edges e USING (parcel_id)
      ) GROUP BY 1, 2, 3
    )"""


def _edges(spark, sf):
    return adapter(spark, sf, "parcel_edges")


@query("geo_inside", f"WITH {located_sql('dem')} SELECT parcel_id, row, col FROM located WHERE inside")
def geo_inside(spark, sf):
    return geometry.locate(adapter(spark, sf, "dem"), _edges(spark, sf)).where("inside").select("parcel_id", "row", "col")


@query("geo_dist", f"WITH {located_sql('dem')} SELECT parcel_id, row, col, dist FROM located", "dist")
def geo_dist(spark, sf):
    return geometry.locate(adapter(spark, sf, "dem"), _edges(spark, sf)).select("parcel_id", "row", "col", "dist")


@query("geo_area", "SELECT parcel_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area_m2 FROM parcel_edges GROUP BY 1", "area_m2")
def geo_area(spark, sf):
    return geometry.areas(_edges(spark, sf))


CORE_SQL = f"""box AS (SELECT parcel_id, min(least(x1, x2)) AS ax, max(greatest(x1, x2)) AS bx, min(least(y1, y2)) AS ay, max(greatest(y1, y2)) AS by_ FROM parcel_edges GROUP BY 1),
    stepped AS (SELECT *, 1.0::DOUBLE AS step FROM box),
    xs AS (SELECT parcel_id, step, ay, by_, unnest(range(CAST(floor(ax / step) AS BIGINT), CAST(ceil(bx / step) AS BIGINT))) AS i FROM stepped),
    cells AS (SELECT parcel_id, step, i, unnest(range(CAST(floor(ay / step) AS BIGINT), CAST(ceil(by_ / step) AS BIGINT))) AS j FROM xs),
    points AS (SELECT parcel_id, step, i, j, (i + 0.5::DOUBLE) * step AS x, (j + 0.5::DOUBLE) * step AS y FROM cells),
    tested AS (SELECT p.parcel_id, step, i, j, x, y, x1, y1, x2, y2, {_CROSS} AS crossing, {_T} AS t FROM points p JOIN parcel_edges e ON p.parcel_id = e.parcel_id),
    counted AS (SELECT parcel_id, step, i, j, sum(crossing) % 2 = 1 AS inside, min({_DIST}) AS dist FROM tested GROUP BY 1, 2, 3, 4),
    eroded AS (SELECT parcel_id, sum(CASE WHEN inside AND dist >= 10 THEN step * step ELSE 0 END) AS area_10m, sum(CASE WHEN inside AND dist >= 5 THEN step * step ELSE 0 END) AS area_5m FROM counted GROUP BY 1),
    core AS (SELECT parcel_id, area_m2, area_10m, area_5m, CASE WHEN area_10m >= 2500 THEN 10 WHEN area_5m >= 2500 THEN 5 ELSE 0 END AS erosion_m, CAST(area_m2 / 100 < 60 AS INTEGER) AS is_small_parcel
      FROM (SELECT parcel_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area_m2 FROM parcel_edges GROUP BY 1) JOIN eroded USING (parcel_id))"""


@query("geo_erode", f"WITH {CORE_SQL} SELECT * FROM core", "area_m2 area_10m area_5m")
def geo_erode(spark, sf):
    return geometry.adaptive_core(_edges(spark, sf))


_CORE_AREA = "CASE erosion_m WHEN 10 THEN area_10m WHEN 5 THEN area_5m ELSE area_m2 END"


@query("cv_reduction_pct", f"WITH {CORE_SQL} SELECT parcel_id, (area_m2 - {_CORE_AREA}) / area_m2 * 100 AS reduction_pct FROM core", "reduction_pct")
def cv_reduction_pct(spark, sf):
    """Share of each parcel that its erosion takes."""
    core = geometry.adaptive_core(_edges(spark, sf))
    return core.select("parcel_id", (F.try_divide(c("area_m2") - geometry.core_area(), c("area_m2")) * 100).alias("reduction_pct"))


@query("agg_total_pixels", f"WITH {CORE_SQL} SELECT parcel_id, {_CORE_AREA} / 100 AS total_pixels FROM core", "total_pixels")
def agg_total_pixels(spark, sf):
    """Pixels that each parcel's core holds by its area."""
    return geometry.adaptive_core(_edges(spark, sf)).select("parcel_id", (geometry.core_area() / 100).alias("total_pixels"))


_CLIP = f"WITH {located_sql('dem', 100.0)} SELECT parcel_id, row, col, elevation FROM located JOIN dem USING (row, col) WHERE inside OR dist <= 100"


@query("flt_clip", _CLIP, "elevation")
def flt_clip(spark, sf):
    return geometry.clip(adapter(spark, sf, "dem"), _edges(spark, sf)).select("parcel_id", "row", "col", "elevation")


@query("src_srtm", _CLIP, "elevation")
def src_srtm(spark, sf):
    return flt_clip(spark, sf)


# neighbourhoods

_CLEAR = "cs >= 0.60 AND cs_cdf >= 0.70 AND probability <= 30 AND scl IN (4, 5, 6)"
_STEPS2 = "(SELECT r, k FROM (SELECT unnest(range(-2, 3)) AS r) CROSS JOIN (SELECT unnest(range(-2, 3)) AS k) WHERE r * r + k * k <= 4)"
_DILATED = f"joined AS (SELECT * FROM {_COMBINED}), dilated AS (SELECT DISTINCT scene_id, row + r AS row, col + k AS col FROM joined CROSS JOIN {_STEPS2} o WHERE NOT ({_CLEAR}))"
_MASKED = f"{_DILATED}, masked AS (SELECT j.* FROM joined j ANTI JOIN dilated d ON j.scene_id = d.scene_id AND j.row = d.row AND j.col = d.col WHERE {_CLEAR})"


@query("nb_dilate", f"WITH {_DILATED} SELECT scene_id, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col FROM dilated")
def nb_dilate(spark, sf):
    px = merge.combine(*(adapter(spark, sf, x) for x in ("px_s2", "px_cs", "px_cld")))
    return neighborhood.dilate(px.where(~ix.clear_ensemble()))


@query("msk_dilated", f"WITH {_MASKED} SELECT scene_id, row, col, b4, b8 FROM masked")
def msk_dilated(spark, sf):
    return pipelines.clear_pixels(*(adapter(spark, sf, x) for x in ("px_s2", "px_cs", "px_cld"))).select("scene_id", "row", "col", "b4", "b8")


_FOCAL = """steps AS (SELECT r, k FROM (SELECT unnest(range(-2, 3)) AS r) CROSS JOIN (SELECT unnest(range(-2, 3)) AS k) WHERE r * r + k * k <= 6.25),
    calm AS (SELECT p.scene_id, p.row, p.col, avg(q.vv) AS vv, avg(q.vh) AS vh FROM px_s1 p CROSS JOIN steps s JOIN px_s1 q ON q.scene_id = p.scene_id AND q.row = p.row + s.r AND q.col = p.col + s.k GROUP BY 1, 2, 3)"""


@query("nb_focal_mean", f"WITH {_FOCAL} SELECT * FROM calm", "vv vh")
def nb_focal_mean(spark, sf):
    return neighborhood.focal_mean(adapter(spark, sf, "px_s1"), ["vv", "vh"]).select("scene_id", "row", "col", "vv", "vh")


TERRAIN_SQL = """g AS (SELECT d.row, d.col, d.elevation, (e.elevation - w.elevation) / 20 AS gx, (n.elevation - s.elevation) / 20 AS gy
      FROM dem d JOIN dem e ON e.row = d.row AND e.col = d.col + 1 JOIN dem w ON w.row = d.row AND w.col = d.col - 1
      JOIN dem n ON n.row = d.row + 1 AND n.col = d.col JOIN dem s ON s.row = d.row - 1 AND s.col = d.col),
    terrain AS (SELECT row, col, elevation, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope, CASE WHEN degrees(atan2(-gx, -gy)) < 0 THEN degrees(atan2(-gx, -gy)) + 360 ELSE degrees(atan2(-gx, -gy)) END AS aspect FROM g)"""


@query("nb_slope", f"WITH {TERRAIN_SQL} SELECT row, col, slope FROM terrain", "slope")
def nb_slope(spark, sf):
    return neighborhood.terrain(adapter(spark, sf, "dem")).select("row", "col", "slope")


@query("nb_aspect", f"WITH {TERRAIN_SQL} SELECT row, col, aspect FROM terrain", "aspect")
def nb_aspect(spark, sf):
    return neighborhood.terrain(adapter(spark, sf, "dem")).select("row", "col", "aspect")


SHADE_SQL = "greatest(cos(radians(20)) * cos(radians(slope)) + sin(radians(20)) * sin(radians(slope)) * cos(radians(180) - radians(aspect)), 0) * 255"


@query("nb_hillshade", f"WITH {TERRAIN_SQL} SELECT row, col, {SHADE_SQL} AS hillshade FROM terrain", "hillshade")
def nb_hillshade(spark, sf):
    return neighborhood.terrain(adapter(spark, sf, "dem")).select("row", "col", neighborhood.hillshade().alias("hillshade"))


@query("cv_solar_norm", f"WITH {TERRAIN_SQL} SELECT row, col, {SHADE_SQL} / 255 AS Solar_Rad FROM terrain", "Solar_Rad")
def cv_solar_norm(spark, sf):
    return nb_hillshade(spark, sf).select("row", "col", (c("hillshade") / 255).alias("Solar_Rad"))


def glcm_sql(levels: str) -> str:
    return f"""lv AS ({levels}), moves AS (SELECT * FROM (VALUES (0, 1), (1, 0), (1, 1), (1, -1)) m(dr, dc)),
    pairs AS (SELECT a.row, a.col, dr, dc, a.level AS own, b.level AS other FROM lv a CROSS JOIN moves JOIN lv b ON b.row = a.row + dr AND b.col = a.col + dc),
    win AS (SELECT z.row, z.col, p.own, p.other, count(*) AS n FROM lv z JOIN pairs p
      ON p.row BETWEEN z.row - 3 AND z.row + 3 AND p.row + p.dr BETWEEN z.row - 3 AND z.row + 3 AND p.col BETWEEN z.col - 3 AND z.col + 3 AND p.col + p.dc BETWEEN z.col - 3 AND z.col + 3 GROUP BY 1, 2, 3, 4),
    prob AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY row, col) AS DOUBLE) AS p FROM win),
    glcm AS (SELECT row, col, -sum(p * ln(p)) AS entropy, sum(CAST((own - other) * (own - other) AS DOUBLE) * p) AS contrast FROM prob GROUP BY 1, 2)"""


_LEVEL = "SELECT row, col, CAST(trunc(elevation / 50) AS INTEGER) AS level FROM dem"


@query("nb_glcm", f"WITH {glcm_sql(_LEVEL)} SELECT row, col, entropy, contrast FROM glcm", "entropy contrast")
def nb_glcm(spark, sf):
    return neighborhood.glcm(adapter(spark, sf, "dem").select("row", "col", (c("elevation") / 50).cast("int").alias("level")), "level")


def _shadow_moves():
    from math import cos, floor, radians, sin, tan

    back = radians(130 + 180)
    return [(floor(h * tan(radians(1.5)) * cos(back) / 10 + 0.5), floor(h * tan(radians(1.5)) * sin(back) / 10 + 0.5)) for h in (500.0, 1000.0, 2000.0)]


@query("nb_shadow", f"""WITH cast_ AS (SELECT DISTINCT scene_id, row + r AS row, col + k AS col FROM px_s2 CROSS JOIN (VALUES {', '.join(map(str, _shadow_moves()))}) m(r, k) WHERE NOT (scl IN (4, 5, 6))),
    hit AS (SELECT c.* FROM cast_ c JOIN px_s2 d ON c.scene_id = d.scene_id AND c.row = d.row AND c.col = d.col WHERE b8 / 10000 < 0.30 AND scl <> 6)
    SELECT DISTINCT scene_id, CAST(row + r AS INTEGER) AS row, CAST(col + k AS INTEGER) AS col FROM hit CROSS JOIN (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(r, k)""")
def nb_shadow(spark, sf):
    px = adapter(spark, sf, "px_s2")
    dark = px.where((c("b8") / 10000 < 0.30) & (c("scl") != 6))
    return neighborhood.shadows(px.where(~ix.clear_scl()), dark, 130.0, 1.5)


#: The tables' near infrared starts at 0.15 and no probability is over 31, so the limits are others than the default ones.
_SHADOW_LIMITS = Params(dark_nir=0.30, core_probability=25.0)
_MOVE = "CAST(floor(tan(radians(zenith)) * h / 10 * {f}(radians(azimuth + 180)) + 0.5) AS INTEGER)"
_SHADED = f"""core AS (SELECT scene_id, row, col FROM px_s2 WHERE scl IN (8, 9) UNION SELECT scene_id, row, col FROM px_cld WHERE probability > 25),
    moves AS (SELECT DISTINCT scene_id, {_MOVE.format(f='cos')} AS r, {_MOVE.format(f='sin')} AS k FROM scene_sun CROSS JOIN (VALUES (500.0::DOUBLE), (1000.0::DOUBLE), (2000.0::DOUBLE)) m(h) WHERE zenith IS NOT NULL),
    cast_ AS (SELECT DISTINCT scene_id, row + r AS row, col + k AS col FROM core JOIN moves USING (scene_id)),
    hit AS (SELECT scene_id, row, col FROM px_s2 SEMI JOIN cast_ USING (scene_id, row, col) WHERE b8 / 10000 < 0.30 AND scl <> 6),
    shaded AS (SELECT DISTINCT scene_id, CAST(row + r AS INTEGER) AS row, CAST(col + k AS INTEGER) AS col FROM hit CROSS JOIN (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) o(r, k))"""


@query("nb_shadow_scenes", f"WITH {_SHADED} SELECT scene_id, row, col FROM shaded")
def nb_shadow_scenes(spark, sf):
    """Shadows by each scene's own sun."""
    px, cld, sun = (adapter(spark, sf, x) for x in ("px_s2", "px_cld", "scene_sun"))
    return neighborhood.scene_shadows(pipelines.cloud_core(px, cld, _SHADOW_LIMITS), px.where(ix.dark(_SHADOW_LIMITS)), sun)


@query("msk_shadow_scenes", f"WITH {_MASKED}, {_SHADED} SELECT scene_id, row, col, b4, b8 FROM masked ANTI JOIN shaded USING (scene_id, row, col)")
def msk_shadow_scenes(spark, sf):
    """Clear pixels, dilated clouds and shadows masked."""
    px = (adapter(spark, sf, x) for x in ("px_s2", "px_cs", "px_cld"))
    return pipelines.clear_pixels(*px, _SHADOW_LIMITS, sun=adapter(spark, sf, "scene_sun")).select("scene_id", "row", "col", "b4", "b8")


# alignment

_NEAR = "CAST(floor((f.row + 0.5) * 10 / {m}) AS INTEGER) = q.row AND CAST(floor((f.col + 0.5) * 10 / {m}) AS INTEGER) = q.col"


@query("jn_align_nearest", f"SELECT f.row, f.col, q.scene_id, q.st_b10 FROM dem f JOIN px_landsat q ON {_NEAR.format(m=30)}")
def jn_align_nearest(spark, sf):
    return merge.align_nearest(adapter(spark, sf, "dem").select("row", "col"), adapter(spark, sf, "px_landsat").select("scene_id", "row", "col", "st_b10"), 30.0).select("row", "col", "scene_id", "st_b10")


_W = "CASE WHEN abs({d}) <= 1 THEN 1.5 * pow(abs({d}), 3) - 2.5 * pow(abs({d}), 2) + 1 WHEN abs({d}) < 2 THEN -0.5 * pow(abs({d}), 3) + 2.5 * pow(abs({d}), 2) - 4 * abs({d}) + 2 ELSE 0 END"


@query("jn_align_bicubic", f"""WITH coarse AS (SELECT row // 2 AS crow, col // 2 AS ccol, avg(CAST(elevation AS DOUBLE)) AS elevation FROM dem GROUP BY 1, 2),
    fine AS (SELECT row, col, (row + 0.5) / 2 - 0.5 AS y, (col + 0.5) / 2 - 0.5 AS x FROM dem),
    four AS (SELECT unnest(range(-1, 3)) AS s),
    j AS (SELECT row, col, elevation, ({_W.format(d='(y - crow)')}) * ({_W.format(d='(x - ccol)')}) AS w FROM fine CROSS JOIN four a CROSS JOIN four b JOIN coarse ON crow = floor(y) + a.s AND ccol = floor(x) + b.s)
    SELECT row, col, CAST(sum(w * elevation) / nullif(sum(w), 0) AS DOUBLE) AS elevation FROM j GROUP BY 1, 2""", "elevation")
def jn_align_bicubic(spark, sf):
    """The elevation's mean over 2 x 2 cells, brought back to all cells."""
    dem = adapter(spark, sf, "dem")
    coarse = dem.groupBy(F.expr("int(row div 2)").alias("row"), F.expr("int(col div 2)").alias("col")).agg(F.avg(c("elevation").cast("double")).alias("elevation"))
    return merge.align_bicubic(dem, coarse, "elevation")


_FLOW = f"{TERRAIN_SQL}, flow AS (SELECT f.row, f.col, slope, aspect, b1 FROM terrain f JOIN flowacc q ON {_NEAR.format(m=160)})"


@query("jn_flowacc", f"WITH {_FLOW} SELECT row, col, slope, b1 FROM flow", "slope")
def jn_flowacc(spark, sf):
    return merge.align_nearest(neighborhood.terrain(adapter(spark, sf, "dem")), adapter(spark, sf, "flowacc"), 160.0).select("row", "col", "slope", "b1")


@query("cv_twi", f"WITH {_FLOW} SELECT row, col, ln(b1 / greatest(tan(radians(slope)), 0.001::DOUBLE)) AS TWI FROM flow", "TWI")
def cv_twi(spark, sf):
    return pipelines.static_terrain(adapter(spark, sf, "dem"), adapter(spark, sf, "flowacc")).select("row", "col", "TWI")


@query("pl_static_srtm", f"WITH {_FLOW} SELECT row, col, slope, ln(b1 / greatest(tan(radians(slope)), 0.001::DOUBLE)) AS TWI, {SHADE_SQL} / 255 AS Solar_Rad FROM flow", "slope TWI Solar_Rad")
def pl_static_srtm(spark, sf):
    return pipelines.static_terrain(adapter(spark, sf, "dem"), adapter(spark, sf, "flowacc"))


@query("pl_srtm", f"WITH {located_sql('dem')}, {TERRAIN_SQL} SELECT parcel_id, elevation, slope, aspect, row, col FROM terrain JOIN located USING (row, col) WHERE inside", "elevation slope aspect")
def pl_srtm(spark, sf):
    return pipelines.srtm(adapter(spark, sf, "dem"), _edges(spark, sf)).drop("geo")


@query("jn_terrain_static", f"WITH {TERRAIN_SQL} SELECT scene_id, row, col, vv, elevation, slope, aspect FROM px_s1 LEFT JOIN terrain USING (row, col)", "vv elevation slope aspect")
def jn_terrain_static(spark, sf):
    return adapter(spark, sf, "px_s1").join(neighborhood.terrain(adapter(spark, sf, "dem")), ["row", "col"], "left").select("scene_id", "row", "col", "vv", "elevation", "slope", "aspect")


# statistics

_P = ", ".join(f"quantile_cont(value, {q}) AS {n}" for n, q in stats.PERCENTILES.items())
_BANDS = ["b2", "b3", "b4", "b5", "b6", "b7", "b8", "b11"]
STATS_DOUBLES = "p10 p25 median p75 p90 stddev"
#: Cells of each parcel's core with the parcel's columns.
CORED_SQL = f"""{CORE_SQL}, {located_sql('px_s2')},
    cored AS (SELECT parcel_id, row, col, erosion_m, is_small_parcel, {_CORE_AREA} / 100 AS total_pixels FROM located JOIN core USING (parcel_id) WHERE inside AND (erosion_m = 0 OR dist >= erosion_m))"""
_LONG = " UNION ALL ".join(f"SELECT parcel_id, scene_id, '{x.lower()}' AS band, CAST({y} AS DOUBLE) AS value FROM {{of}} JOIN cored USING (row, col)" for x, y in [("NDVI", INDEX_SQL["NDVI"]), *((x, x) for x in _BANDS)])
_STATS = f"SELECT parcel_id, scene_id, band, {_P}, count(value) AS n, stddev_pop(value) AS stddev FROM ({{long}}) GROUP BY 1, 2, 3"


@query("agg_parcel_stats", f"WITH {_MASKED}, {CORED_SQL} {_STATS.format(long=_LONG.format(of='masked'))}", STATS_DOUBLES)
def agg_parcel_stats(spark, sf):
    """All bands and the vegetation index of each parcel's core in each scene."""
    edges = _edges(spark, sf)
    clear = pipelines.clear_pixels(*(adapter(spark, sf, x) for x in ("px_s2", "px_cs", "px_cld")), edges=edges).withColumn("ndvi", ix.ndvi())
    return pipelines.parcel_stats(clear, edges, ["ndvi", *_BANDS])


_VALID = "CAST(valid_pixels >= greatest(CASE WHEN {small} THEN 15.0::DOUBLE ELSE 25.0::DOUBLE END, total_pixels * 0.30::DOUBLE) AND coverage_ratio >= CASE WHEN {small} THEN 0.50 ELSE 0.60 END AS INTEGER)"
SEEN_SQL = f"""{CORED_SQL},
    seen AS (SELECT *, valid_pixels / nullif(total_pixels, 0) AS coverage_ratio FROM (SELECT parcel_id, scene_id, erosion_m, is_small_parcel, total_pixels, count(CASE WHEN scl IN (4, 5, 6) THEN b4 END) AS valid_pixels FROM px_s2 JOIN cored USING (row, col) GROUP BY ALL)),
    observed AS (SELECT *, {_VALID.format(small='is_small_parcel = 1')} AS observation_valid FROM seen)"""


def _clear_b4(spark, sf):
    return adapter(spark, sf, "px_s2").withColumn("b4", F.when(ix.clear_scl(), c("b4")))


def _seen(spark, sf):
    return pipelines.observations(_clear_b4(spark, sf), _edges(spark, sf))


_QUALITY = ["valid_pixels", "total_pixels", "coverage_ratio", "observation_valid", "erosion_m", "is_small_parcel"]
for _name, _columns in (("agg_valid_count", ["valid_pixels"]), ("agg_coverage", ["valid_pixels", "total_pixels", "coverage_ratio"]), ("qa_validate", _QUALITY)):
    query(_name, f"WITH {SEEN_SQL} SELECT parcel_id, scene_id, {', '.join(_columns)} FROM observed", " ".join(x for x in ("total_pixels", "coverage_ratio") if x in _columns))(
        lambda spark, sf, k=_columns: _seen(spark, sf).select("parcel_id", "scene_id", *k)
    )


@query("jn_scene_stats", f"""WITH {SEEN_SQL}, st AS ({_STATS.format(long=_LONG.format(of='px_s2'))})
    SELECT parcel_id, scene_id, row, col, b8, median, p10, p90, n, valid_pixels, coverage_ratio FROM px_s2 JOIN cored USING (row, col) JOIN (SELECT * FROM st WHERE band = 'b8') USING (parcel_id, scene_id) JOIN observed USING (parcel_id, scene_id)""", "median p10 p90 coverage_ratio")
def jn_scene_stats(spark, sf):
    """Each pixel of a core beside its parcel's statistics and quality in that scene."""
    px = _clear_b4(spark, sf).select("scene_id", "row", "col", "b4", "b8")
    return pipelines.pixels_with_stats(px, _edges(spark, sf), "b8").select("parcel_id", "scene_id", "row", "col", "b8", "median", "p10", "p90", "n", "valid_pixels", "coverage_ratio")


@query("cv_qa_columns", f"WITH {SEEN_SQL} SELECT parcel_id, scene_id, row, col, {INDEX_SQL['NDVI']} AS NDVI, {', '.join(f'observed.{x}' for x in _QUALITY)} FROM px_s2 JOIN cored USING (row, col) JOIN observed USING (parcel_id, scene_id)", "NDVI total_pixels coverage_ratio")
def cv_qa_columns(spark, sf):
    px = adapter(spark, sf, "px_s2").select("scene_id", "row", "col", ix.ndvi().alias("NDVI"), F.when(ix.clear_scl(), c("b4")).alias("b4"))
    return pipelines.observed_pixels(px, _edges(spark, sf)).select("parcel_id", "scene_id", "row", "col", "NDVI", *_QUALITY)


@query("agg_summary", f"""WITH {SEEN_SQL}, v AS (SELECT parcel_id, {_DAY} AS date, coverage_ratio, observation_valid AS ok FROM px_s2 JOIN cored USING (row, col) JOIN observed USING (parcel_id, scene_id))
    SELECT parcel_id, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS dates, avg(coverage_ratio) AS mean_coverage, count(DISTINCT CASE WHEN ok = 1 THEN date END) AS valid_dates FROM v GROUP BY 1""", "mean_coverage")
def agg_summary(spark, sf):
    df = dated(cv_qa_columns(spark, sf))
    return df.groupBy("parcel_id").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("date").alias("dates"), F.avg("coverage_ratio").alias("mean_coverage"), F.countDistinct(F.when(c("observation_valid") == 1, c("date"))).alias("valid_dates"))


@query("agg_iqr_outlier", "WITH q AS (SELECT scene_id, quantile_cont(b8, 0.25) AS a, quantile_cont(b8, 0.75) AS b FROM px_s2 GROUP BY 1) SELECT scene_id, row, col, b8 FROM px_s2 JOIN q USING (scene_id) WHERE b8 BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def agg_iqr_outlier(spark, sf):
    return stats.iqr_filter(adapter(spark, sf, "px_s2").select("scene_id", "row", "col", "b8"), ["scene_id"], "b8")


_NDVI = f"(SELECT *, {INDEX_SQL['NDVI']} AS ndvi, {INDEX_SQL['NDMI']} AS ndmi, {INDEX_SQL['NDRE']} AS ndre, {_DAY} AS date FROM px_s2)"
_PEAK = f"SELECT scene_id, row, col, ndvi, b4, b8 FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY ndvi DESC, scene_id DESC) AS nth FROM {_NDVI} WHERE ndvi IS NOT NULL) WHERE nth = 1"


@query("agg_peak_mosaic", _PEAK, "ndvi")
def agg_peak_mosaic(spark, sf):
    return stats.peak_mosaic(adapter(spark, sf, "px_s2").withColumn("ndvi", ix.ndvi()), ["ndvi", "b4", "b8"])


@query("topk_pixel", _PEAK, "ndvi")
def topk_pixel(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("row", "col").orderBy(F.desc("ndvi"), F.desc("scene_id"))
    px = adapter(spark, sf, "px_s2").withColumn("ndvi", ix.ndvi()).where("ndvi IS NOT NULL")
    return px.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("scene_id", "row", "col", "ndvi", "b4", "b8")


_PHASED = f"(SELECT n.*, phase, CAST(date - start AS DOUBLE) AS t FROM {_NDVI} n JOIN {PHASES_SQL} p ON date BETWEEN start AND stop)"
#: A single point gives NaN in one engine and null in the other.
_SLOPES = ", ".join(
    f"CASE WHEN NOT isnan({fit}) THEN {fit} END AS {name}"
    for name, fit in (("Green_Up", "regr_slope(CASE WHEN phase = 'T1' THEN ndvi END, CASE WHEN phase = 'T1' THEN t END)"), ("Senescence", "regr_slope(CASE WHEN phase = 'T2' THEN ndvi END, CASE WHEN phase = 'T2' THEN t END)"))
)
_FIT = f"SELECT row, col, {_SLOPES} FROM {_PHASED} GROUP BY 1, 2"


@query("agg_linear_fit", _FIT, "Green_Up Senescence")
def agg_linear_fit(spark, sf):
    px = dated(adapter(spark, sf, "px_s2")).withColumn("ndvi", ix.ndvi())
    return stats.linear_fit(scenes.in_phase(px, phases(spark)).withColumn("t", F.datediff("date", "start").cast("double")))


_VH = f"SELECT row, col, avg(CASE WHEN phase = 'T1' THEN vh END) AS VH_Early, avg(CASE WHEN phase = 'T2' THEN vh END) AS VH_Late FROM px_s1 JOIN {PHASES_SQL} p ON {_DAY} BETWEEN start AND stop GROUP BY 1, 2"
for _name, _columns in (("agg_vh_mean", ["VH_Early", "VH_Late"]), ("cv_vh_drop", ["VH_Drop"]), ("pl_static_s1", ["VH_Late", "VH_Drop"]), ("agg_period_diff", ["VH_Early", "VH_Late", "VH_Drop"])):
    query(_name, f"SELECT row, col, {', '.join(_columns)} FROM (SELECT *, VH_Late - VH_Early AS VH_Drop FROM ({_VH}))", " ".join(_columns))(
        lambda spark, sf, k=tuple(_columns): pipelines.static_s1(adapter(spark, sf, "px_s1"), phases(spark)).select("row", "col", *k)
    )

_CLEAR_LST = f"SELECT scene_id, row, col, {LST_SQL} AS LST FROM px_landsat WHERE qa_pixel & 8 = 0 AND qa_pixel & 16 = 0"


def _lst(spark, sf):
    return adapter(spark, sf, "px_landsat").where(ix.bits_unset("qa_pixel", 3, 4)).select("scene_id", "row", "col", ix.lst_landsat().alias("LST"))


for _name, _columns in (("agg_lst_median", ["LST_med"]), ("agg_lst_stability", ["LST_Stability"]), ("pl_static_landsat", ["LST_med", "LST_Stability"])):
    query(_name, f"SELECT row, col, {', '.join(_columns)} FROM (SELECT row, col, median(LST) AS LST_med, stddev_pop(LST) AS LST_Stability FROM ({_CLEAR_LST}) GROUP BY 1, 2)", " ".join(_columns))(
        lambda spark, sf, k=tuple(_columns): _lst(spark, sf).groupBy("row", "col").agg(F.median("LST").alias("LST_med"), F.stddev_pop("LST").alias("LST_Stability")).select("row", "col", *k)
    )
for _name in ("agg_eco_median", "pl_static_eco"):
    query(_name, "SELECT row, col, median(lst * 0.02::DOUBLE - 273.15::DOUBLE) AS LST_eco_med FROM px_eco GROUP BY 1, 2", "LST_eco_med")(
        lambda spark, sf: adapter(spark, sf, "px_eco").groupBy("row", "col").agg(F.median(ix.lst_ecostress()).alias("LST_eco_med"))
    )


@query("agg_weekly", f"SELECT row, col, date_trunc('day', CAST(date '1970-01-01' + (CAST(({_DAY} - date '1970-01-01') AS INTEGER) // 7) * 7 AS timestamp))::DATE AS week, avg(vh) AS mean, count(vh) AS n FROM px_s1 GROUP BY 1, 2, 3", "mean")
def agg_weekly(spark, sf):
    return stats.weekly(dated(adapter(spark, sf, "px_s1")), ["row", "col"], "date", "vh")


@query("win_anomaly", "SELECT scene_id, row, col, CASE WHEN stddev_pop(vh) OVER w <> 0 THEN (vh - avg(vh) OVER w) / stddev_pop(vh) OVER w END AS z FROM px_s1 WINDOW w AS (PARTITION BY row, col ORDER BY scene_id ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)", "z")
def win_anomaly(spark, sf):
    return stats.anomaly(adapter(spark, sf, "px_s1"), ["row", "col"], "scene_id", "vh").select("scene_id", "row", "col", "z")


_YEARLY = "SELECT sensor, month(acquired_at) AS month, year(acquired_at) AS year, avg(cloud_pct) AS cloud FROM scenes GROUP BY 1, 2, 3"


@query("win_yoy", f"WITH y AS ({_YEARLY}) SELECT a.sensor, CAST(a.month AS INTEGER) AS month, CAST(a.year AS INTEGER) AS year, a.cloud, b.cloud AS last_year, a.cloud - b.cloud AS change FROM y a JOIN y b ON a.sensor = b.sensor AND a.month = b.month AND a.year = b.year + 1", "cloud last_year change")
def win_yoy(spark, sf):
    s = adapter(spark, sf, "scenes")
    yearly = s.groupBy("sensor", F.month("acquired_at").alias("month"), F.year("acquired_at").alias("year")).agg(F.avg("cloud_pct").alias("cloud"))
    return stats.year_on_year(yearly, ["sensor", "month"], "cloud").select("sensor", "month", "year", "cloud", "last_year", "change")


# time series of parcels: clear pixels of their cores, by the dates of the scene table

_SERIES = f"""{_MASKED}, {CORED_SQL},
    own AS (SELECT parcel_id, CAST(acquired_at AS date) AS date, {INDEX_SQL['NDVI']} AS ndvi, b8 FROM masked JOIN cored USING (row, col) JOIN scenes USING (scene_id))"""
_WEEK = "CAST(date_trunc('week', date) AS date)"


def _own(spark, sf):
    return pipelines.dated_clear(*(adapter(spark, sf, x) for x in ("px_s2", "px_cs", "px_cld", "parcel_edges", "scenes")))


@query("agg_parcel_weekly", f"""WITH {_SERIES}, long AS (SELECT parcel_id, {_WEEK} AS period, date, 'ndvi' AS band, ndvi AS value FROM own UNION ALL SELECT parcel_id, {_WEEK}, date, 'b8', b8 FROM own)
    SELECT parcel_id, period, band, {_P}, count(value) AS n, stddev_pop(value) AS stddev, count(DISTINCT date) AS days, min(date) AS first_day, max(date) AS last_day FROM long GROUP BY 1, 2, 3""", STATS_DOUBLES)
def agg_parcel_weekly(spark, sf):
    """Statistics of each parcel in each calendar week."""
    return pipelines.parcel_periods(_own(spark, sf), _edges(spark, sf), ["ndvi", "b8"])


@query("agg_parcel_fortnightly", f"""WITH {_SERIES} SELECT parcel_id, CAST(date '1970-01-05' + 14 * CAST(floor((date - date '1970-01-05') / 14.0) AS INTEGER) AS date) AS period, count(ndvi) AS n, avg(ndvi) AS mean, median(ndvi) AS median FROM own GROUP BY 1, 2 HAVING count(ndvi) > 0""", "mean median")
def agg_parcel_fortnightly(spark, sf):
    """Vegetation index of each parcel by periods of fourteen days."""
    return pipelines.parcel_series(_own(spark, sf), _edges(spark, sf), 14)


@query("win_parcel_anomaly", f"""WITH {_SERIES}, days AS (SELECT parcel_id, date, round(avg(ndvi), 6) AS mean FROM own WHERE ndvi IS NOT NULL GROUP BY 1, 2),
    framed AS (SELECT *, count(mean) OVER w AS n_before, avg(mean) OVER w AS mean_before, stddev_pop(mean) OVER w AS dev FROM days WINDOW w AS (PARTITION BY parcel_id ORDER BY date RANGE BETWEEN INTERVAL 365 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING))
    SELECT parcel_id, date, mean, n_before, mean_before, CASE WHEN n_before >= 3 AND dev > 0 THEN (mean - mean_before) / dev END AS z FROM framed""", "mean mean_before z")
def win_parcel_anomaly(spark, sf):
    """Each parcel's day against the year before it, by days and not by rows."""
    days = pipelines.parcel_series(_own(spark, sf), _edges(spark, sf), median=False).select("parcel_id", c("period").alias("date"), ix.rounded(c("mean")).alias("mean"))
    return stats.calendar_anomaly(days, ["parcel_id"], "date", "mean", 365)


@query("win_parcel_yoy", f"""WITH {_SERIES}, weeks AS (SELECT parcel_id, {_WEEK} AS week, avg(ndvi) AS mean FROM own WHERE ndvi IS NOT NULL GROUP BY 1, 2),
    asked AS (SELECT *, CAST(date_trunc('week', make_date(isoyear(week) - back, 1, 4)) AS date) + 7 * (least(weekofyear(week), weekofyear(make_date(isoyear(week) - back, 12, 28))) - 1)::INTEGER AS same FROM weeks CROSS JOIN (VALUES (1), (2)) b(back)),
    met AS (SELECT a.parcel_id, a.week, back, a.mean, b.week AS then_week, b.mean AS then_, CAST((b.week - same) // 7 AS INTEGER) AS off FROM asked a JOIN weeks b ON a.parcel_id = b.parcel_id AND b.week BETWEEN same - 28 AND same + 28)
    SELECT parcel_id, week, CAST(back AS INTEGER) AS years_back, mean, then_week, then_ AS "then", off AS weeks_off, mean - then_ AS change FROM met QUALIFY row_number() OVER (PARTITION BY parcel_id, week, back ORDER BY abs(off), off) = 1""", 'mean "then" change')
def win_parcel_yoy(spark, sf):
    """Each parcel's week against that week one and two years before, or the nearest within four weeks."""
    weeks = pipelines.parcel_series(_own(spark, sf), _edges(spark, sf), "week", median=False).select("parcel_id", c("period").alias("week"), "mean")
    return stats.week_on_years(weeks, ["parcel_id"], "mean", (1, 2), 4)


# meteorology

_DAILY = f"""daily AS (SELECT cell_id, CAST(ts AS date) AS date, min(temperature_2m - 273.15::DOUBLE) AS MIN_TEMP_C, avg(temperature_2m - 273.15::DOUBLE) AS MEAN_TEMP_C, max(temperature_2m - 273.15::DOUBLE) AS MAX_TEMP_C,
    sum(total_precipitation_hourly) AS RAIN_TOTAL, sum(potential_evaporation) AS PET_TOTAL, sum(evaporation_from_vegetation_transpiration) AS AET_TOTAL, sum({GDD_SQL}) AS GDD, sum(potential_evaporation) - sum(total_precipitation_hourly) AS WDI FROM era5_hourly GROUP BY 1, 2)"""
_SPINE = f"{_DAILY}, span AS (SELECT cell_id, min(CAST(ts AS date)) AS a, max(CAST(ts AS date)) AS b FROM era5_hourly GROUP BY 1), spine AS (SELECT cell_id, CAST(unnest(generate_series(CAST(a AS timestamp), CAST(b AS timestamp), interval 1 day)) AS date) AS date FROM span)"
for _name, _columns in (("agg_era5_temp", "MIN_TEMP_C MEAN_TEMP_C MAX_TEMP_C"), ("agg_era5_water", "RAIN_TOTAL PET_TOTAL AET_TOTAL"), ("cv_wdi", "WDI")):
    query(_name, f"WITH {_DAILY} SELECT cell_id, date, {', '.join(_columns.split())} FROM daily", _columns)(lambda spark, sf, k=_columns: stats.daily_meteo(adapter(spark, sf, "era5_hourly")).select("cell_id", "date", *k.split()))


@query("agg_daily_spine", f"WITH {_SPINE} SELECT cell_id, date, MEAN_TEMP_C FROM spine LEFT JOIN daily USING (cell_id, date)", "MEAN_TEMP_C")
def agg_daily_spine(spark, sf):
    hourly = adapter(spark, sf, "era5_hourly")
    return stats.day_spine(hourly, stats.daily_meteo(hourly)).select("cell_id", "date", "MEAN_TEMP_C")


@query("agg_gdd", f"WITH {_DAILY} SELECT cell_id, date, GDD, sum(GDD) OVER (PARTITION BY cell_id, year(date) ORDER BY date) AS GDD_season FROM daily", "GDD GDD_season")
def agg_gdd(spark, sf):
    return stats.degree_days(stats.daily_meteo(adapter(spark, sf, "era5_hourly")))


_ERA_COLUMNS = "MIN_TEMP_C MEAN_TEMP_C MAX_TEMP_C RAIN_TOTAL PET_TOTAL AET_TOTAL WDI"


@query("pl_era5", f"WITH {_SPINE.replace('FROM era5_hourly', 'FROM era5_hourly WHERE month(ts) BETWEEN 4 AND 9')} SELECT cell_id, date, {', '.join(_ERA_COLUMNS.split())} FROM spine LEFT JOIN daily USING (cell_id, date)", _ERA_COLUMNS)
def pl_era5(spark, sf):
    return pipelines.era5(adapter(spark, sf, "era5_hourly")).select("cell_id", "date", *_ERA_COLUMNS.split())


# pipelines


@query("pl_s1", f"WITH {_FOCAL} SELECT {_DAY} AS date, vv AS VV, vh AS VH, vh / nullif(vv, 0) AS RATIOVHVV, row, col FROM calm", "VV VH RATIOVHVV")
def pl_s1(spark, sf):
    return pipelines.sentinel1(adapter(spark, sf, "px_s1")).drop("geo")


_GRID = "(SELECT row, col FROM dem)"


@query("pl_landsat", f"SELECT {_DAY} AS date, LST, f.row, f.col FROM {_GRID} f JOIN ({_CLEAR_LST}) q ON {_NEAR.format(m=30)}", "LST")
def pl_landsat(spark, sf):
    return pipelines.landsat(adapter(spark, sf, "px_landsat"), adapter(spark, sf, "dem").select("row", "col")).drop("geo")


@query("pl_eco", f"SELECT CAST(timestamp '2025-06-01 00:00:00' + scene_id * 25 * interval 1 hour AS date) AS date, lst * 0.02::DOUBLE - 273.15::DOUBLE AS LST_eco, f.row, f.col FROM {_GRID} f JOIN px_eco q ON {_NEAR.format(m=70)} WHERE hour(timestamp '2025-06-01 00:00:00' + scene_id * 25 * interval 1 hour) BETWEEN 9 AND 15", "LST_eco")
def pl_eco(spark, sf):
    return pipelines.ecostress(adapter(spark, sf, "px_eco"), adapter(spark, sf, "dem").select("row", "col")).drop("geo")


_SIX = ["NDVI", "EVI", "GNDVI", "IRECI", "NDMI", "NDRE"]
S2_SQL = f"""WITH {_MASKED}, {CORE_SQL}, {located_sql('px_s2')},
    cored AS (SELECT parcel_id, row, col FROM located JOIN core USING (parcel_id) WHERE inside AND (erosion_m = 0 OR dist >= erosion_m)),
    seen AS (SELECT m.*, parcel_id, {', '.join(f'{INDEX_SQL[x]} AS {x}' for x in _SIX)} FROM masked m JOIN cored c ON m.row = c.row AND m.col = c.col),
    total AS (SELECT parcel_id, erosion_m, is_small_parcel, CASE erosion_m WHEN 10 THEN area_10m WHEN 5 THEN area_5m ELSE area_m2 END / 100 AS total_pixels FROM core),
    quality AS (SELECT *, {_VALID.format(small='is_small_parcel = 1')} AS observation_valid FROM (SELECT *, valid_pixels / nullif(total_pixels, 0) AS coverage_ratio FROM (SELECT parcel_id, scene_id, count(b4) AS valid_pixels FROM seen GROUP BY 1, 2) JOIN total USING (parcel_id)))
    SELECT parcel_id, {_DAY} AS date, {', '.join(_SIX)}, valid_pixels, total_pixels, coverage_ratio, observation_valid, erosion_m, is_small_parcel, row, col FROM seen JOIN quality USING (parcel_id, scene_id)
    WHERE {' AND '.join(f'{x} IS NOT NULL' for x in _SIX)}"""
S2_DOUBLES = " ".join([*_SIX, "total_pixels", "coverage_ratio"])


@query("pl_s2", S2_SQL, S2_DOUBLES)
def pl_s2(spark, sf):
    return pipelines.sentinel2(*(adapter(spark, sf, x) for x in ("px_s2", "px_cs", "px_cld")), _edges(spark, sf)).drop("geo")


@query("pl_step2_export", f"SELECT parcel_id, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS dates, avg(coverage_ratio) AS mean_coverage, count(DISTINCT CASE WHEN observation_valid = 1 THEN date END) AS valid_dates FROM ({S2_SQL}) GROUP BY 1", "mean_coverage")
def pl_step2_export(spark, sf):
    return pl_s2(spark, sf).groupBy("parcel_id").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("date").alias("dates"), F.avg("coverage_ratio").alias("mean_coverage"), F.countDistinct(F.when(c("observation_valid") == 1, c("date"))).alias("valid_dates"))


@query("pl_static_s2", f"""WITH {_MASKED},
    n AS (SELECT *, {INDEX_SQL['NDVI']} AS ndvi, {INDEX_SQL['NDMI']} AS ndmi, {INDEX_SQL['NDRE']} AS ndre, {_DAY} AS date FROM masked),
    peak AS (SELECT * FROM (SELECT row, col, ndvi, ndmi, ndre, row_number() OVER (PARTITION BY row, col ORDER BY ndvi DESC, scene_id DESC) AS nth FROM n WHERE ndvi IS NOT NULL) WHERE nth = 1),
    fit AS (SELECT row, col, {_SLOPES}
      FROM (SELECT n.*, phase, CAST(date - start AS DOUBLE) AS t FROM n JOIN {PHASES_SQL} p ON date BETWEEN start AND stop) GROUP BY 1, 2),
    {glcm_sql('SELECT row, col, CAST(trunc(ndvi * 100) AS INTEGER) AS level FROM peak')}
    SELECT row, col, ndvi, ndmi, ndre, Green_Up, Senescence, entropy, contrast FROM peak FULL JOIN fit USING (row, col) FULL JOIN glcm USING (row, col)""", "ndvi ndmi ndre Green_Up Senescence entropy contrast")
def pl_static_s2(spark, sf):
    clear = pipelines.clear_pixels(*(adapter(spark, sf, x) for x in ("px_s2", "px_cs", "px_cld")))
    return pipelines.static_s2(clear, phases(spark)).drop("scene_id")


@query("jn_cat_layers", f"WITH a AS ({_VH}), b AS (SELECT row, col, median(LST) AS LST_med FROM ({_CLEAR_LST}) GROUP BY 1, 2) SELECT row, col, VH_Early, VH_Late, LST_med FROM a FULL JOIN b USING (row, col)", "VH_Early VH_Late LST_med")
def jn_cat_layers(spark, sf):
    a = pipelines.static_s1(adapter(spark, sf, "px_s1"), phases(spark)).select("row", "col", "VH_Early", "VH_Late")
    return a.join(_lst(spark, sf).groupBy("row", "col").agg(F.median("LST").alias("LST_med")), ["row", "col"], "full")
