"""Micro grids, properties, files and streams."""

import gzip
import os
from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from vinegrid.config import DEFAULT_RING, Params
from vinegrid.functions import indices as ix
from vinegrid.operators import geometry, merge, neighborhood, scenes, stats
from vinegrid.plans import pipelines
from vinegrid.schema import EXPORT_COLUMNS, METADATA, export_schema
from vinegrid.sources import files
from vinegrid.streaming import jobs

c = F.col


def grid(spark, rows, cols):
    return spark.range(rows * cols).select((c("id") / cols).cast("int").alias("row"), (c("id") % cols).cast("int").alias("col"))


def square(side, x=0.0, y=0.0, key=1):
    p = [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]
    return [(key, n, *map(float, a), *map(float, b)) for n, (a, b) in enumerate(zip(p, p[1:] + p[:1]))]


EDGES = "parcel_id long, edge_id int, x1 double, y1 double, x2 double, y2 double"


def test_default_ring_counts(spark):
    edges = geometry.edge_table(spark, DEFAULT_RING)
    located = geometry.locate(grid(spark, 135, 100), edges).where("inside").cache()
    assert [located.where(c("dist") >= d).count() for d in (0, 5, 10)] == [7571, 7362, 7157]
    assert abs(geometry.areas(edges).first()["area_m2"] - 756_802) < 2


def test_adaptive_core(spark):
    edges = spark.createDataFrame(square(40, key=1) + square(60, 200.0, key=2) + square(100, 500.0, key=3), EDGES)
    got = {r.parcel_id: r for r in geometry.adaptive_core(edges).collect()}
    assert [(got[k].area_m2, got[k].area_10m, got[k].area_5m, got[k].erosion_m, got[k].is_small_parcel) for k in (1, 2, 3)] == [(1600, 400, 900, 0, 1), (3600, 1600, 2500, 5, 1), (10000, 6400, 8100, 10, 0)]


def rough_ring(n, size=600.0, key=1):
    """A closed ring of ``n`` edges around a centre, in and out at random; the more edges, the finer."""
    rng = np.random.default_rng(5)
    angle, radius = np.sort(rng.uniform(0, 2 * np.pi, n)), size * (0.6 + 0.3 * rng.random(n) / (1 + n / 100))
    points = list(zip((size + radius * np.cos(angle)).tolist(), (size + radius * np.sin(angle)).tolist()))
    return [(key, k, *a, *b) for k, (a, b) in enumerate(zip(points, points[1:] + points[:1]))]


@pytest.mark.parametrize("n", [3, 40, 10_000])
def test_edges_by_tile(spark, n):
    """A tile's edges give what all edges give, and are few, however many the ring has."""
    ring = rough_ring(n)
    edges = spark.createDataFrame(ring, EDGES)
    got = {(r.row, r.col): (r.inside, r.dist) for r in geometry.locate(grid(spark, 130, 130), edges, reach=100.0).collect()}
    e = np.array([r[2:] for r in ring])
    x1, y1, x2, y2 = e.T
    for row, col in list(got)[:: 7 if n > 1000 else 1]:
        x, y = col * 10 + 5.0, row * 10 + 5.0
        over = (y1 > y) != (y2 > y)
        met = over & (x < (x2 - x1) * (y - y1) / np.where(over, y2 - y1, 1) + x1)
        t = np.clip(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2), 0, 1)
        dist = np.hypot(x - x1 - t * (x2 - x1), y - y1 - t * (y2 - y1)).min()
        assert got[row, col][0] == bool(met.sum() % 2) and abs(got[row, col][1] - dist) < 1e-9
    inside = sum(v for v, _ in got.values())
    core = spark.createDataFrame([(1, 0)], "parcel_id long, erosion_m int")
    assert geometry.core_cells(edges, core).count() == inside > 0
    if n == 10_000:
        # near a ring's centre all edges are about as far away: 22 % of the edges a tile on average, 5 % for rays
        tiles = geometry.binned(geometry.rings(edges)).groupBy("tx", "ty").agg(F.count("*").alias("n"), F.count_if("cross").alias("crossing")).collect()
        assert np.mean([r.n for r in tiles]) < n / 4 and np.mean([r.crossing for r in tiles]) < n / 10


def test_erosion_is_monotone(spark):
    edges = geometry.edge_table(spark, DEFAULT_RING)
    located = geometry.locate(grid(spark, 135, 100), edges).where("inside").cache()
    counts = [located.where(c("dist") >= d).count() for d in (0, 3, 7, 12, 30)]
    assert counts == sorted(counts, reverse=True)


def test_dilation_micro_grid(spark):
    px = grid(spark, 5, 5).withColumn("scene_id", F.lit(1)).withColumn("cloudy", (c("row") == 2) & (c("col") == 2))
    found = {(r.row, r.col) for r in neighborhood.dilate(px.where("cloudy")).collect()}
    assert len(found) == 13 and (2, 2) in found and (0, 2) in found and (0, 1) not in found
    assert neighborhood.drop_dilated(px, c("cloudy")).count() == 12


def test_null_mask_seeds_no_dilation(spark):
    px = spark.createDataFrame([(1, 0, 0, None), (1, 0, 1, True), (1, 0, 5, False), (1, 0, 6, True)], "scene_id int, row int, col int, clear boolean")
    assert [r.col for r in neighborhood.drop_dilated(px, ~c("clear")).where("clear").collect()] == [1]


def test_focal_mean_and_offsets(spark):
    assert len(neighborhood.offsets(2.5)) == 21 and len(neighborhood.offsets(2.5, "square")) == 25
    px = grid(spark, 5, 5).withColumns({"scene_id": F.lit(1), "vv": c("row").cast("double")})
    got = {(r.row, r.col): r.vv for r in neighborhood.focal_mean(px, ["vv"]).collect()}
    assert len(got) == 25 and got[(2, 2)] == 2.0 and got[(0, 0)] == pytest.approx(sum(r for r, k in neighborhood.offsets(2.5) if r >= 0 and k >= 0) / 8)


def test_terrain_plane(spark):
    dem = grid(spark, 5, 5).withColumn("elevation", c("col") * 10.0)
    got = neighborhood.terrain(dem).collect()
    assert len(got) == 9 and all(abs(r.slope - 45) < 1e-9 and abs(r.aspect - 270) < 1e-9 for r in got)


def test_glcm_constant_and_stripes(spark):
    flat = neighborhood.glcm(grid(spark, 5, 5).withColumn("level", F.lit(7)), "level").collect()
    assert len(flat) == 25 and all(abs(r.entropy) < 1e-12 and r.contrast == 0 for r in flat)
    stripes = neighborhood.glcm(grid(spark, 3, 3).withColumn("level", c("col") % 2), "level").collect()
    # 3 x 3 cells: 6 pairs across, 6 down, 4 and 4 along the diagonals; unlike levels across and diagonally
    assert all(r.contrast == pytest.approx(14 / 20) for r in stripes)


def slow_glcm(levels, half=3):
    """(entropy, contrast) of each cell by its definition."""
    out = {}
    for r, k in levels:
        pairs = Counter()
        for dr, dc in [(0, 1), (1, 0), (1, 1), (1, -1)]:
            for (a, b), own in levels.items():
                other = levels.get((a + dr, b + dc))
                if own is not None and other is not None and all(abs(v - r) <= half for v in (a, a + dr)) and all(abs(v - k) <= half for v in (b, b + dc)):
                    pairs[own, other] += 1
        n = sum(pairs.values())
        if n:
            out[r, k] = (-sum(v / n * log(v / n) for v in pairs.values()), sum((i - j) ** 2 * v for (i, j), v in pairs.items()) / n)
    return out


@pytest.mark.parametrize("tile", [5, 16])
def test_glcm_over_tiles(spark, tile):
    """Gaps, cells without a level, negative places and any tile give what the definition gives."""
    rng = np.random.default_rng(11)
    levels = {(r, k): int(rng.integers(0, 4)) if rng.random() > 0.1 else None for r in range(-9, 9) for k in range(-3, 20) if rng.random() > 0.1 and not r + k == 20}
    levels[40, 40] = 1
    cells = spark.createDataFrame([(*at, v) for at, v in levels.items()], "row int, col int, level int").repartition(3)
    got = {(r.row, r.col): (r.entropy, r.contrast) for r in neighborhood.glcm(cells, "level", tile=tile).collect()}
    want = slow_glcm(levels)
    assert got.keys() == want.keys() and (40, 40) not in got and all(got[k] == pytest.approx(want[k]) for k in want)


def test_bicubic_reproduces_a_plane(spark):
    coarse = grid(spark, 8, 8).withColumn("v", c("row") * 2.0 + c("col"))
    got = merge.align_bicubic(grid(spark, 16, 16), coarse, "v").where("row BETWEEN 4 AND 11 AND col BETWEEN 4 AND 11").collect()
    assert len(got) == 64 and all(r.v == pytest.approx(((r.row + 0.5) / 2 - 0.5) * 2 + (r.col + 0.5) / 2 - 0.5) for r in got)


def test_indices_zero_denominator_and_range(spark):
    px = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0)], "b2 double, b3 double, b4 double, b5 double, b6 double, b7 double, b8 double, b11 double")
    zero, some = px.select(*[v.alias(k) for k, v in ix.s2_indices().items()]).collect()
    assert all(zero[k] is None for k in ("NDVI", "GNDVI", "IRECI", "NDMI", "NDRE", "MNDWI"))
    assert all(-1 <= some[k] <= 1 for k in ("NDVI", "GNDVI", "NDMI", "NDRE", "MNDWI"))
    written = px.select(*[v.alias(k) for k, v in ix.s2_indices("as_written").items()]).collect()[1]
    assert written["NDRE"] == some["MNDWI"] and written["IRECI"] == 1.0 and written["NDVI"] == some["NDVI"]


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        ix.to_celsius("nowhere")
    with pytest.raises(ValueError):
        Params(profile="other")
    with pytest.raises(ValueError):
        ix.add_columns(spark.range(1).withColumn("NDVI", F.lit(1)), {"ndvi": F.lit(2)})


def test_qa_thresholds(spark):
    rows = [(25, 80.0, 0.6, 0, 1), (24, 80.0, 0.6, 0, 0), (25, 100.0, 0.6, 0, 0), (15, 50.0, 0.5, 1, 1), (15, 50.0, 0.49, 1, 0), (14, 40.0, 0.9, 1, 0)]
    got = stats.validate(spark.createDataFrame(rows, "valid_pixels long, total_pixels double, coverage_ratio double, is_small_parcel int, want int")).collect()
    assert all(r.observation_valid == r.want for r in got)


def test_outer_merge_nulls_and_idempotence(spark):
    a = spark.createDataFrame([("d1", "g1", 1.0), (None, "g2", 2.0)], "date string, geo string, v double")
    b = spark.createDataFrame([("d1", "g1", 5.0), (None, "g2", 6.0), ("d3", "g3", 7.0)], "date string, geo string, v double")
    got = {(r.date, r.geo): (r.a_v, r.b_v) for r in merge.outer_merge({"b": b, "a": a}).collect()}
    assert got == {("d1", "g1"): (1.0, 5.0), (None, "g2"): (2.0, 6.0), ("d3", "g3"): (None, 7.0)}


@pytest.mark.parametrize("kind", ["normal", "ties", "wide", "odd"])
def test_quantiles_by_selection(spark, kind):
    """As ``percentile`` has them, without a map of a group's values."""
    rng = np.random.default_rng(3)
    draw = {
        "normal": lambda n: rng.normal(0, 1, n), "ties": lambda n: rng.integers(-3, 4, n).astype(float),
        "wide": lambda n: rng.choice([-1, 1], n) * 10.0 ** rng.uniform(-300, 300, n), "odd": lambda n: rng.choice([0.0, -0.0, np.nan, np.inf, -np.inf, 1.5, 1e-300], n),
    }[kind]
    rows = [(g, float(v)) for g, n in ((1, 1), (2, 2), (3, 500), (None, 77)) for v in draw(n)] + [(4, None), (4, None), (3, None)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(5)
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = stats.quantiles(df, ["g"], "v", probabilities)
    got = {r.g: (r.p, r.n) for r in found.collect()}
    want = {r.g: (r.p, r.n) for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probabilities))).alias("p"), F.count("v").alias("n")).collect() if r.n}
    assert got.keys() == want.keys() == {1, 2, 3, None}
    for g in want:
        assert got[g][1] == want[g][1] and np.allclose(got[g][0], want[g][0], rtol=1e-12, equal_nan=True)
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_band_stats_of_parcels(spark):
    df = spark.createDataFrame([(1, 1, 1.0, None), (1, 1, 2.0, None), (1, 2, 5.0, 7.0)], "parcel_id int, scene_id int, b4 double, b8 double")
    got = {(r.parcel_id, r.scene_id, r.band): (r.p10, r.median, r.n, r.stddev) for r in stats.band_stats(df, ["parcel_id", "scene_id"], ["b4", "b8"], sample_deviation=True).collect()}
    assert got[1, 1, "b4"] == (1.1, 1.5, 2, 0.5**0.5) and got[1, 1, "b8"] == (None, None, 0, None) and got[1, 2, "b8"] == (7.0, 7.0, 1, None)
    assert stats.band_stats(df.limit(0), ["parcel_id", "scene_id"], ["b4"]).count() == 0


def test_rejects(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (9.0,)], "v double")
    good, bad = scenes.rejects(df, ["v"], 0, 5)
    assert good.count() == 1 and bad.count() == 3


def sensor_rows(spark):
    return spark.createDataFrame([("2025-06-30", 1.5, 2.5, 0.6, '{"type":"Point","coordinates":[5.0,5.0]}'), ("2025-07-31", 2.5, 3.5, 0.7, '{"type":"Point","coordinates":[15.0,5.0]}')], "date string, VV double, VH double, RATIOVHVV double, geo string").withColumn("date", c("date").cast("date"))


def test_csv_round_trip_and_header_blanks(spark, tmp_path):
    files.write_csv(sensor_rows(spark), str(tmp_path), "ROI", "sentinel_1")
    os.makedirs(tmp_path / "ROI" / "landsat_thermal")
    (tmp_path / "ROI" / "landsat_thermal" / "a.csv").write_text('date , LST,.geo\n2025-06-30,20.5,"{""type"":""Point"",""coordinates"":[5.0,5.0]}"\nbroken,x,y\n')
    os.makedirs(tmp_path / "ROI" / "srtm")
    (tmp_path / "ROI" / "srtm" / "b.csv").write_text("elevation,slope,aspect,.geo\n1.0,2.0,3.0,g\n")
    found = files.read_sources(spark, str(tmp_path))
    assert set(found) == {"sentinel_1", "landsat_thermal"}
    assert [(r.LST, r.geo) for r in found["landsat_thermal"].collect()] == [(20.5, '{"type":"Point","coordinates":[5.0,5.0]}')]
    assert {tuple(r) for r in found["sentinel_1"].select("VV", "geo").collect()} == {tuple(r) for r in sensor_rows(spark).select("VV", "geo").collect()}
    assert files.read_static(spark, str(tmp_path))["srtm"].first()["slope"] == 2.0
    folder = spark.read.option("recursiveFileLookup", True).text(str(tmp_path)).select(files.parent_folder().alias("f")).distinct().collect()
    assert {r.f for r in folder} == {"sentinel_1", "landsat_thermal", "srtm"}


def test_empty_export_has_a_header(spark, tmp_path):
    empty = spark.createDataFrame([], export_schema("ecostress")).withColumnRenamed(".geo", "geo")
    files.write_csv(empty, str(tmp_path), "ROI", "ecostress")
    assert files.read_sources(spark, str(tmp_path))["ecostress"].count() == 0


def test_run_twice_changes_nothing(spark, tmp_path):
    raw, out = str(tmp_path / "raw"), str(tmp_path / "out")
    args = (raw, out, "2025-06-10", "2025-07-05", "2025-12-31")
    first = {tuple(r) for r in pipelines.run_pipeline(spark, {"sentinel_1": sensor_rows(spark)}, *args).collect()}
    again = {tuple(r) for r in pipelines.run_pipeline(spark, {"sentinel_1": sensor_rows(spark)}, *args).collect()}
    # the last day of a month counts
    assert len(first) == 2 and first == again
    assert merge.missing_months(spark, files.partitions(spark, out), *args[2:]).isEmpty()


def test_ring_and_metadata(spark, tmp_path):
    assert files.read_ring(spark) == list(DEFAULT_RING) and files.read_ring(spark, str(tmp_path / "none.json")) == list(DEFAULT_RING)
    (tmp_path / "roi.json").write_text('{"type":"Polygon",\n"coordinates":[[[1.0,2.0],[3.0,4.0],[5.0,6.0]]]}')
    assert files.read_ring(spark, str(tmp_path / "roi.json")) == [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]
    sc = spark.createDataFrame([(1, "S1"), (2, "S1"), (2, "S1")], "scene_id long, sensor string")
    rows = files.metadata(sc, "r1", "now", "a", "b", {"S1": ["VV"]}, DEFAULT_RING)
    files.write_metadata(rows, str(tmp_path / "meta"))
    back = spark.read.schema(METADATA).json(str(tmp_path / "meta")).first()
    assert back.image_count == 2 and back.bands_description == ["VV"] and len(back.roi_coords[0]) == 24


def test_export_schemas():
    assert export_schema("sentinel_1").names == ["date", "VV", "VH", "RATIOVHVV", ".geo"] and export_schema("srtm").names == ["elevation", "slope", "aspect", ".geo"]
    assert len(EXPORT_COLUMNS["sentinel_2"]) == 12


def test_stream_ingest_recomputes_months(spark, tmp_path):
    raw, out, state = str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "state")
    files.write_csv(sensor_rows(spark), raw, "ROI", "sentinel_1")
    jobs.ingest_csv(spark, raw, out, state, roi="ROI")
    assert spark.read.parquet(out).count() == 2
    # a file of another layout and one of another source, whose name is new
    (tmp_path / "raw" / "ROI" / "sentinel_1" / "later.csv").write_text(".geo,VH,date,VV\nelsewhere,9.5,2025-06-03,8.5\n")
    jobs.ingest_csv(spark, raw, out, state, roi="ROI")
    assert spark.read.parquet(out).count() == 3
    assert [tuple(r) for r in spark.read.parquet(out).where("geo = 'elsewhere'").select("VV", "VH", "RATIOVHVV").collect()] == [(8.5, 9.5, None)]
    os.makedirs(tmp_path / "raw" / "ROI" / "drone")
    (tmp_path / "raw" / "ROI" / "drone" / "a.csv").write_text("date,height,.geo\n2025-06-03,1.5,elsewhere\n2025-09-01,2.5,there\n")
    jobs.ingest_csv(spark, raw, out, state, roi="ROI")
    got = spark.read.option("mergeSchema", True).parquet(out)
    assert got.count() == 4 and {tuple(r) for r in got.where("height IS NOT NULL").select("geo", "VV", "height").collect()} == {("elsewhere", 8.5, 1.5), ("there", None, 2.5)}


def days_of(spark, out):
    return sorted((str(r.date), r.geo) for r in spark.read.option("mergeSchema", True).parquet(out).select("date", "geo").collect())


def month_files(out):
    return {str(x.relative_to(out)): x.stat().st_mtime_ns for x in sorted(out.glob("year=*/month=*/*.parquet"))}


def put_file(folder, name, *days):
    os.makedirs(folder, exist_ok=True)
    (folder / name).write_text("date,VV,.geo\n" + "".join(f"{d},1.0,{name}\n" for d in days))


@pytest.mark.parametrize("point", ["begun", "written"])
def test_ingest_killed_on_the_way(spark, tmp_path, monkeypatch, point):
    """A batch that stops before or after its months are written, and whose file is another one by the time it runs again."""
    raw, out, state = str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "state")
    folder = tmp_path / "raw" / "ROI" / "sentinel_1"
    put_file(folder, "a.csv", "2025-01-05", "2025-02-05")
    jobs.ingest_csv(spark, raw, out, state, roi="ROI")
    put_file(folder, "b.csv", "2025-03-05", "2025-02-06")
    whole = jobs._replace_months

    def killed(*args):
        if point == "written":
            whole(*args)
        raise RuntimeError("killed")

    monkeypatch.setattr(jobs, "_replace_months", killed)
    with pytest.raises(Exception, match="killed"):
        jobs.ingest_csv(spark, raw, out, state, roi="ROI")
    monkeypatch.setattr(jobs, "_replace_months", whole)
    put_file(folder, "b.csv", "2025-04-05")
    untouched = {k: v for k, v in month_files(tmp_path / "out").items() if "month=1/" in k}
    jobs.ingest_csv(spark, raw, out, state, roi="ROI")
    assert days_of(spark, out) == [("2025-01-05", "a.csv"), ("2025-02-05", "a.csv"), ("2025-04-05", "b.csv")]
    after = month_files(tmp_path / "out")
    assert untouched and untouched.items() <= after.items() and not any("month=3/" in k for k in after)
    # what is done is not done again, by this stream or by a new one
    for checkpoint in (state, str(tmp_path / "other")):
        jobs.ingest_csv(spark, raw, out, checkpoint, roi="ROI")
    assert month_files(tmp_path / "out") == after


def test_ingest_of_replaced_and_removed_files(spark, tmp_path):
    raw, out, state = str(tmp_path / "raw"), str(tmp_path / "out"), str(tmp_path / "state")
    folder = tmp_path / "raw" / "ROI" / "sentinel_1"
    put_file(folder, "a.csv", "2025-01-05", "2025-02-05", "2025-03-05")
    put_file(folder, "b.csv", "2025-05-05")
    put_file(folder, "c.csv", "2025-06-05", "2025-01-07")
    put_file(folder, "empty.csv")
    (folder / "static.csv").write_text("VV,.geo\n1.0,s\n")
    jobs.ingest_csv(spark, raw, out, state, roi="ROI")
    before = month_files(tmp_path / "out")
    put_file(folder, "a.csv", "2025-01-05", "2025-04-05")
    os.remove(folder / "c.csv")
    for _ in range(2):
        jobs.ingest_csv(spark, raw, out, state, roi="ROI")
        assert days_of(spark, out) == [("2025-01-05", "a.csv"), ("2025-04-05", "a.csv"), ("2025-05-05", "b.csv")]
    after = month_files(tmp_path / "out")
    assert {k for k in before if k in after and before[k] == after[k]} == {k for k in before if "month=5/" in k}
    noted = jobs.manifest(spark, out)
    assert noted.where(c("size") == jobs.GONE).select("file").distinct().count() == 1 and noted.agg(F.max("seq")).first()[0] == 2
    put_file(folder, "c.csv", "2025-06-06")  # comes back under its name
    jobs.ingest_csv(spark, raw, out, state, roi="ROI")
    assert ("2025-06-06", "c.csv") in days_of(spark, out)


def test_layouts_unknown_sources_and_bad_files(spark, tmp_path):
    """Columns go by each file's own header, sources by their folder; what can't be read is left out."""
    for name in ("sentinel_1", "drone", "notes"):
        os.makedirs(tmp_path / "ROI" / name)
    one, two = tmp_path / "ROI" / "sentinel_1", tmp_path / "ROI" / "drone"
    (one / "a.csv").write_text('date,VV,VH,RATIOVHVV,.geo\n2025-06-01,1.0,2.0,3.0,"{""a"":[1,2]}"\n')
    (one / "b.csv").write_text(" .geo ,VH, VV,date\ng2,20.0,10.0,2025-06-02\n")
    (one / "c.csv").write_bytes(bytes(range(256)) * 9)
    (one / "d.csv").write_text("")
    (two / "a.csv").write_text("date,height,.geo\n2025-06-01,1.5,g1\n")
    (two / "b.csv").write_text("date,width,.geo\n2025-06-02,2.5,g1\n")
    (tmp_path / "ROI" / "notes" / "a.csv").write_text("some,text\n1,2\n")
    found = files.read_sources(spark, str(tmp_path))
    assert set(found) == {"sentinel_1", "drone"} and files.read_static(spark, str(tmp_path)) == {}
    rows = {(str(r.date), r.VV, r.VH, r.RATIOVHVV, r.geo) for r in found["sentinel_1"].collect()}
    assert rows == {("2025-06-01", 1.0, 2.0, 3.0, '{"a":[1,2]}'), ("2025-06-02", 10.0, 20.0, None, "g2")}
    assert {(str(r.date), r.height, r.width) for r in found["drone"].collect()} == {("2025-06-01", 1.5, None), ("2025-06-02", None, 2.5)}


def test_merge_by_cell_carries_the_place(spark):
    """Sources that name a place differently meet by (date, row, col); the first one's name stays."""
    a = spark.createDataFrame([("d", 0, 0, "a00", 1.0), ("d", 0, 1, "a01", 2.0), (None, 3, None, "a3", 5.0)], "date string, row int, col int, geo string, v double")
    b = spark.createDataFrame([("d", 0, 0, "b00", 3.0), ("d", 1, 1, "b11", 4.0), (None, 3, None, None, 6.0)], "date string, row int, col int, geo string, v double")
    d = spark.createDataFrame([("d", 1, 1, 7.0), ("e", 1, 1, 8.0)], "date string, row int, col int, w double")
    got = merge.outer_merge({"b": b, "a": a, "d": d}, on=("date", "row", "col"), carry=["geo"])
    assert sorted(got.columns) == ["a_v", "b_v", "col", "date", "geo", "row", "w"]
    rows = {(r.date, r.row, r.col): (r.geo, r.a_v, r.b_v, r.w) for r in got.collect()}
    assert rows == {("d", 0, 0): ("a00", 1.0, 3.0, None), ("d", 0, 1): ("a01", 2.0, None, None), (None, 3, None): ("a3", 5.0, 6.0, None), ("d", 1, 1): ("b11", None, 4.0, 7.0), ("e", 1, 1): (None, None, None, 8.0)}
    assert got.count() == 5


def year_of(spark, base, source="sentinel_1"):
    """A row for each month of a year, written by Spark, and files of others beside the month folders."""
    rows = spark.range(12).select(F.make_date(F.lit(2025), c("id") + 1, F.lit(15)).alias("date"), c("id").cast("double").alias("VV"), F.lit(1.0).alias("VH"), F.lit(2.0).alias("RATIOVHVV"), F.lit("g").alias("geo"))
    files.write_csv(rows, str(base), "ROI", source)
    folder = base / "ROI" / source
    (folder / "2025-03-01_2025-04-30.csv").write_text("date,VV,.geo\n2025-03-01,103.0,h\n2025-04-30,104.0,h\n")
    (folder / "2025-07-01_2025-07-31.csv").write_text("date,VV,.geo\n2025-07-01,107.0,h\n")
    (folder / "undated.csv").write_text("date,VV,.geo\n2025-07-02,207.0,h\n2025-01-02,201.0,h\n")
    return rows


def test_only_files_of_the_months_are_opened(spark, tmp_path):
    year_of(spark, tmp_path)
    found = files.read_sources(spark, str(tmp_path), months=["2025-04", "2025-11"])["sentinel_1"]
    opened = {x.split("/sentinel_1/")[1].split("/part-")[0] for x in found.inputFiles() if x.endswith(".csv")}
    assert opened == {"month=2025-04", "month=2025-11", "2025-03-01_2025-04-30.csv", "undated.csv"}
    assert sorted(r.VV for r in found.collect()) == [3.0, 10.0, 103.0, 104.0, 201.0, 207.0]
    assert files.month_paths(spark, f"{tmp_path}/ROI/sentinel_1", []) == [f"file:{tmp_path}/ROI/sentinel_1/undated.csv"]
    assert files.read_sources(spark, str(tmp_path)).keys() == {"sentinel_1"} and files.read_sources(spark, str(tmp_path))["sentinel_1"].count() == 17


def test_backfill_leaves_other_months_closed(spark, tmp_path):
    """Files of months that are there are made unreadable: a backfill of one month of twelve doesn't notice."""
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    rows = year_of(spark, raw)
    pipelines.merged_dataset(spark, str(raw), out)
    before = sorted(map(str, spark.read.parquet(out).collect()))
    july = tmp_path / "out" / "year=2025" / "month=7"
    for x in july.iterdir():
        x.unlink()
    july.rmdir()
    for x in (raw / "ROI" / "sentinel_1").glob("month=*/*.csv"):
        if "month=2025-07" not in str(x):
            x.write_text("not,a,header\nat,all\n")
    got = pipelines.run_pipeline(spark, {"sentinel_1": rows}, str(raw), out, "2025-01-01", "2025-12-31", "2025-12-31", roi="ROI")
    assert sorted(map(str, got.collect())) == before


def test_known_headers_need_no_file(spark, tmp_path):
    """Headers that the writer noted are taken from there; a file that was changed since is opened."""
    year_of(spark, tmp_path)
    known = f"{tmp_path}/{files.HEADERS}"
    heads, _ = files._headers(spark, f"{tmp_path}/ROI/sentinel_1", known)
    assert heads.count() == 15 and {r._header for r in heads.collect()} == {"date,VV,VH,RATIOVHVV,.geo", "date,VV,.geo"}
    one = next((tmp_path / "ROI" / "sentinel_1").glob("month=2025-05/*.csv"))
    (one.parent / f".{one.name}.crc").unlink()
    one.write_text("VV,date,.geo\n55.0,2025-05-05,h\n")
    assert sorted(r.VV for r in files.read_sources(spark, str(tmp_path), months=["2025-05"])["sentinel_1"].collect()) == [55.0, 201.0, 207.0]


def test_any_number_of_layouts(spark, tmp_path):
    """More headers than one expression could hold a branch for; empty names keep their places."""
    folder = tmp_path / "ROI" / "drone"
    os.makedirs(folder)
    for k in range(300):
        (folder / f"{k}.csv").write_text(f",b{k},date,,.geo\n9,{k}.5,2025-06-01,8,g{k}\n")
    found = files.read_sources(spark, str(tmp_path))["drone"]
    assert len(found.columns) == 302
    wide = found.select("geo", F.coalesce(*[c(f"b{k}") for k in range(300)]).alias("v")).collect()
    assert sorted((r.geo, r.v) for r in wide) == sorted((f"g{k}", k + 0.5) for k in range(300))


def test_export_replaces_its_months(spark, tmp_path):
    for _ in range(2):
        files.write_csv(sensor_rows(spark), str(tmp_path), "ROI", "sentinel_1")
    files.write_csv(sensor_rows(spark).where("date < '2025-07-01'").withColumn("VV", F.lit(9.0)), str(tmp_path), "ROI", "sentinel_1")
    assert sorted(r.VV for r in files.read_sources(spark, str(tmp_path))["sentinel_1"].collect()) == [2.5, 9.0]


@pytest.mark.parametrize(("n", "step"), [(3, 1.0), (40, 1.0), (40, 2.5), (1000, 1.0)])
def test_eroded_areas_by_all_cells(spark, n, step):
    """Swept rows count the cells that a test of every cell against every edge counts."""
    rings_ = rough_ring(n, 60.0) + rough_ring(n, 25.0, 2) + square(40, 7.5, key=3) + square(0.2, 0.1, key=4)
    got = {r.parcel_id: (r.a, r.b) for r in geometry.eroded_areas(spark.createDataFrame(rings_, EDGES), {"a": 10.0, "b": 3.0}, step).collect()}
    at = (np.arange(-20, 140) + 0.5) * step
    x, y = np.meshgrid(at, at)
    for key in (1, 2, 3, 4):
        odd, dist = np.zeros(x.shape, bool), np.full(x.shape, np.inf)
        for _, _, x1, y1, x2, y2 in (r for r in rings_ if r[0] == key):
            dx, dy = x2 - x1, y2 - y1
            if dy:
                odd ^= ((y1 > y) != (y2 > y)) & (x < dx * (y - y1) / dy + x1)
            t = np.clip(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0, 1)
            dist = np.minimum(dist, np.hypot(x - (x1 + t * dx), y - (y1 + t * dy)))
        assert got[key] == tuple((odd & (dist >= m)).sum() * step * step for m in (10.0, 3.0))


def test_erosion_stays_in_the_engine(spark):
    plan = geometry.adaptive_core(spark.createDataFrame(square(40), EDGES))._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Python" not in plan and "Window" in plan


def test_large_parcel_on_fine_cells(spark):
    """5 ha are counted on cells of 1 m like any other parcel."""
    side = 223.0
    edges = spark.createDataFrame(square(side, 3.0), EDGES)
    got = geometry.adaptive_core(edges).first()
    assert (got.area_10m, got.area_5m) == ((side - 20) ** 2, (side - 10) ** 2)


def test_meteo_stream_keeps_days_open(spark, tmp_path):
    """Days change as rows come; what is over a day late is left out."""
    feed, out, state = str(tmp_path / "feed"), str(tmp_path / "out"), str(tmp_path / "state")
    schema = "ts timestamp, cell_id long, temp_c double"

    def run(*rows):
        spark.createDataFrame([(t, 1, v) for t, v in rows], "ts string, cell_id long, temp_c double").withColumn("ts", c("ts").cast("timestamp")).write.mode("append").parquet(feed)
        jobs.daily_meteo(spark.readStream.schema(schema).parquet(feed), out, state)
        return {(str(r.date), r.MIN_TEMP_C, r.MAX_TEMP_C) for r in jobs.latest_meteo(spark, out).collect()}

    assert run(("2025-06-01 05:00:00", 4.0), ("2025-06-01 06:00:00", 5.0)) == {("2025-06-01", 4.0, 5.0)}
    assert run(("2025-06-01 12:00:00", 9.0), ("2025-06-05 12:00:00", 7.0)) == {("2025-06-01", 4.0, 9.0), ("2025-06-05", 7.0, 7.0)}
    assert run(("2025-06-01 13:00:00", 99.0), ("2025-06-05 13:00:00", 6.0)) == {("2025-06-01", 4.0, 9.0), ("2025-06-05", 6.0, 7.0)}


def test_scene_filters_are_pushed_down(spark, tmp_path):
    path = str(tmp_path / "scenes")
    spark.createDataFrame([(1, "S2", 10.0), (2, "S1", 20.0)], "scene_id long, sensor string, cloud_pct double").write.parquet(path)
    plan = scenes.retrieve(spark.read.parquet(path), ["S2"], cloud_max=50.0)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(cloud_pct,50.0)" in plan and ("EqualTo(sensor,S2)" in plan or "In(sensor" in plan)


def test_shadows_by_scene_angles(spark):
    """By hand: at 45 degrees a cloud at 50 m casts 5 cells away, opposite of the sun; each scene by its own angles."""
    sun = spark.createDataFrame([(1, 180.0, 45.0), (2, 270.0, 45.0), (3, None, 45.0), (4, 180.0, 90.0), (5, 180.0, None), (6, 180.0, 0.0)], "scene_id int, azimuth double, zenith double")
    moves = {(r.scene_id, r.r, r.k) for r in neighborhood.shadow_moves(sun, [50.0, 100.0]).collect()}
    assert moves == {(1, 5, 0), (1, 10, 0), (2, 0, 5), (2, 0, 10), (6, 0, 0)}
    core = spark.createDataFrame([(k, 10, 10) for k in (*range(1, 8), 1)], "scene_id int, row int, col int")
    dark = spark.createDataFrame([(k, r, q) for k in range(1, 8) for r in range(21) for q in range(21)], "scene_id int, row int, col int")
    got = {tuple(r) for r in neighborhood.scene_shadows(core, dark, sun, [50.0, 100.0], widen=0).collect()}
    assert got == {(1, 15, 10), (1, 20, 10), (2, 10, 15), (2, 10, 20), (6, 10, 10)}
    wide = {tuple(r) for r in neighborhood.scene_shadows(core, dark.where("scene_id = 1 AND row < 16"), sun, [50.0, 100.0]).collect()}
    assert wide == {(1, 15 + r, 10 + k) for r, k in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))}


def test_clear_pixels_lose_shadows(spark):
    """A likely cloud of another product, and one by class, shade dark pixels; bright ones and water stay."""
    cells = [(1, r, k) for r in range(16) for k in range(3)]
    scl = {(0, 0): 9, (6, 0): 6}
    px = spark.createDataFrame([(*x, 4000.0 if x[1:] == (5, 2) else 1000.0, scl.get(x[1:], 4)) for x in cells], "scene_id int, row int, col int, b8 double, scl int")
    cs = spark.createDataFrame([(*x, 1.0, 1.0) for x in cells], "scene_id int, row int, col int, cs double, cs_cdf double")
    cld = spark.createDataFrame([(*x, 60.0 if x[1:] == (0, 2) else 0.0) for x in cells], "scene_id int, row int, col int, probability double")
    sun = spark.createDataFrame([(1, 180.0, 45.0)], "scene_id int, azimuth double, zenith double")
    params = Params(dilation_cells=0, cloud_heights_m=(50.0, 60.0, 100.0))
    kept = {(r.row, r.col) for r in pipelines.clear_pixels(px, cs, cld, params, sun=sun).collect()}
    hit = {(5, 0), (10, 0), (6, 2), (10, 2)}  # (6, 0) is water, (5, 2) bright
    shaded = {(r + a, k + b) for r, k in hit for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))}
    assert kept == {x[1:] for x in cells} - shaded - {(0, 0), (0, 2)}


def test_calendar_periods(spark):
    days = spark.createDataFrame([("2024-12-30",), ("2025-01-05",), ("1969-12-31",), (None,)], "d string").select(c("d").cast("date").alias("d"))
    at = lambda every: [None if r[0] is None else str(r[0]) for r in days.select(stats.period_start("d", every)).collect()]
    assert at("week") == ["2024-12-30", "2024-12-30", "1969-12-29", None]
    assert at("month") == ["2024-12-01", "2025-01-01", "1969-12-01", None]
    assert at(7) == at("week") and at(14)[2:] == ["1969-12-22", None]


def test_period_stats(spark):
    rows = [(1, "2025-06-02", 1.0), (1, "2025-06-08", 3.0), (1, "2025-06-08", None), (1, "2025-06-09", 7.0), (None, "2025-06-09", 5.0)]
    px = spark.createDataFrame(rows, "parcel_id int, date string, v double").withColumn("date", c("date").cast("date"))
    got = {(r.parcel_id, str(r.period)): (r.median, r.n, r.days, str(r.first_day), str(r.last_day)) for r in stats.period_stats(px, ["v"]).collect()}
    assert got == {
        (1, "2025-06-02"): (2.0, 2, 2, "2025-06-02", "2025-06-08"), (1, "2025-06-09"): (7.0, 1, 1, "2025-06-09", "2025-06-09"),
        (None, "2025-06-09"): (5.0, 1, 1, "2025-06-09", "2025-06-09"),
    }
    assert stats.period_stats(px.limit(0), ["v"]).count() == 0


def test_anomaly_by_days_and_not_by_rows(spark):
    """A gap empties the frame, rows of the same day don't count for each other."""
    rows = [("a", "2024-02-27", 1.0), ("a", "2024-02-28", 3.0), ("a", "2024-02-29", 5.0), ("a", "2024-03-01", 5.0), ("a", "2024-03-01", 7.0), ("a", "2024-06-01", 9.0), ("a", None, 2.0), ("b", "2024-03-01", 4.0)]
    df = spark.createDataFrame(rows, "k string, date string, v double").withColumn("date", c("date").cast("date"))
    got = {(r.k, r.date and str(r.date), r.v): (r.n_before, r.mean_before, r.z) for r in stats.calendar_anomaly(df, ["k"], "date", "v", 10).collect()}
    dev = (8 / 3) ** 0.5
    assert got[("a", "2024-03-01", 5.0)] == (3, 3.0, pytest.approx(2 / dev)) and got[("a", "2024-03-01", 7.0)] == (3, 3.0, pytest.approx(4 / dev))
    assert got[("a", "2024-02-29", 5.0)] == (2, 2.0, None)  # fewer than three
    assert got[("a", "2024-06-01", 9.0)] == (0, None, None) and got[("a", None, 2.0)] == (0, None, None) and got[("b", "2024-03-01", 4.0)] == (0, None, None)


def test_weeks_on_years(spark):
    """2020 has 53 weeks, 2019 has 52; a gap is filled from next to it, the earlier week first."""
    monday = lambda y, w: str(np.datetime64(f"{y}-01-04") - np.timedelta64(int((np.datetime64(f"{y}-01-04").astype(int) + 3) % 7), "D") + np.timedelta64(7 * (w - 1), "D"))
    rows = [("a", monday(2020, 53), 1.0), ("a", monday(2019, 52), 4.0), ("a", monday(2020, 9), 2.0), ("a", monday(2019, 8), 5.0), ("a", monday(2019, 10), 6.0), ("a", monday(2021, 9), 3.0), ("b", monday(2021, 9), 3.0), (None, monday(2020, 9), 2.0), (None, monday(2019, 9), 1.0)]
    df = spark.createDataFrame(rows, "k string, week string, v double").withColumn("week", c("week").cast("date"))
    out = {(r.k, str(r.week), r.years_back): (str(r.then_week), r.then, r.weeks_off, r.change) for r in stats.week_on_years(df, ["k"], "v", (1, 2)).collect()}
    assert out == {
        ("a", monday(2020, 53), 1): (monday(2019, 52), 4.0, 0, -3.0), ("a", monday(2020, 9), 1): (monday(2019, 8), 5.0, -1, -3.0),
        ("a", monday(2021, 9), 1): (monday(2020, 9), 2.0, 0, 1.0), ("a", monday(2021, 9), 2): (monday(2019, 8), 5.0, -1, -2.0),
    }
    assert stats.week_on_years(df, ["k"], "v", (1,), 0).count() == 2


def test_source_without_rows_is_counted(spark, tiny, tmp_path):
    """Files that hold the header alone have a row with none, not no row."""
    from vinegrid.queries import QUERIES

    spark.read.parquet(f"{tiny}/lineitem.parquet").where("(l_orderkey * l_linenumber) & 24 <> 0").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r["source"]: r["n"] for r in QUERIES["src_parent_folder"](spark, str(tmp_path)).collect()}
    assert set(found) == {"sentinel_1", "ecostress", "landsat_thermal"} and found["landsat_thermal"] == 0 < found["sentinel_1"]


def test_rounding_as_the_twin_does(spark):
    """The scaled double decides, not its text; halves go away from zero."""
    import duckdb

    values = [0.2417845, 0.0896215, 0.25452049999999995, 0.1234565, -0.1234565, 1.0000005, 2.5, 1e300, 1e305, 0.0, float("inf"), float("nan"), None]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x double").orderBy("k").select(ix.rounded(c("x"))).collect()]
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0] for x in values]
    assert [repr(x) for x in got] == [repr(x) for x in want]


def test_stats_of_groups_that_a_task_holds(spark):
    """One aggregation gives what distributed selection gives, nulls and groups without a value included."""
    rows = [(k, float((k * 7 + j * j * 3) % 11) if (k + j) % 3 else None, None if k == 2 else -0.0 if j % 2 else float("nan") if k == 3 else j / 7) for k in range(4) for j in range(k * 3 + 1)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    text = lambda found: sorted(str([x + 0.0 if isinstance(x, float) else x for x in r]) for r in found.collect())
    one, other = (stats.band_stats(df, ["k"], ["a", "b"], small=x) for x in (True, False))
    cut = lambda found: found.select("k", "band", *[F.round(x, 9).alias(x) for x in [*stats.PERCENTILES, "stddev"]], "n")
    assert text(cut(one)) == text(cut(other)) and one.count() == 8


def test_parcels_in_chunks_and_by_cell(spark, tiny, monkeypatch):
    """Small parcels meet pixels in chunks, large ones by cell: rows are the same however parcels are dealt."""
    from vinegrid.queries import QUERIES

    names = ["agg_parcel_stats", "jn_scene_stats", "cv_qa_columns", "qa_validate", "agg_parcel_fortnightly"]
    rows = lambda: {x: Counter(map(str, QUERIES[x](spark, tiny).collect())) for x in names}
    chunks = rows()
    assert all(chunks.values())
    monkeypatch.setattr(pipelines, "LARGE_CELLS", 25)
    monkeypatch.setattr(geometry, "CHUNK_PARCELS", 1)
    mixed = rows()
    for name in names:
        assert chunks[name] == mixed[name], name


def shares(found):
    """How many of the rows each task found."""
    return [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]


def test_cells_of_parcels_are_dealt_to_tasks(spark):
    """Parcels are few bytes, so adaptive execution would leave one task with all their cells."""
    edges = spark.createDataFrame([e for p in range(2000) for e in square(50, p % 19 * 10, p % 17 * 10, key=p)], EDGES)
    found = shares(geometry.locate(grid(spark, 24, 24), edges, 20.0))
    assert len(found) >= 4 and max(found) < sum(found) / 2


def test_more_tiles_are_more_tasks(spark, monkeypatch):
    """A task's share follows from its tiles, not from the parcels' number or size; a large parcel is dealt in pieces, with the same cells."""
    cells, key = grid(spark, 130, 130), lambda r: (r.parcel_id, r.row, r.col, r.inside, r.dist)
    for edges in (rough_ring(40), [e for p in range(40) for e in square(75, p * 10, p * 20, key=p)]):
        edges = spark.createDataFrame(edges, EDGES)
        whole = Counter(map(key, geometry.locate(cells, edges, 100.0).collect()))
        core = geometry.adaptive_core(edges).select("parcel_id", "erosion_m")
        kept = Counter(map(tuple, geometry.core_cells(edges, core).collect()))
        with monkeypatch.context() as m:
            m.setattr(geometry, "TASK_TILES", 16)
            m.setattr(geometry, "PIECE_TILES", 8)
            found = shares(geometry.binned(geometry.rings(edges, 100.0)))
            assert len(found) > 4 and max(found) < sum(found) / 2
            assert Counter(map(key, geometry.locate(cells, edges, 100.0).collect())) == whole and max(whole.values()) == 1
            assert Counter(map(tuple, geometry.core_cells(edges, core).collect())) == kept and kept


def test_pixels_beside_parcels_are_not_shuffled(spark, tiny):
    """Once pixels have met their parcels, no row of them is sent again: the shuffles lie below that join."""
    from vinegrid.queries import QUERIES

    for name in ("agg_parcel_stats", "jn_scene_stats", "cv_qa_columns", "qa_validate", "agg_parcel_weekly", "pl_s2"):
        plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString().split("\n")
        met = next(k for k, line in enumerate(plan) if "Join [chunk" in line)
        assert not any("Exchange" in line for line in plan[:met]), name


def test_folder_of_a_row_is_cut_not_matched(spark, tmp_path):
    """The folder comes from the path's slashes; no pattern is run on the path of every row."""
    spark.range(3).selectExpr("'2024-01-01' AS date").write.option("header", True).csv(f"{tmp_path}/a b/output")
    found = files.csv_rows(spark, f"{tmp_path}/a b/output").select(files.folder_of_file().alias("folder"))
    assert [r[0] for r in found.collect()] == ["output"] * 3
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString()


def shared_cells(spark, parcels=50, cells=400):
    """Sentinel-2 rows of parcels that share their cells, dealt to tasks by parcel; a cell's values are the same in each of them."""
    own = spark.range(parcels * cells, numPartitions=1).select((c("id") % cells).alias("cell"), F.floor(c("id") / cells).alias("parcel")).repartition(4, "parcel")
    value = lambda k: F.xxhash64("cell", F.lit(k)) % 1_000_000 / 999_983
    whole = {x: F.col("parcel").cast("int") for x in ("valid_pixels", "observation_valid", "erosion_m", "is_small_parcel")}
    values = [whole.get(x, value(k)).alias(x) for k, x in enumerate(EXPORT_COLUMNS["sentinel_2"])]
    return own.select(F.date_add(F.lit("2025-06-01").cast("date"), (c("cell") % 60).cast("int")).alias("date"), *values, F.concat(F.lit('{"a":['), "cell", F.lit(',1]}')).alias("geo"))


def data_files(folder):
    return [x for x in folder.rglob("part-*")]


def test_single_export_is_small_on_disk(spark, tiny, tmp_path, monkeypatch):
    """compressed rows lie in order, so a cell's values, which all its parcels repeat, cost next to nothing; none is lost."""
    from vinegrid.queries import QUERIES

    rows, size = shared_cells(spark), {}
    for how in (None, "gzip"):
        files.write_single(rows, str(tmp_path / str(how)), "sentinel_2", how)
        size[how] = sum(x.stat().st_size for x in data_files(tmp_path / str(how)))
    assert size["gzip"] < size[None] / 12, size
    kept = lambda how: Counter(map(tuple, files.csv_rows(spark, str(tmp_path / how)).collect()))
    assert kept("gzip") == kept("None") and sum(kept("gzip").values()) == 20_000
    monkeypatch.setattr(files, "FILE_ROWS", 1000)  # a compressed file is one task's, so none is large
    files.write_single(rows, str(tmp_path / "cut"), "sentinel_2", "gzip")
    assert len(data_files(tmp_path / "cut")) >= 20 and kept("cut") == kept("gzip")
    assert all(x.endswith(".csv.gz") for x in QUERIES["sink_csv_step2"](spark, tiny).inputFiles())


def test_an_export_leaves_no_shuffle_files(spark, tmp_path):
    """what was shuffled for an export goes when it is written, and the session's setting is as it was."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    before = shuffled()
    files.write_single(shared_cells(spark), str(tmp_path / "out"), "sentinel_2", "gzip")
    assert not shuffled() - before and spark.conf.get(files._CLEANUP) == "false"


def test_tree_of_compressed_exports(spark, tiny, tmp_path):
    """a compressed tree is read, replaced by month, and its headers are noted, as those of a plain one are."""
    from vinegrid.queries import QUERIES

    rows, size = shared_cells(spark), {}
    for how in (None, "gzip"):
        base = tmp_path / str(how)
        files.write_csv(rows, str(base), "ROI", "sentinel_2", how)
        size[how] = sum(x.stat().st_size for x in data_files(base / "ROI"))
    assert size["gzip"] < size[None] / 12, size
    read = lambda how, months=None: files.read_sources(spark, str(tmp_path / how), months=months)["sentinel_2"]
    kept = lambda *how: Counter(map(tuple, read(*how).collect()))
    assert kept("gzip") == kept("None") and sum(kept("gzip").values()) == 20_000
    folder = tmp_path / "gzip" / "ROI" / "sentinel_2"
    heads, facts = files._headers(spark, str(folder), f"{tmp_path}/gzip/{files.HEADERS}")
    assert heads.count() == len(data_files(folder)) and facts["unknown"] == 0
    # others' files of another layout, one compressed and named by its days
    (folder / "2025-06-01_2025-06-30.csv.gz").write_bytes(gzip.compress(b".geo,date,NDVI\nh,2025-06-02,5.5\n"))
    (folder / "later.csv").write_text("date,.geo,NDVI\n2025-07-02,k,6.5\n")
    assert sum(kept("gzip").values()) == 20_002
    july = read("gzip", ["2025-07"])
    assert not any("2025-06" in x for x in july.inputFiles()) and july.where("NDVI = 6.5").count() == 1
    files.write_csv(rows.where("date < '2025-07-01'").limit(7), str(tmp_path / "gzip"), "ROI", "sentinel_2", "gzip")
    assert read("gzip", ["2025-06"]).where("NDVI <> 6.5 AND NDVI <> 5.5").count() == 7
    empty = spark.createDataFrame([], export_schema("ecostress")).withColumnRenamed(".geo", "geo")
    files.write_csv(empty, str(tmp_path), "ROI", "ecostress", "gzip")
    assert files.read_sources(spark, str(tmp_path))["ecostress"].count() == 0
    for name in ("sink_csv_s2", "sink_csv_srtm"):
        written = [x for x in QUERIES[name](spark, tiny).inputFiles() if "ROI_TEST" in x]
        assert written and all(x.endswith(".csv.gz") for x in written), name


def test_ingest_of_compressed_files(spark, tmp_path):
    """compressed files are taken in as plain ones are."""
    raw, out, state = (str(tmp_path / x) for x in ("raw", "out", "state"))
    files.write_csv(sensor_rows(spark), raw, "ROI", "sentinel_1", "gzip")
    jobs.ingest_csv(spark, raw, out, state, roi="ROI")
    assert days_of(spark, out) == sorted((str(r.date), r.geo) for r in sensor_rows(spark).collect())


def test_round_trip_takes_noted_headers(spark, tiny, monkeypatch):
    """the export's headers are those that the writer noted; its lines are not read, and sorted, for them."""
    from vinegrid.queries import QUERIES

    def opened(*_):
        raise AssertionError("files are opened for their headers")

    monkeypatch.setattr(files, "_first_lines", opened)
    assert all(QUERIES[name](spark, tiny).count() for name in ("sink_csv_s2", "sink_csv_srtm", "sink_csv_era5"))


def test_read_back_of_a_compressed_export(spark, tiny, monkeypatch):
    """the file that is read again is compressed; types are inferred and sums are those of a plain one."""
    from vinegrid.queries import QUERIES

    packed = QUERIES["src_read_back"](spark, tiny)
    assert packed.inputFiles() and all(x.endswith(".csv.gz") for x in packed.inputFiles())
    write = files.write_single
    monkeypatch.setattr(files, "write_single", lambda df, path, source, compression=None: write(df, path, source))
    plain = QUERIES["src_read_back"](spark, tiny)
    assert all(x.endswith(".csv") for x in plain.inputFiles())
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, plain.collect())) and packed.dtypes == plain.dtypes
