"""Polygons as edge tables: containment, distance, area and adaptive erosion, for many parcels at once.

Pixels meet parcels through coarse tiles of the parcels' boxes, so no pair further apart than a tile is formed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from math import cos, radians

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: Side of a tile in metres.
TILE = 80.0


def ring_edges(ring, parcel_id: int = 1) -> list[tuple[int, int, float, float, float, float]]:
    """Edges of a lon/lat ring in local metres from its south-west corner, closed, without edges of no length."""
    lat0 = sum(p[1] for p in ring) / len(ring)
    west, south = min(p[0] for p in ring), min(p[1] for p in ring)
    points = [((x - west) * 111320 * cos(radians(lat0)), (y - south) * 110540) for x, y in ring]
    pairs = [(a, b) for a, b in zip(points, points[1:] + points[:1]) if a != b]
    return [(parcel_id, n, *a, *b) for n, (a, b) in enumerate(pairs)]


def edge_table(spark, ring, parcel_id: int = 1) -> DataFrame:
    return spark.createDataFrame(ring_edges(ring, parcel_id), "parcel_id long, edge_id int, x1 double, y1 double, x2 double, y2 double")


def crosses(x: Column, y: Column) -> Column:
    """1 if a ray to the east meets the edge."""
    x1, y1, x2, y2 = (c(k) for k in ("x1", "y1", "x2", "y2"))
    over = (y1 > y) != (y2 > y)
    return F.when(over, (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1).cast("int")).otherwise(0)


def edge_distance(x: Column, y: Column, of: Callable[[str], Column] = c) -> Column:
    """Distance of a point from the edge, whose coordinates ``of`` gives by name."""
    x1, y1, x2, y2 = (of(k) for k in ("x1", "y1", "x2", "y2"))
    dx, dy = x2 - x1, y2 - y1
    t = F.least(F.greatest(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
    gx, gy = x - (x1 + t * dx), y - (y1 + t * dy)
    return F.sqrt(gx * gx + gy * gy)


def rings(edges: DataFrame, reach: float = 0.0) -> DataFrame:
    """A row per parcel: its edges as one array and its box, widened by ``reach``."""
    return edges.groupBy("parcel_id").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("ring"),
        (F.min(F.least("x1", "x2")) - reach).alias("min_x"), (F.max(F.greatest("x1", "x2")) + reach).alias("max_x"),
        (F.min(F.least("y1", "y2")) - reach).alias("min_y"), (F.max(F.greatest("y1", "y2")) + reach).alias("max_y"),
    )


def _tile(v: Column) -> Column:
    return F.floor(v / TILE).cast("int")


def _tiled(parcels: DataFrame) -> DataFrame:
    """A row per parcel and tile (tx, ty) of its box."""
    line = lambda lo, hi: F.explode(F.sequence(_tile(c(lo)), _tile(c(hi))))
    return parcels.withColumn("tx", line("min_x", "max_x")).withColumn("ty", line("min_y", "max_y"))


#: Metres that bounds are widened by, against rounding.
SLACK = 1e-6


#: Tiles of one task, about, and of one piece of a parcel at most; what a task holds is bounded by them, whatever the parcels and their size.
TASK_TILES = 8192
PIECE_TILES = 1024


def dealt(parcels: DataFrame) -> DataFrame:
    """Parcels in pieces of tile columns (``piece`` to ``last``), dealt to as many tasks as their tiles ask for, at least the shuffle partitions.

    The tiles are counted first. As ``piece`` is of the key, Spark can't take an earlier shuffle by parcel for this one, which
    adaptive execution would then make few tasks of: parcels are few bytes, but many cells.
    """
    side = lambda v: (_tile(c(f"max_{v}")) - _tile(c(f"min_{v}")) + 1).cast("long")
    tiles = parcels.agg(F.sum(side("x") * side("y"))).first()[0] or 0
    tasks = max(int(parcels.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tiles // TASK_TILES))
    width = F.greatest(F.floor(PIECE_TILES / side("y")), F.lit(1)).cast("int")
    pieces = parcels.withColumn("width", width).withColumn("piece", F.explode(F.sequence(_tile(c("min_x")), _tile(c("max_x")), c("width"))))
    return pieces.withColumn("last", F.least(c("piece") + c("width") - 1, _tile(c("max_x")))).drop("width").repartition(tasks, "parcel_id", "piece")


def binned(parcels: DataFrame) -> DataFrame:
    """Edges by the tiles of the parcels' boxes: a row per parcel, tile (tx, ty) and edge that the tile's points need; pieces are those of ``dealt``.

    ``near``: the edge may be the nearest of a point in the tile, as it is no further from the tile's centre than the nearest one
    and the tile's diagonal. ``cross``: points of the tile may differ in whether their ray to the east meets the edge. Of the other
    edges, those east of the tile that pass all its height are met by every ray; ``parity`` tells if they are odd. A tile has at
    least one row, and all edges are judged once a tile, not once a point.
    """
    x0, y0 = c("tx") * TILE - SLACK, c("ty") * TILE - SLACK
    x9, y9 = x0 + TILE + 2 * SLACK, y0 + TILE + 2 * SLACK
    low, high = (lambda v, of=c, f=f: f(of(f"{v}1"), of(f"{v}2")) for f in (F.least, F.greatest))
    middle = lambda of=c: edge_distance((c("tx") + 0.5) * TILE, (c("ty") + 0.5) * TILE, of)
    whole = lambda of=c: (low("x", of) > x9) & (low("y", of) < y0) & (high("y", of) > y9)
    beside = (high("y") < y0) | (low("y") > y9) | (high("x") < x0)
    key, boxes = ["parcel_id", "piece", "tx", "ty"], ["min_x", "max_x", "min_y", "max_y"]
    columns = dealt(parcels).withColumn("tx", F.explode(F.sequence("piece", "last")))
    tiled = columns.withColumn("ty", F.explode(F.sequence(_tile(c("min_y")), _tile(c("max_y")))))
    facts = {"least": F.array_min(F.transform("ring", lambda e: middle(e.getField))), "parity": F.size(F.filter("ring", lambda e: whole(e.getField))) % 2}
    met = tiled.withColumns(facts).select(*key, *boxes, "least", "parity", F.inline("ring"))
    judged_ = met.withColumns({"near": middle() <= c("least") + TILE * 2**0.5 + SLACK, "cross": ~beside & ~whole()})
    return judged_.where("near OR cross").drop("least")


def judged(met: DataFrame) -> DataFrame:
    """(parcel_id, row, col, inside, dist) of points (parcel_id, row, col, x, y) beside the binned edges of their tile.

    A point is in one tile and so in one piece; grouped by it, too, points stay in the tasks that the pieces were dealt to.
    """
    odd = F.sum(F.when(c("cross"), crosses(c("x"), c("y"))).otherwise(0)) + F.max("parity")
    found = met.groupBy("parcel_id", "piece", "row", "col").agg((odd % 2 == 1).alias("inside"), F.min(F.when(c("near"), edge_distance(c("x"), c("y")))).alias("dist"))
    return found.drop("piece")


def box_tiles(edges: DataFrame, reach: float = 0.0) -> DataFrame:
    """The tiles (tx, ty) that the parcels' boxes, widened by ``reach``, touch."""
    box = edges.groupBy("parcel_id").agg(*[(f(g(f"{v}1", f"{v}2")) + sign * reach).alias(f"{name}_{v}") for v in "xy" for name, f, g, sign in (("min", F.min, F.least, -1), ("max", F.max, F.greatest, 1))])
    return _tiled(box).select("tx", "ty").distinct()


def in_tiles(cells: DataFrame, tiles: DataFrame, scale: float = 10.0) -> DataFrame:
    """Cells whose centre is in one of the tiles; Spark broadcasts the tiles where their size allows it."""
    at = lambda v: _tile(c(v) * scale + scale / 2)
    return cells.withColumns({"tx": at("col"), "ty": at("row")}).join(tiles, ["tx", "ty"], "left_semi").drop("tx", "ty")


#: Parcels of one chunk, about; what a task does with them is bounded by it.
CHUNK_PARCELS = 400


def chunked(edges: DataFrame, size: int = CHUNK_PARCELS) -> tuple[DataFrame, DataFrame]:
    """Parcels in chunks of neighbours: (parcel_id, chunk), and the tiles (chunk, tx, ty) that the boxes of a chunk touch.

    A chunk holds parcels whose box starts in the same tile; a tile with many of them has several chunks of about ``size``.
    """
    box = edges.groupBy("parcel_id").agg(*[f(g(f"{v}1", f"{v}2")).alias(f"{name}_{v}") for v in "xy" for name, f, g in (("min", F.min, F.least), ("max", F.max, F.greatest))])
    home = box.withColumns({"hx": _tile(c("min_x")), "hy": _tile(c("min_y"))})
    crowd = home.groupBy("hx", "hy").agg(F.ceil(F.count("*") / size).alias("parts"))
    found = home.join(crowd, ["hx", "hy"]).withColumn("chunk", F.xxhash64("hx", "hy", F.pmod(F.xxhash64("parcel_id"), c("parts"))))
    return found.select("parcel_id", "chunk"), _tiled(found).select("chunk", "tx", "ty").distinct()


def meet_in_chunks(px: DataFrame, cells: DataFrame, edges: DataFrame, tasks: int, scale: float = 10.0) -> DataFrame:
    """Pixels beside the parcels' cells (parcel_id, row, col, ...), dealt by ``chunk``: groups by chunk and parcel need no further shuffle.

    A pixel is sent once to each chunk that has parcels near it, not once to each parcel. Both sides are dealt by the chunk alone,
    so the session's ``spark.sql.requireAllClusterKeysForCoPartition`` is set to false, as for stored tables.
    """
    px.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own, tiles = chunked(edges)
    at = lambda v: _tile(c(v) * scale + scale / 2)
    sent = px.withColumns({"tx": at("col"), "ty": at("row")}).join(tiles, ["tx", "ty"]).drop("tx", "ty").repartition(tasks, "chunk")
    dealt = cells.join(own, "parcel_id").repartition(tasks, "chunk")
    return sent.join(dealt.hint("shuffle_hash"), ["chunk", "row", "col"])


def locate(cells: DataFrame, edges: DataFrame, reach: float = 0.0, scale: float = 10.0) -> DataFrame:
    """(parcel_id, row, col, inside, dist) for cells whose centre is in a parcel's box, widened by ``reach``."""
    x, y = c("col") * scale + scale / 2, c("row") * scale + scale / 2
    points = cells.select("row", "col").distinct().withColumns({"x": x, "y": y, "tx": _tile(x), "ty": _tile(y)})
    return judged(points.join(binned(rings(edges, reach)), ["tx", "ty"]).where("x >= min_x AND x <= max_x AND y >= min_y AND y <= max_y"))


def clip(cells: DataFrame, edges: DataFrame, buffer: float = 100.0) -> DataFrame:
    """Cells in a parcel or within ``buffer`` metres of it."""
    found = locate(cells, edges, buffer).where(c("inside") | (c("dist") <= buffer))
    return cells.join(found.select("parcel_id", "row", "col"), ["row", "col"])


def areas(edges: DataFrame) -> DataFrame:
    """Shoelace area of each parcel in square metres."""
    return edges.groupBy("parcel_id").agg((F.abs(F.sum(c("x1") * c("y2") - c("x2") * c("y1"))) / 2).alias("area_m2"))


def _within(y: Column, margin: float) -> tuple[Column, Column]:
    """Where a line to the east at height ``y`` enters and leaves what is closer to the edge than ``margin``; nulls if it does not.

    That is a convex shape: two discs around the ends and the band between them, of which the band may be missed.
    """
    x1, y1, x2, y2 = (c(k) for k in ("x1", "y1", "x2", "y2"))
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    wide = margin * F.sqrt(square)
    disc = lambda px, py, sign: F.when(F.abs(y - py) < margin, px + sign * F.sqrt(margin * margin - (y - py) * (y - py)))
    # x between both ends' perpendiculars, and between both sides of the band; a level or upright edge bounds one of them by y alone
    ends = [F.when(dx != 0, x1 + (t - (y - y1) * dy) / dx) for t in (F.lit(0.0), square)]
    sides = [F.when(dy != 0, x1 + ((y - y1) * dx + w) / dy) for w in (-wide, wide)]
    low = F.greatest(F.least(*ends), F.least(*sides))
    high = F.least(F.greatest(*ends), F.greatest(*sides))
    beside = F.when(dx == 0, (y - y1) * dy < 0).otherwise(False) | F.when(dx == 0, (y - y1) * dy > square).otherwise(False) | F.when(dy == 0, F.abs(y - y1) >= margin).otherwise(False)
    met = ~beside & (low < high)
    enter = F.least(disc(x1, y1, -1), disc(x2, y2, -1), F.when(met, low))
    leave = F.greatest(disc(x1, y1, 1), disc(x2, y2, 1), F.when(met, high))
    return enter, leave


def eroded_areas(edges: DataFrame, margins: Mapping[str, float], step: float = 1.0) -> DataFrame:
    """Area of the cells of ``step`` metres whose centre lies inside, at least each margin from the boundary; (parcel_id, margins' names).

    Rows of cells are swept from the east. An edge meets those of its own height and the margin: where it crosses a row, inside and
    outside change, and within the margin it covers a run of cells. Running sums over these events tell which runs between
    them count, so cells are never listed: the cost is an edge's height, whatever the parcel's area. Rows of a parcel are
    shuffled on their own, so it is spread over many tasks, and sums are all that a task holds.
    """
    reach = max(margins.values())
    cell = lambda v: v / step - 0.5
    rows = F.sequence(F.floor(cell(F.least("y1", "y2") - reach)), F.ceil(cell(F.greatest("y1", "y2") + reach)))
    swept = edges.select("parcel_id", "x1", "y1", "x2", "y2", F.explode(rows).alias("j")).withColumn("y", (c("j") + 0.5) * step)
    crossed = (c("y1") > c("y")) != (c("y2") > c("y"))
    at = F.when(crossed, F.ceil(cell((c("x2") - c("x1")) * (c("y") - c("y1")) / (c("y2") - c("y1")) + c("x1"))))
    spans = {name: _within(c("y"), m) for name, m in margins.items()}
    runs = {f"{side}_{name}": f for name, (enter, leave) in spans.items() for side, f in (("from", F.floor(cell(enter)) + 1), ("to", F.ceil(cell(leave))))}
    event = lambda x, odd, sign, own: F.struct(x.alias("at"), F.lit(odd).alias("odd"), *[F.lit(sign if name == own else 0).alias(name) for name in margins])
    run = lambda name, side, sign: event(F.when(c(f"from_{name}") < c(f"to_{name}"), c(f"{side}_{name}")), 0, sign, name)
    events = F.array(event(c("crossing"), 1, 0, None), *[run(name, side, sign) for name in margins for side, sign in (("to", 1), ("from", -1))])
    found = swept.withColumns({"crossing": at, **runs}).select("parcel_id", "j", F.inline(events)).where("at IS NOT NULL")
    west = Window.partitionBy("parcel_id", "j").orderBy(F.desc("at"))
    so_far = west.rowsBetween(Window.unboundedPreceding, 0)
    width = F.coalesce(c("at") - F.lead("at").over(west), F.lit(0))
    sums = found.select("parcel_id", width.alias("width"), (F.sum("odd").over(so_far) % 2 == 1).alias("inside"), *[F.sum(name).over(so_far).alias(name) for name in margins])
    return sums.groupBy("parcel_id").agg(*[(F.sum(F.when(c("inside") & (c(name) == 0), c("width")).otherwise(0)) * step * step).alias(name) for name in margins])


def adaptive_core(edges: DataFrame, pixel_area: float = 100.0, core_min: float = 2500.0, small_pixels: float = 60.0, step: float = 1.0) -> DataFrame:
    """Erosion of each parcel: 10 m if that leaves ``core_min``, else 5 m if that does, else none.

    Eroded areas are those of cells of ``step`` metres (``eroded_areas``). A parcel is small below ``small_pixels`` pixels.
    """
    eroded = eroded_areas(edges, {"area_10m": 10.0, "area_5m": 5.0}, step)
    return areas(edges).join(eroded, "parcel_id").select(
        "parcel_id", "area_m2", "area_10m", "area_5m",
        F.when(c("area_10m") >= core_min, 10).when(c("area_5m") >= core_min, 5).otherwise(0).alias("erosion_m"),
        (c("area_m2") / pixel_area < small_pixels).cast("int").alias("is_small_parcel"),
    )


def core_area() -> Column:
    """Area of a parcel after the erosion that it gets."""
    return F.when(c("erosion_m") == 10, c("area_10m")).when(c("erosion_m") == 5, c("area_5m")).otherwise(c("area_m2"))


def core_cells(edges: DataFrame, core: DataFrame, scale: float = 10.0) -> DataFrame:
    """Cells in each parcel's eroded core: (row, col) beside the columns of ``core``. Made from the parcels alone, no pixel is read."""
    tiles = binned(rings(edges))
    # cells whose centre is in the tile, of those that the parcel's box touches
    line = lambda t, lo, hi: F.sequence(F.floor(F.greatest(c(t) * TILE, c(lo)) / scale).cast("int") - 1, F.floor(F.least((c(t) + 1) * TILE, c(hi)) / scale).cast("int") + 1)
    own = lambda v, t, lo, hi: (_tile((v + 0.5) * scale) == c(t)) & (v >= F.floor(c(lo) / scale)) & (v <= F.ceil(c(hi) / scale))
    cells = tiles.withColumn("row", F.explode(F.filter(line("ty", "min_y", "max_y"), lambda v: own(v, "ty", "min_y", "max_y"))))
    cells = cells.withColumn("col", F.explode(F.filter(line("tx", "min_x", "max_x"), lambda v: own(v, "tx", "min_x", "max_x"))))
    found = judged(cells.withColumns({"x": (c("col") + 0.5) * scale, "y": (c("row") + 0.5) * scale})).where("inside")
    return found.join(core, "parcel_id").where((c("erosion_m") == 0) | (c("dist") >= c("erosion_m"))).drop("inside", "dist")


def edges_of_geojson(parcels: DataFrame, text: str = "geojson") -> DataFrame:
    """Edge table of polygons given as GeoJSON text (parcel_id, text), in the text's own units; rings are closed, edges of no length left out."""
    from vinegrid.schema import GEOJSON

    ring = F.from_json(c(text), GEOJSON)["coordinates"][0]
    points = parcels.select("parcel_id", F.posexplode(ring).alias("edge_id", "p")).select("parcel_id", "edge_id", c("p")[0].alias("x1"), c("p")[1].alias("y1"))
    w = Window.partitionBy("parcel_id").orderBy("edge_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda x: F.coalesce(F.lead(x).over(w), F.first(x).over(whole))
    return points.withColumns({"x2": nxt("x1"), "y2": nxt("y1")}).where("x1 <> x2 OR y1 <> y2")
