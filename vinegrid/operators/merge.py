"""Combining tables: bands side by side, grids of other resolutions, sources merged by date and place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
CELL = ["scene_id", "row", "col"]


def combine(px_s2: DataFrame, px_cs: DataFrame, px_cld: DataFrame) -> DataFrame:
    """Inner join of the image and both cloud products; all three shuffle on the same key.

    Stored tables (sources.pixels) are joined by day and tile, too, within their buckets, so that nothing is shuffled.
    """
    stored = all({"acquired_date", "tile"} <= set(df.columns) for df in (px_s2, px_cs, px_cld))
    keys = ["acquired_date", "tile", *CELL] if stored else CELL
    return px_s2.join(px_cs, keys).join(px_cld, keys)


def coarse_key(fine: str, fine_m: float, coarse_m: float) -> Column:
    """Index of the coarse cell that holds the centre of a fine one."""
    return F.floor((c(fine) + 0.5) * fine_m / coarse_m).cast("int")


def align_nearest(fine: DataFrame, coarse: DataFrame, coarse_m: float, keys: Sequence[str] = (), fine_m: float = 10.0) -> DataFrame:
    """Fine cells with the values of the coarse cell around them."""
    named = coarse.withColumnsRenamed({"row": "crow", "col": "ccol"})
    return fine.withColumns({"crow": coarse_key("row", fine_m, coarse_m), "ccol": coarse_key("col", fine_m, coarse_m)}).join(named, [*keys, "crow", "ccol"]).drop("crow", "ccol")


def cubic_weight(d: Column, a: float = -0.5) -> Column:
    """Cubic-convolution kernel."""
    d = F.abs(d)
    near = (a + 2) * d * d * d - (a + 3) * d * d + 1
    far = a * d * d * d - 5 * a * d * d + 8 * a * d - 4 * a
    return F.when(d <= 1, near).when(d < 2, far).otherwise(0.0)


def align_bicubic(fine: DataFrame, coarse: DataFrame, value: str, factor: int = 2) -> DataFrame:
    """Coarse values at the centres of fine cells, from 4 x 4 neighbours; weights of missing ones go to those present."""
    at = lambda x: (c(x) + 0.5) / factor - 0.5
    steps = F.sequence(F.lit(-1), F.lit(2))
    wanted = (
        fine.select("row", "col", at("row").alias("y"), at("col").alias("x"))
        .withColumn("crow", F.explode(F.transform(steps, lambda k: (F.floor("y") + k).cast("int"))))
        .withColumn("ccol", F.explode(F.transform(steps, lambda k: (F.floor("x") + k).cast("int"))))
        .withColumn("w", cubic_weight(c("y") - c("crow")) * cubic_weight(c("x") - c("ccol")))
    )
    joined = wanted.join(coarse.select(c("row").alias("crow"), c("col").alias("ccol"), value), ["crow", "ccol"])
    return joined.groupBy("row", "col").agg(F.try_divide(F.sum(c("w") * c(value)), F.sum("w")).alias(value))


def prefixed(sources: Mapping[str, DataFrame], on: Sequence[str]) -> dict[str, DataFrame]:
    """Value columns that two sources share get the source's name in front."""
    seen: dict[str, int] = {}
    for df in sources.values():
        for x in df.columns:
            seen[x] = seen.get(x, 0) + 1
    return {name: df.withColumnsRenamed({x: f"{name}_{x}" for x in df.columns if x not in on and seen[x] > 1}) for name, df in sources.items()}


def outer_merge(sources: Mapping[str, DataFrame], on: Sequence[str] = ("date", "geo"), carry: Sequence[str] = ()) -> DataFrame:
    """Full outer join of all sources in the order of their names; null keys match each other.

    ``carry``: columns that go along with the key but aren't part of it, as ``geo`` does with (date, row, col); the first source
    that has one gives it. Sources with several rows per key multiply, as in a relational join; aggregate them first if that is
    not wanted.
    """
    ready = prefixed(dict(sorted(sources.items())), [*on, *carry])

    def join(left: DataFrame, right: DataFrame) -> DataFrame:
        shared = [*on, *(x for x in carry if x in left.columns and x in right.columns)]
        renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in shared})
        test = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_r_{k}")) for k in on])
        joined = left.join(renamed, test, "full")
        return joined.withColumns({k: F.coalesce(c(k), c(f"_r_{k}")) for k in shared}).drop(*[f"_r_{k}" for k in shared])

    return reduce(join, ready.values())


def with_year_month(df: DataFrame, day: str = "date") -> DataFrame:
    return df.withColumns({"year": F.year(day), "month": F.month(day)})


def missing_months(spark, present: DataFrame, start: str, end: str, as_of: str) -> DataFrame:
    """Months from start to end, up to ``as_of``, that are not among (year, month)."""
    span = spark.range(1).select(F.explode(F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.lit(end).cast("date"), F.expr("interval 1 month"))).alias("month_start"))
    wanted = span.where(c("month_start") <= F.lit(as_of).cast("date")).select("month_start", F.year("month_start").alias("year"), F.month("month_start").alias("month"))
    return wanted.join(present.select("year", "month").distinct(), ["year", "month"], "left_anti").select("month_start", "year", "month")
