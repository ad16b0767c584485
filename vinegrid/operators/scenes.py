"""Scene filters: predicates on the scene table that Parquet can push down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def in_bounds(min_x: float, max_x: float, min_y: float, max_y: float) -> Column:
    return (c("min_x") <= max_x) & (c("max_x") >= min_x) & (c("min_y") <= max_y) & (c("max_y") >= min_y)


def in_dates(start: str, end: str) -> Column:
    """Start inclusive, end exclusive."""
    return (c("acquired_at") >= F.lit(start).cast("timestamp_ntz")) & (c("acquired_at") < F.lit(end).cast("timestamp_ntz"))


def in_season(ts: str = "acquired_at", months: tuple[int, int] = (4, 9)) -> Column:
    return F.month(ts).between(*months)


def in_hours(ts: str = "acquired_at", hours: tuple[int, int] = (9, 15)) -> Column:
    return F.hour(ts).between(*hours)


def has_polarisations(wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), "polarisations")) == 0


def retrieve(scenes: DataFrame, sensors: Sequence[str], start: str | None = None, end: str | None = None, cloud_max: float | None = None,
             polarisations: Sequence[str] = (), mode: str | None = None, orbit: str | None = None) -> DataFrame:
    """Scenes of the sensors that pass all filters given."""
    tests: list[Column] = [c("sensor").isin(*sensors)]
    if start and end:
        tests.append(in_dates(start, end))
    if cloud_max is not None:
        tests.append(c("cloud_pct") < cloud_max)
    if polarisations:
        tests.append(has_polarisations(polarisations))
    if mode:
        tests.append(c("instrument_mode") == mode)
    if orbit:
        tests.append(c("orbit_pass") == orbit)
    for test in tests:
        scenes = scenes.where(test)
    return scenes


def landsat_scenes(scenes: DataFrame, cloud_max: float = 80.0) -> DataFrame:
    """Landsat 9, then 8; duplicates are kept."""
    return retrieve(scenes, ["L9"], cloud_max=cloud_max).unionByName(retrieve(scenes, ["L8"], cloud_max=cloud_max))


def in_phase(df: DataFrame, phases: DataFrame, day: str = "date") -> DataFrame:
    """Rows within a phase, with its name; phases (phase, start, end) are a handful of rows."""
    return df.join(F.broadcast(phases), c(day).between(c("start"), c("end")))


def rejects(df: DataFrame, bands: Sequence[str], low: float, high: float) -> tuple[DataFrame, DataFrame]:
    """Sound rows, and rows with a null, NaN or out-of-range band."""
    sound = F.lit(True)
    for band in bands:
        sound = sound & F.coalesce(c(band).between(low, high) & ~F.isnan(c(band).cast("double")), F.lit(False))
    return df.where(sound), df.where(~sound)
