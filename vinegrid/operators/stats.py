"""Aggregations: parcel statistics, quality flags, phase features, meteorology."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinegrid.config import DEFAULTS, Params
from vinegrid.functions import indices as ix

c = F.col


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys, of which nulls match each other."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    test = reduce(lambda a, b: a & b, [c(k).eqNullSafe(c(f"_r_{k}")) for k in keys])
    return left.join(named, test, how).drop(*[f"_r_{k}" for k in keys])


def _value_range(value: str) -> Column:
    """Number of the range that a value lies in, rising with the value: equal steps of its logarithm, 256 to a factor of e, NaN last."""
    steps = F.floor(F.least(F.log1p(F.abs(c(value)) * 1048576.0), F.lit(1000.0)) * 256)
    return F.when(F.isnan(value), F.lit(1 << 40)).otherwise(F.signum(value).cast("long") * steps).cast("long")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """(keys, p array, n): exact quantiles of each group, interpolated as ``percentile`` does; groups without a value are left out.

    Distributed selection: equal values are counted, counts per range of values give the ranges that hold the wanted ranks, and
    only in these are values put in order. So no task holds a group's values: a group's ranges are a few thousand rows at most,
    and a window sorts the different values of one range, which spills.
    """
    counted = df.where(c(value).isNotNull()).groupBy(*keys, (c(value).cast("double") + 0.0).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_b", _value_range("_v"))
    group, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_b")
    ranges = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    ranges = ranges.select(*keys, "_b", "_n", (F.sum("_n").over(order) - c("_n")).alias("_before"), F.sum("_n").over(group).alias("_total"))
    place = lambda p: F.lit(float(p)) * (c("_total") - 1)
    ranks = F.array_distinct(F.array(*[f(place(p)).cast("long") for p in probabilities for f in (F.floor, F.ceil)]))
    wanted = F.filter(ranks, lambda r: (r >= c("_before")) & (r < c("_before") + c("_n")))
    holding = ranges.withColumn("_wanted", wanted).where(F.size("_wanted") > 0).select(*keys, "_b", "_before", "_total", "_wanted")
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    ordered = _same(counted, holding, [*keys, "_b"]).withColumn("_upto", c("_before") + F.sum("_n").over(inside))
    met = F.filter("_wanted", lambda r: (r >= c("_upto") - c("_n")) & (r < c("_upto")))
    found = ordered.select(*keys, "_total", "_v", F.explode(met).alias("_rank"))
    at = lambda p, f: F.max(F.when(c("_rank") == f(place(p)).cast("long"), c("_v")))
    ends = [x for k, p in enumerate(probabilities) for x in (at(p, F.floor).alias(f"_lo{k}"), at(p, F.ceil).alias(f"_hi{k}"))]
    rows = found.groupBy(*keys, "_total").agg(*ends)
    between = lambda k, p: F.when(c(f"_lo{k}") == c(f"_hi{k}"), c(f"_lo{k}")).otherwise((F.ceil(place(p)) - place(p)) * c(f"_lo{k}") + (place(p) - F.floor(place(p))) * c(f"_hi{k}"))
    return rows.select(*keys, F.array(*[between(k, p) for k, p in enumerate(probabilities)]).alias("p"), c("_total").alias("n"))


def quantile_of(ordered: Column, n: Column, p: float) -> Column:
    """Quantile of an ordered array of n values, interpolated as by ``quantiles``; null if it is empty."""
    place = (n - 1) * F.lit(float(p))
    low, high = (F.get(ordered, f(place).cast("int")) for f in (F.floor, F.ceil))
    return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)


PERCENTILES = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}


def band_stats(pixels: DataFrame, keys: Sequence[str], bands: Sequence[str], approximate: bool = False, sample_deviation: bool = False, small: bool = False, also: Mapping[str, Column] | None = None) -> DataFrame:
    """Median, quartiles, deciles, count and deviation of each band per group, one row per group and band.

    Exact percentiles are found by distributed selection (``quantiles``), ``approximate`` ones in one pass. ``small``: a task may
    hold a group, so that its bands are put in order in one aggregation, a row a group; ``also`` names further aggregates of it.
    """
    if small:
        deviation = F.stddev_samp if sample_deviation else F.stddev_pop
        values = lambda b: c(b).cast("double") + 0.0
        measures = [x for b in bands for x in (F.sort_array(F.collect_list(values(b))).alias(f"_v_{b}"), deviation(values(b)).alias(f"_s_{b}"))]
        rows = pixels.groupBy(*keys).agg(*measures, *[x.alias(k) for k, x in (also or {}).items()])
        each = F.inline(F.array(*[F.struct(F.lit(b).alias("band"), c(f"_v_{b}").alias("_v"), c(f"_s_{b}").alias("stddev")) for b in bands]))
        out = rows.select(*keys, *(also or {}), each).withColumn("n", F.size("_v").cast("long"))
        return out.select(*keys, "band", *[quantile_of(c("_v"), c("n"), p).alias(name) for name, p in PERCENTILES.items()], "n", "stddev", *(also or {}))
    long = pixels.select(*keys, *[c(b).cast("double").alias(b) for b in bands]).unpivot(list(keys), list(bands), "band", "value")
    grouped = [*keys, "band"]
    deviation = (F.stddev_samp if sample_deviation else F.stddev_pop)("value").alias("stddev")
    named = [F.get("p", i).alias(name) for i, name in enumerate(PERCENTILES)]
    if approximate:
        out = long.groupBy(*grouped).agg(F.percentile_approx("value", list(PERCENTILES.values())).alias("p"), F.count("value").alias("n"), deviation)
        return out.select(*grouped, *named, "n", "stddev")
    spread = long.groupBy(*grouped).agg(F.count("value").alias("n"), deviation)
    found = quantiles(long, grouped, "value", list(PERCENTILES.values())).drop("n")
    return _same(spread, found, grouped, "left").select(*grouped, *named, "n", "stddev")


def coverage(pixels: DataFrame, keys: Sequence[str], total: str = "total_pixels", first_band: str = "b4") -> DataFrame:
    """valid_pixels and coverage_ratio per group, whose keys hold ``total``, the pixels of its parcel's core; masked pixels are null in the first band."""
    return pixels.groupBy(*keys).agg(F.count(first_band).alias("valid_pixels")).withColumn("coverage_ratio", F.try_divide("valid_pixels", c(total)))


def validate(stats: DataFrame, small: str = "is_small_parcel", params: Params = DEFAULTS) -> DataFrame:
    valid = ix.qa_valid(c("valid_pixels"), c("total_pixels"), c("coverage_ratio"), c(small) == 1, params)
    return stats.withColumn("observation_valid", valid.cast("int"))


def iqr_filter(df: DataFrame, keys: Sequence[str], value: str, fence: float = 1.5) -> DataFrame:
    """Rows within the Tukey fences of their group."""
    q = quantiles(df, keys, value, [0.25, 0.75]).select(*keys, c("p").alias("_q"))
    width = (F.get("_q", 1) - F.get("_q", 0)) * fence
    return _same(df, q, keys).where(c(value).between(F.get("_q", 0) - width, F.get("_q", 1) + width)).drop("_q")


def peak_mosaic(pixels: DataFrame, bands: Sequence[str], by: str = "ndvi") -> DataFrame:
    """Per cell, all bands of the scene with the greatest ``by``; ties go to the later scene id."""
    best = F.max_by(F.struct("scene_id", *bands), F.struct(by, "scene_id"))
    return pixels.where(c(by).isNotNull()).groupBy("row", "col").agg(best.alias("b")).select("row", "col", "b.*")


def linear_fit(pixels: DataFrame, value: str = "ndvi", t: str = "t") -> DataFrame:
    """Slope of the value on time per cell and phase, phases side by side."""
    return pixels.groupBy("row", "col").agg(
        F.regr_slope(F.when(c("phase") == "T1", c(value)), F.when(c("phase") == "T1", c(t))).alias("Green_Up"),
        F.regr_slope(F.when(c("phase") == "T2", c(value)), F.when(c("phase") == "T2", c(t))).alias("Senescence"),
    )


def phase_means(pixels: DataFrame, value: str, early: str, late: str, drop: str) -> DataFrame:
    """Mean of the value per cell in T1 and T2, and T2 - T1."""
    out = pixels.groupBy("row", "col").agg(F.avg(F.when(c("phase") == "T1", c(value))).alias(early), F.avg(F.when(c("phase") == "T2", c(value))).alias(late))
    return out.withColumn(drop, c(late) - c(early))


def weekly(df: DataFrame, keys: Sequence[str], day: str, value: str, width: str = "7 days") -> DataFrame:
    w = F.window(c(day).cast("timestamp"), width)
    return df.groupBy(*keys, w.alias("w")).agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(*keys, F.to_date("w.start").alias("week"), "mean", "n")


def anomaly(df: DataFrame, keys: Sequence[str], order: str, value: str, before: int = 6) -> DataFrame:
    """z-score against the ``before`` rows that come before."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, -1)
    return df.withColumn("z", F.try_divide(c(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)))


def year_on_year(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Change against the same key a year earlier; df has a column ``year``."""
    last = df.select(*keys, (c("year") + 1).alias("year"), c(value).alias("last_year"))
    return df.join(last, [*keys, "year"]).withColumn("change", c(value) - c("last_year"))


def period_start(day: str, every: str | int = "week") -> Column:
    """First day of the calendar period that a day is in: "week" (from Monday), "month", "quarter", "year", or a number of days.

    Periods of n days are counted from Monday, 1970-01-05, before it, too. A null day has a null period.
    """
    if isinstance(every, str):
        return F.to_date(F.date_trunc(every, c(day)))
    monday = F.lit("1970-01-05").cast("date")
    return F.date_add(monday, (F.floor(F.datediff(c(day), monday) / every) * every).cast("int"))


def period_stats(pixels: DataFrame, bands: Sequence[str], keys: Sequence[str] = ("parcel_id",), day: str = "date", every: str | int = "week", small: bool = False) -> DataFrame:
    """Statistics of all pixels of each group and calendar period, a row per band, with the days observed and the first and last of them.

    Columns: keys, period, band, the percentiles, n, stddev, days, first_day, last_day. Periods without a row are left out.
    ``small``: as in ``band_stats``.
    """
    named = pixels.select(*keys, c(day), period_start(day, every).alias("period"), *bands)
    if small:
        days = {"days": F.size(F.collect_set(day)).cast("long"), "first_day": F.min(day), "last_day": F.max(day)}
        return band_stats(named, [*keys, "period"], bands, small=True, also=days)
    seen = named.groupBy(*keys, "period").agg(F.countDistinct(day).alias("days"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return _same(band_stats(named, [*keys, "period"], bands), seen, [*keys, "period"])


def calendar_anomaly(df: DataFrame, keys: Sequence[str], day: str, value: str, days: int = 42, least: int = 3) -> DataFrame:
    """z-score against the group's values of the ``days`` days before a row's own day, however many observations these hold.

    Adds n_before, mean_before and z; z is null where fewer than ``least`` values lie in the frame or they don't vary. Rows of one
    day don't count for each other. A null day has no frame: all three are null, n_before 0.
    """
    at = F.datediff(c(day), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(*keys).orderBy("_at").rangeBetween(-days, -1)
    dated = c("_at").isNotNull()
    framed = df.withColumn("_at", at).withColumns({"n_before": F.when(dated, F.count(value).over(w)).otherwise(0), "mean_before": F.when(dated, F.avg(value).over(w)), "_dev": F.when(dated, F.stddev_pop(value).over(w))})
    z = F.when((c("n_before") >= least) & (c("_dev") > 0), (c(value) - c("mean_before")) / c("_dev"))
    return framed.withColumn("z", z).drop("_at", "_dev")


def iso_monday(year: Column, week: Column) -> Column:
    """Monday of a week of an ISO year; a 53rd week that the year doesn't have is its last."""
    last = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
    first = F.to_date(F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))))
    return F.date_add(first, ((F.least(week, last) - 1) * 7).cast("int"))


def week_on_years(weeks: DataFrame, keys: Sequence[str], value: str, years: Sequence[int] = (1,), slack: int = 1, week: str = "week") -> DataFrame:
    """Each week beside the same ISO week of earlier years; one row per group, week and year gone back that has a counterpart.

    ``weeks``: keys, Monday of the week, value; one row per group and week. Where that week has no value, the nearest one up to
    ``slack`` weeks away stands in for it, the earlier of two; ``weeks_off`` says by how many. Leap years and years of 53 weeks
    shift no season, since weeks are found by their number. Joins are on equal keys, 2 * slack + 1 candidates a row; null keys
    have no counterpart.
    """
    mine = weeks.where(c(value).isNotNull() & c(week).isNotNull())
    number = F.weekofyear(week)
    back = F.explode(F.array(*[F.lit(y) for y in years]))
    asked = mine.withColumn("years_back", back).withColumn("_same", iso_monday(F.year(F.date_add(c(week), 3)) - c("years_back"), number))
    asked = asked.withColumn("weeks_off", F.explode(F.sequence(F.lit(-slack), F.lit(slack)))).withColumn("_then", F.date_add("_same", c("weeks_off") * 7))
    other = mine.select(*keys, c(week).alias("_then"), c(value).alias("_value"))
    met = asked.join(other, [*keys, "_then"])
    nearest = F.min_by(F.struct(c("_then").alias("then_week"), c("_value").alias("then"), "weeks_off"), F.struct(F.abs("weeks_off"), "weeks_off"))
    best = met.groupBy(*keys, week, "years_back").agg(F.first(value).alias(value), nearest.alias("_b"))
    return best.select(*keys, week, "years_back", value, "_b.then_week", "_b.then", "_b.weeks_off").withColumn("change", c(value) - c("then"))


def daily_meteo(hourly: DataFrame) -> DataFrame:
    """Daily temperatures, water sums, WDI and growing degree days per cell."""
    return hourly.withColumns(ix.era5_columns()).groupBy("cell_id", F.to_date("ts").alias("date")).agg(
        F.min("temp_c").alias("MIN_TEMP_C"), F.avg("temp_c").alias("MEAN_TEMP_C"), F.max("temp_c").alias("MAX_TEMP_C"),
        F.sum("precip").alias("RAIN_TOTAL"), F.sum("pet").alias("PET_TOTAL"), F.sum("aet").alias("AET_TOTAL"), F.sum("gdd").alias("GDD"),
    ).withColumn("WDI", c("PET_TOTAL") - c("RAIN_TOTAL"))


def day_spine(hourly: DataFrame, daily: DataFrame, drop_empty: bool = False) -> DataFrame:
    """A row per cell and day of the cell's range, null where a day has no hours."""
    if drop_empty:
        return daily
    span = hourly.groupBy("cell_id").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    days = span.select("cell_id", F.explode(F.sequence("a", "b")).alias("date"))
    return days.join(daily, ["cell_id", "date"], "left")


def degree_days(daily: DataFrame) -> DataFrame:
    """Daily and running seasonal growing degree days."""
    w = Window.partitionBy("cell_id", F.year("date")).orderBy("date")
    return daily.select("cell_id", "date", "GDD", F.sum("GDD").over(w).alias("GDD_season"))
