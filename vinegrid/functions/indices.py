"""Spectral, radar and terrain formulas as column expressions; a zero denominator gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vinegrid.config import DEFAULTS, Params

c = F.col


def rounded(x: Column, digits: int = 6) -> Column:
    """A double to so many decimals as C and SQL engines on it do: scaled, to the nearest whole number, halves away from zero.

    Spark's own ``round`` rounds the decimal text of the double, so 0.2417845 goes up even where the scaled double is below the half.
    """
    scaled = x * F.lit(10.0**digits)
    whole = F.when(F.abs(scaled - F.rint(scaled)) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(F.rint(scaled))
    return F.when(F.abs(scaled) < 1e300, whole / F.lit(10.0**digits)).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def normalised_difference(a: str, b: str) -> Column:
    return ratio(c(a) - c(b), c(a) + c(b))


def ndvi() -> Column:
    return normalised_difference("b8", "b4")


def evi(scale: float = 10000.0) -> Column:
    n, r, b = (c(x) / scale for x in ("b8", "b4", "b2"))
    return ratio(F.lit(2.5) * (n - r), n + 6 * r - F.lit(7.5) * b + 1)


def gndvi() -> Column:
    return normalised_difference("b8", "b3")


def ireci(profile: str = "intended") -> Column:
    if profile == "as_written":
        return ratio(c("b5") - c("b4"), ratio(c("b11"), c("b11")))
    return ratio(c("b7") - c("b4"), ratio(c("b5"), c("b6")))


def ndmi() -> Column:
    return normalised_difference("b8", "b11")


def mndwi() -> Column:
    return normalised_difference("b3", "b11")


def ndre(profile: str = "intended") -> Column:
    return mndwi() if profile == "as_written" else normalised_difference("b8", "b5")


def cirededge(profile: str = "intended") -> Column:
    return ratio(c("b5"), c("b11")) - 1 if profile == "as_written" else ratio(c("b7"), c("b5")) - 1


def ratio_vh_vv(db: bool = False) -> Column:
    """Quotient, or the difference if the bands are in decibels."""
    return c("vh") - c("vv") if db else ratio(c("vh"), c("vv"))


def s2_indices(profile: str = "intended") -> dict[str, Column]:
    named: dict[str, Column] = {"NDVI": ndvi(), "EVI": evi(), "GNDVI": gndvi(), "IRECI": ireci(profile), "NDMI": ndmi(), "NDRE": ndre(profile)}
    return named if profile == "as_written" else named | {"MNDWI": mndwi()}


def add_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``withColumns`` that refuses to replace a column of the same name, whatever its case."""
    taken = {x.lower() for x in df.columns} & {x.lower() for x in columns}
    if taken:
        raise ValueError(f"columns already there: {sorted(taken)}")
    return df.withColumns(columns)


# conversions

KELVIN = 273.15


def lst_landsat(band: str = "st_b10") -> Column:
    return c(band) * F.lit(0.00341802) + F.lit(149.0) - F.lit(KELVIN)


def lst_ecostress(band: str = "lst") -> Column:
    return c(band) * F.lit(0.02) - F.lit(KELVIN)


_CELSIUS: dict[str, Callable[[], Column]] = {"landsat": lst_landsat, "eco": lst_ecostress}


def to_celsius(module: str) -> Column:
    if module not in _CELSIUS:
        raise ValueError(f"no conversion for {module!r}")
    return _CELSIUS[module]()


def wind_2m() -> Column:
    return F.hypot("u_component_of_wind_10m", "v_component_of_wind_10m") * F.lit(0.748)


def growing_degree_hour(base_k: float = 283.15) -> Column:
    return F.greatest(c("temperature_2m") - F.lit(base_k), F.lit(0.0)) / 24


def era5_columns() -> dict[str, Column]:
    return {
        "temp_c": c("temperature_2m") - F.lit(KELVIN), "dew_c": c("dewpoint_temperature_2m") - F.lit(KELVIN),
        "precip": c("total_precipitation_hourly"), "pet": c("potential_evaporation"), "aet": c("evaporation_from_vegetation_transpiration"),
        "rad": F.greatest(c("surface_net_solar_radiation"), F.lit(0.0)), "wind2m": wind_2m(), "gdd": growing_degree_hour(),
    }


def days_since(ts: Column, start: Column) -> Column:
    """Fractional days."""
    return (F.unix_millis(ts) - F.unix_millis(start)) / F.lit(86400000.0)


def geo_point(x: Column, y: Column) -> Column:
    """GeoJSON point text."""
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")))


# masks: true is clear


def clear_cloudscore(cs_min: float = DEFAULTS.cs_min, cdf_min: float = DEFAULTS.cs_cdf_min) -> Column:
    return (c("cs") >= cs_min) & (c("cs_cdf") >= cdf_min)


def clear_probability(most: float = DEFAULTS.cloud_probability_max) -> Column:
    return c("probability") <= most


def clear_scl(classes: tuple[int, ...] = DEFAULTS.clear_classes) -> Column:
    return c("scl").isin(*classes)


def clear_ensemble(params: Params = DEFAULTS) -> Column:
    """All three say clear; a null leaves the pixel masked but seeds no dilation."""
    return clear_cloudscore(params.cs_min, params.cs_cdf_min) & clear_probability(params.cloud_probability_max) & clear_scl(params.clear_classes)


def bits_unset(band: str, *bits: int) -> Column:
    out = F.lit(True)
    for bit in bits:
        out = out & (c(band).bitwiseAND(1 << bit) == 0)
    return out


def dark(params: Params = DEFAULTS) -> Column:
    """Shadow candidates: near infrared below a limit and no water."""
    return (c("b8") / 10000 < params.dark_nir) & (c("scl") != 6)


def qa_valid(count: Column, total: Column, coverage: Column, small: Column, params: Params = DEFAULTS) -> Column:
    """A parcel's observation counts if enough pixels, by number and share, are clear."""
    needed = F.greatest(F.when(small, float(params.min_pixels_small)).otherwise(float(params.min_pixels)), total * params.min_share)
    return (count >= needed) & (coverage >= F.when(small, params.min_coverage_small).otherwise(params.min_coverage))
