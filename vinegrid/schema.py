"""Schemas of the exports and of the run metadata."""

from __future__ import annotations

from pyspark.sql import types as T


#: Value columns of each source's export, in order, after ``date`` and before ``.geo``.
EXPORT_COLUMNS = {
    "sentinel_1": ("VV", "VH", "RATIOVHVV"),
    "sentinel_2": ("NDVI", "EVI", "GNDVI", "IRECI", "NDMI", "NDRE", "valid_pixels", "total_pixels", "coverage_ratio", "observation_valid", "erosion_m", "is_small_parcel"),
    "landsat_thermal": ("LST",),
    "ecostress": ("LST_eco",),
    "era5": ("MIN_TEMP_C", "MEAN_TEMP_C", "MAX_TEMP_C", "RAIN_TOTAL", "PET_TOTAL", "AET_TOTAL", "WDI"),
}
STATIC_COLUMNS = {"srtm": ("elevation", "slope", "aspect")}
_WHOLE = {"valid_pixels": T.LongType(), "observation_valid": T.IntegerType(), "erosion_m": T.IntegerType(), "is_small_parcel": T.IntegerType()}


def export_schema(source: str) -> T.StructType:
    """date (not for static sources), value columns, .geo."""
    values = EXPORT_COLUMNS.get(source) or STATIC_COLUMNS[source]
    dated = [T.StructField("date", T.DateType())] if source in EXPORT_COLUMNS else []
    return T.StructType([*dated, *(T.StructField(c, _WHOLE.get(c, T.DoubleType())) for c in values), T.StructField(".geo", T.StringType())])


METADATA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("created_at", T.StringType()), T.StructField("status", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("provider", T.StringType()), T.StructField("image_count", T.LongType()),
    T.StructField("date_range", T.StringType()), T.StructField("bands_description", T.ArrayType(T.StringType())),
    T.StructField("roi_coords", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))),
])

GEOJSON = T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])
