"""CSV trees, GeoJSON parcels, partition listing, and the sinks that write them."""

from __future__ import annotations

import csv
import re
import tempfile
import uuid
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vinegrid.config import DEFAULT_RING
from vinegrid.operators.merge import with_year_month
from vinegrid.schema import EXPORT_COLUMNS, GEOJSON, STATIC_COLUMNS, export_schema

c = F.col
#: Names of CSV files, plain or compressed.
CSV = "*.{csv,csv.gz}"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all nodes see; where it is unset, a local one for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        base = f"file://{tempfile.gettempdir()}/vinegrid-{spark.sparkContext.applicationId}"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def folder_of_file() -> Column:
    """Name of the folder that holds a row's file; cut by its slashes, as a pattern is tried at every letter of the path, row by row."""
    return F.substring_index(F.substring_index(c("_metadata.file_path"), "/", -2), "/", 1)


def parent_folder() -> Column:
    """Name of the source's folder that holds the file, with or without a folder for the month."""
    return F.regexp_extract(c("_metadata.file_path"), "([^/]+)/(?:month=[^/]*/)?[^/]+$", 1)


def _status(spark: SparkSession, pattern: str):
    """File statuses of a path with wildcards, none if there is nothing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []


def exists(spark: SparkSession, pattern: str) -> bool:
    return len(_status(spark, pattern)) > 0


def source_folders(spark: SparkSession, base: str, roi: str = "*") -> list[str]:
    """Names of all source folders under ``base/<roi>``."""
    return sorted({x.getPath().getName() for x in _status(spark, f"{base}/{roi}/*") if x.isDirectory() and not x.getPath().getParent().getName().startswith("_")})


def read_sources(spark: SparkSession, base: str, roi: str = "*", months: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Time series of the CSV tree ``base/<roi>/<source>/**.csv``, by source, of whatever name; rows that don't parse are dropped.

    ``months`` ("2025-06" and so on): only files that can hold rows of these months are opened. Files whose header has no ``date``
    are static and left out, as are those without ``.geo``, which becomes ``geo``.
    """
    found = {source: read_csv(spark, month_paths(spark, f"{base}/{roi}/{source}", months), source, headers=f"{base}/{HEADERS}") for source in source_folders(spark, base, roi)}
    return {k: v for k, v in found.items() if v is not None}


def read_static(spark: SparkSession, base: str, roi: str = "*") -> dict[str, DataFrame]:
    """The tree's files without a date, by source."""
    found = {source: read_csv(spark, f"{base}/{roi}/{source}", source, static=True, headers=f"{base}/{HEADERS}") for source in source_folders(spark, base, roi)}
    return {k: v for k, v in found.items() if v is not None}


#: Folder, within a tree, of the headers of files that ``write_csv`` wrote.
HEADERS = "_headers"
_RANGE = re.compile(r"(\d{4}-\d{2})-\d{2}_(\d{4}-\d{2})-\d{2}\.csv(?:\.gz)?$")


def month_paths(spark: SparkSession, folder: str, months: Sequence[str] | None) -> str | list[str]:
    """Paths under a source's folder that can hold rows of the months: their own folders, and files of the folder itself.

    Of the latter, those that are named by their first and last day are left out if no month is between these. The paths are as
    many as months, and files beside month folders.
    """
    if months is None:
        return folder
    own = [str(x.getPath().toString()) for x in _status(spark, f"{folder}/month={{{','.join(months)}}}")] if months else []
    flat = [str(x.getPath().toString()) for x in _status(spark, f"{folder}/{CSV}") if x.isFile()]
    other = [str(x.getPath().toString()) for x in _status(spark, f"{folder}/*") if x.isDirectory() and not x.getPath().getName().startswith(("month=", "_", "."))]
    return own + other + [x for x in flat if (m := _RANGE.search(x)) is None or any(m[1] <= month <= m[2] for month in months)]


def as_files(found: DataFrame) -> DataFrame:
    """(file, modified, size, source) of binary files, whose content is not read."""
    facts = [c(f"_metadata.{x}").alias(name) for x, name in (("file_path", "file"), ("file_modification_time", "modified"), ("file_size", "size"))]
    return found.select(*facts, parent_folder().alias("source"))


def csv_files(spark: SparkSession, paths: str | list[str]) -> DataFrame | None:
    """(file, modified, size, source) of the CSV files under the paths; None if there is no such path."""
    if not paths:
        return None
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", CSV)
    try:
        return as_files(reader.load(paths))
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _csv_files(spark: SparkSession, paths: str | list[str]) -> DataFrame | None:
    found = csv_files(spark, paths)
    return None if found is None else found.select(c("file").alias("_file"), c("modified").alias("_modified"), c("size").alias("_size"))


def _first_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, header line): the line with the lowest row number of the first block's task."""
    lines = spark.read.option("ignoreCorruptFiles", True).text(files)
    first = lines.where("_metadata.file_block_start = 0").select(c("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("n"), "value")
    return first.groupBy("_file").agg(F.min_by("value", "n").alias("_header"))


_NOTED = "_file string, _modified timestamp, _size long, _header string"


def _noted(spark: SparkSession, found: DataFrame, known: str | None, how: str) -> DataFrame:
    """Files joined with what is noted of their headers."""
    if known and len(_status(spark, f"{known}/*.parquet")):
        return found.join(spark.read.schema(_NOTED).parquet(known), ["_file", "_modified", "_size"], how)
    return found.withColumn("_header", F.lit(None).cast("string")) if how == "left" else found


def _headers(spark: SparkSession, paths: str | list[str], known: str | None) -> tuple[DataFrame, Row] | None:
    """(file, header line) of all CSV files under the paths, and facts of them: most cells of a header, its least and greatest text.

    Only files that the table ``known`` doesn't hold are opened.
    """
    found = _csv_files(spark, paths)
    if found is None:
        return None
    heads = _noted(spark, found, known, "left").select("_file", "_header").distinct()
    facts = lambda df: df.agg(F.max(F.size(F.split("_header", ","))).alias("width"), F.min("_header").alias("low"), F.max("_header").alias("high"), F.count_if(c("_header").isNull()).alias("unknown")).first()
    first = facts(heads)
    if not first["unknown"]:
        return heads, first
    unknown = [r["_file"] for r in heads.where("_header IS NULL").collect()]  # Spark's reader takes paths from the driver
    heads = heads.where("_header IS NOT NULL").union(_first_lines(spark, unknown))
    return heads, facts(heads)


def read_csv(spark: SparkSession, paths: str | list[str], source: str, static: bool = False, headers: str | None = None, file_name: str | None = None) -> DataFrame | None:
    """CSV files under a folder, each file's columns matched by its own trimmed header; None if there is no file that fits.

    A source without a known schema gets its value columns, as doubles, from the headers. Columns that a file lacks are null.
    Files that can't be read and headers without ``.geo``, or without ``date`` (with it, for ``static``), are left out. Any number
    of different headers is read in one way: a file's header goes with its rows, and a column is looked up in it. ``headers``:
    where headers are noted (``write_csv``). ``file_name``: a column of this name says which file a row is from.
    """
    found = _headers(spark, paths, headers)
    if found is None or found[1]["low"] is None:
        return None
    heads, facts = found
    cells, several = [f"_c{k}" for k in range(facts["width"])], facts["low"] != facts["high"]
    fitting = lambda names: ".geo" in names and ("date" in names) != static
    known_fields = [(f.name, f.dataType) for f in export_schema(source).fields] if source in (STATIC_COLUMNS if static else EXPORT_COLUMNS) else None
    if several:
        row = F.from_csv("_header", F.lit(", ".join(f"{x} string" for x in cells)), {"escape": '"'})
        heads = heads.select("_file", row.alias("_r")).select("_file", F.array(*[F.coalesce(c(f"_r.{x}"), F.lit("")) for x in cells]).alias("_raw"))
        heads = heads.withColumn("_names", F.transform("_raw", lambda x: F.trim(F.replace(x, F.lit("\ufeff"), F.lit("")))))
        has_date = F.array_contains("_names", "date")
        fits = heads.where(F.array_contains("_names", ".geo") & (~has_date if static else has_date))
        names = [r[0] for r in fits.select(F.posexplode("_names").alias("k", "x")).groupBy("x").agg(F.min("k").alias("k")).orderBy("k", "x").select("x").collect()]  # the columns
    else:
        names = [x.strip().strip("\ufeff") for x in next(csv.reader([facts["low"]]), [])]
    if not fitting(names):
        return None
    values = dict.fromkeys(x for x in names if x not in ("date", ".geo", ""))
    fields = known_fields or [*([] if static else [("date", T.DateType())]), *((x, T.DoubleType()) for x in values), (".geo", T.StringType())]
    reader = spark.read.schema(", ".join(f"{x} string" for x in cells)).option("recursiveFileLookup", True).option("pathGlobFilter", CSV)
    raw = reader.option("escape", '"').option("header", not several).option("mode", "PERMISSIVE").option("ignoreCorruptFiles", True).csv(paths)
    if several:  # as many rows as files on the right
        raw = raw.withColumn("_file", c("_metadata.file_path")).withColumn("_cells", F.array(*cells)).join(fits, "_file")
        raw = raw.where(F.transform("_cells", lambda x: F.coalesce(x, F.lit(""))) != c("_raw"))
        column = lambda name: F.get("_cells", (F.array_position("_names", name) - 1).cast("int"))
    else:
        column = lambda name: c(cells[names.index(name)]) if name in names else F.lit(None).cast("string")
    typed = [(F.try_to_date(column(n)) if n == "date" else column(n).try_cast(kind)).alias("geo" if n == ".geo" else n) for n, kind in fields]
    origin = [(c("_file") if several else c("_metadata.file_path")).alias(file_name)] if file_name else []
    out = raw.select(*typed, *origin)
    return out if static else out.where(c("date").isNotNull())


#: Rows of one compressed file at most, as a single task reads it whole.
FILE_ROWS = 1_000_000
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _put(out: DataFrame, path: str, compression: str | None, mode: str = "overwrite", by: Sequence[str] = ()) -> None:
    """Write rows as CSV with header and quoted GeoJSON, in folders by the columns ``by``.

    To be compressed, each task's rows are put in order of date and place, so that equal cells' values, which each of their parcels
    repeats, lie within the codec's window. What was shuffled for the rows is deleted as soon as they are written.
    """
    spark = out.sparkSession
    if compression:
        out = out.sortWithinPartitions(*by, *[c(f"`{x}`") for x in ("date", ".geo") if x in out.columns])
    to = out.write.mode(mode).option("header", True).option("escape", '"')
    if compression:
        to = to.option("compression", compression).option("maxRecordsPerFile", FILE_ROWS)
    if by:
        to = to.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        to.csv(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def write_csv(df: DataFrame, base: str, roi: str, source: str, compression: str | None = None) -> None:
    """Write a source's export to ``base/<roi>/<source>``, with header and quoted GeoJSON, a folder for each month.

    The months at hand are replaced, so an export that is run again leaves no row twice; a static one is replaced as a whole. An
    export without rows leaves the header alone if there is nothing else yet. The header of the files is noted in the tree, so that
    they need not be opened for it. ``compression``: "gzip" gives ``.csv.gz`` files, a small part of the plain ones' size; the
    readers here take both.
    """
    path, spark = f"{base}/{roi}/{source}", df.sparkSession
    fields = [f.name for f in export_schema(source).fields]
    out = df.select(*[c("geo").alias(".geo") if x == ".geo" else c(x) for x in fields])
    if "date" not in fields:
        _put(out, path, compression)
        _note_headers(spark, base, path, fields)
        return
    _put(out.withColumn("month", F.date_format("date", "yyyy-MM")), path, compression, by=["month"])
    if not len(_status(spark, f"{path}/month=*")) and not len(_status(spark, f"{path}/{CSV}")):
        _put(out.limit(0), path, compression, mode="append")
    _note_headers(spark, base, path, fields)


def _note_headers(spark: SparkSession, base: str, path: str, fields: list[str]) -> None:
    """Note the header of a source's files that aren't noted yet and were written by Spark; those of others are read when needed."""
    found, known = _csv_files(spark, path), f"{base}/{HEADERS}"
    if found is None:
        return
    found = found.where(F.regexp_extract("_file", "[^/]+$", 0).startswith("part-"))
    _noted(spark, found, known, "left_anti").withColumn("_header", F.lit(",".join(fields))).coalesce(1).write.mode("append").parquet(known)


def write_single(df: DataFrame, path: str, source: str, compression: str | None = None) -> None:
    """Write an export to one folder of its own, replacing what is there; ``compression`` as for ``write_csv``."""
    columns = [c("geo").alias(".geo") if f.name == ".geo" else c(f.name) for f in export_schema(source).fields]
    _put(df.select(*columns), path, compression)


def csv_rows(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """Files of one layout as they are, as text or with the types that Spark infers."""
    return spark.read.option("header", True).option("escape", '"').option("inferSchema", infer).csv(path)


def write_partitioned(df: DataFrame, path: str, day: str = "date", parts: int = 16) -> None:
    """Parquet by year and month; only the months at hand are replaced.

    A month's rows are dealt to up to ``parts`` tasks by a hash of the row, so that one month is no single task.
    """
    out = with_year_month(df, day)
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int")
    dealt = out.withColumn("_salt", salt).repartition("year", "month", "_salt").drop("_salt")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)


def partitions(spark: SparkSession, path: str) -> DataFrame:
    """(year, month) of the months that have a folder with files, by their names alone; empty if there is no dataset yet."""
    found = {(int(m[1]), int(m[2])) for x in _status(spark, f"{path}/year=*/month=*/*.parquet") if (m := re.search(r"year=(\d+)/month=(\d+)/", x.getPath().toString()))}
    return spark.createDataFrame(sorted(found), "year int, month int")


def drop_months(spark: SparkSession, path: str, months: Iterable[tuple[int, int]]) -> None:
    """Remove the folders of these months (year, month)."""
    for year, month in months:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/year={year}/month={month}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_ring(spark: SparkSession, path: str | None = None) -> list[tuple[float, float]]:
    """Outer ring of a GeoJSON polygon file, or the default parcel's if there is none."""
    if path is None:
        return list(DEFAULT_RING)
    try:
        rows = spark.read.schema(GEOJSON).json(path, multiLine=True).select("coordinates").where("coordinates IS NOT NULL").head(1)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    return [tuple(p) for p in rows[0]["coordinates"][0]] if rows else list(DEFAULT_RING)


def metadata(scenes: DataFrame, run_id: str, created_at: str, start: str, end: str, bands: dict[str, list[str]], ring) -> DataFrame:
    """A row per source: number of scenes, date range, bands, parcel."""
    names = F.create_map(*[x for k, v in bands.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return scenes.groupBy(c("sensor").alias("source")).agg(F.countDistinct("scene_id").alias("image_count")).select(
        F.lit(run_id).alias("run_id"), F.lit(created_at).alias("created_at"), F.lit("success").alias("status"), "source", F.lit("satellite").alias("provider"),
        "image_count", F.lit(f"{start} to {end}").alias("date_range"), F.element_at(names, c("source")).alias("bands_description"),
        F.array(F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in ring])).alias("roi_coords"),
    )


def write_metadata(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)
