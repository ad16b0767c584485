"""Structured Streaming forms of the monthly merge and of daily meteorology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinegrid.operators.merge import outer_merge
from vinegrid.sources import files

c = F.col


#: Folder, within the dataset, of what was taken in; Spark's readers of the dataset leave it out for its name.
MANIFEST = "_ingested"
_TAKEN = "file string, modified timestamp, size long, source string, year int, month int"
GONE = -1


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """(file, modified, size, source, year, month, phase, seq): a row per file and month that it has rows of; null months if it has none.

    ``seq`` numbers what was taken in together; its rows are noted as "begun" before the months are written and as "done" after.
    A file that went has the size ``GONE``.
    """
    path, columns = f"{out}/{MANIFEST}", f"{_TAKEN}, phase string, seq long"
    return spark.read.schema(columns).parquet(path) if files.exists(spark, f"{path}/phase=*/seq=*/*.parquet") else spark.createDataFrame([], columns)


def _done(taken: DataFrame) -> DataFrame:
    """(file, modified, size, source) as each file was last taken in."""
    return taken.where("phase = 'done'").groupBy("file").agg(F.max_by(F.struct("modified", "size", "source"), "seq").alias("_s")).select("file", "_s.*")


def _standing(taken: DataFrame) -> DataFrame:
    """Rows whose months may hold rows of a file: those of the last time it was taken in, and of what was begun since."""
    last = taken.groupBy("file").agg(F.max(F.when(c("phase") == "done", c("seq"))).alias("_last"))
    return taken.join(last, "file").where(c("seq") >= F.coalesce("_last", F.lit(0))).drop("_last")


def _months_of(spark: SparkSession, found: DataFrame, headers: str) -> DataFrame:
    """Files (file, modified, size, source) with the months of their rows."""
    by_source: dict[str, list[str]] = {}
    for row in found.select("source", "file").collect():  # as many rows as a batch has files; Spark's reader takes paths from the driver
        by_source.setdefault(row["source"], []).append(row["file"])
    dates = spark.createDataFrame([], "file string, date date")
    for source, paths in by_source.items():
        if (df := files.read_csv(spark, paths, source, headers=headers, file_name="_in_file")) is not None:
            dates = dates.union(df.select("_in_file", "date"))
    months = dates.select("file", F.year("date").alias("year"), F.month("date").alias("month")).distinct()
    return found.join(months, "file", "left").select("file", "modified", "size", "source", "year", "month")


def _calendar(df: DataFrame) -> set[tuple[int, int]]:
    return {(r["year"], r["month"]) for r in df.where("year IS NOT NULL").select("year", "month").distinct().collect()}


def _replace_months(spark: SparkSession, raw: str, out: str, roi: str, due: set[tuple[int, int]], left: set[tuple[int, int]]) -> None:
    """Merge the months ``due`` anew from the whole tree. ``left``: those of them that may have no rows any more, which are removed then."""
    if not due:
        return
    months = spark.createDataFrame(sorted(due), "year int, month int")
    of_months = lambda df: df.join(F.broadcast(months), (F.year("date") == c("year")) & (F.month("date") == c("month")), "left_semi")
    rows = {k: of_months(v) for k, v in files.read_sources(spark, raw, roi, [f"{y}-{m:02d}" for y, m in sorted(due)]).items()}
    if rows:
        files.write_partitioned(outer_merge(rows), out)
    if left:
        for df in rows.values():
            left = left - _calendar(df.select(F.year("date").alias("year"), F.month("date").alias("month")))
        files.drop_months(spark, out, left)


def _take(spark: SparkSession, raw: str, out: str, roi: str, found: DataFrame, gone: DataFrame | None = None) -> None:
    """Take in those of the files ``found`` (file, modified, size, source) that weren't taken in as they are, and that ``gone`` went."""
    taken = manifest(spark, out)
    fresh = found.join(_done(taken), ["file", "modified", "size"], "left_anti").select("file", "modified", "size", "source")
    state = _months_of(spark, fresh, f"{raw}/{files.HEADERS}")
    if gone is not None:
        none = lambda kind: F.lit(None).cast(kind)
        state = state.union(gone.select("file", none("timestamp"), F.lit(GONE).cast("long"), "source", none("int"), none("int")))
    number = (taken.agg(F.max("seq")).first()[0] or 0) + 1
    note = lambda df, phase: df.coalesce(1).write.mode("overwrite").parquet(f"{out}/{MANIFEST}/phase={phase}/seq={number}")
    note(state, "begun")
    taken = manifest(spark, out)
    begun = taken.where((c("phase") == "begun") & (c("seq") == number)).drop("phase", "seq")
    now = _calendar(begun)
    before = _calendar(_standing(taken.where(c("seq") < number)).join(begun.select("file").distinct(), "file", "left_semi"))
    _replace_months(spark, raw, out, roi, now | before, before - now)
    note(begun, "done")


def ingest_csv(spark: SparkSession, raw: str, out: str, checkpoint: str, roi: str = "*", files_per_batch: int = 1000) -> None:
    """When CSVs of any source arrive, change or go, merge the months that they touch anew, from all sources, and replace these months.

    The outer merge is not append-only, so touched months are recomputed, never appended to. A batch's new files, at most
    ``files_per_batch``, are read by their own headers. What a batch takes in is noted in a manifest within the dataset before and
    after its months are written, so each state of a file (time and size) counts once: a batch that stopped on the way runs again
    and gives the same months, also those that only its first try touched; one whose files are all noted as done changes nothing,
    even for a new checkpoint. A stream looks at a file's name once; so the tree is compared with the manifest first, and files
    that were replaced or removed have the months of both states recomputed. Months left without rows are removed.
    One ingest at a time writes to ``out``, which belongs to one tree and ``roi``.
    """
    known = _done(manifest(spark, out))
    if known.head(1):
        listed = files.csv_files(spark, f"{raw}/{roi}/*")
        listed = spark.createDataFrame([], _TAKEN).select("file", "modified", "size", "source") if listed is None else listed
        changed = listed.join(known, "file", "left_semi").join(known, ["file", "modified", "size"], "left_anti")
        gone = known.where(c("size") != GONE).join(listed, "file", "left_anti")
        if changed.head(1) or gone.head(1):
            _take(spark, raw, out, roi, changed, gone)

    def arrived(batch: DataFrame, _: int) -> None:
        new = batch.join(_done(manifest(spark, out)), ["file", "modified", "size"], "left_anti")
        if new.head(1):
            _take(spark, raw, out, roi, batch)

    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    stream = stream.option("recursiveFileLookup", True).option("pathGlobFilter", files.CSV).option("maxFilesPerTrigger", files_per_batch).load(f"{raw}/{roi}/*")
    files.as_files(stream).writeStream.foreachBatch(arrived).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_meteo(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Daily temperature statistics of a stream (ts, cell_id, temp_c); read them with ``latest_meteo``.

    Update mode: each batch writes the days that it changed, in a folder of its own, which a batch that is run again replaces.
    Rows of over a day behind the newest one seen in earlier batches are too late and left out, and closed days leave the state.
    """
    daily = (
        stream.withColumn("ts", c("ts").cast("timestamp")).withWatermark("ts", "1 day")
        .groupBy("cell_id", F.window("ts", "1 day").alias("w"))
        .agg(F.min("temp_c").alias("MIN_TEMP_C"), F.avg("temp_c").alias("MEAN_TEMP_C"), F.max("temp_c").alias("MAX_TEMP_C"))
        .select("cell_id", F.to_date("w.start").alias("date"), "MIN_TEMP_C", "MEAN_TEMP_C", "MAX_TEMP_C")
    )

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    daily.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_meteo(spark: SparkSession, out: str) -> DataFrame:
    """Each cell's days as the last batch that changed them left them."""
    values = F.struct("MIN_TEMP_C", "MEAN_TEMP_C", "MAX_TEMP_C")
    return spark.read.parquet(out).groupBy("cell_id", "date").agg(F.max_by(values, "batch").alias("v")).select("cell_id", "date", "v.*")
