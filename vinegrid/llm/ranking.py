"""Global ranks without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vinegrid.llm.common import materialize

#: Bits that ``monotonically_increasing_id`` leaves for a row's place within its partition.
_PLACE_BITS = 33


def ranked(written: DataFrame, order: Sequence[Column], tag: str) -> DataFrame:
    """Add ``rank`` (long, from 0) by ``order``, for a table that ``materialize`` wrote.

    Rows are dealt to ranges of the order and numbered there; the ranges' sizes, of which there are as many as shuffle partitions,
    give the rest. Rows that are equal in the order follow their place in the written files, which no lost executor changes, so
    even a third of all rows with one key is dealt to many ranges. An empty table gives no rows.
    """
    spark = written.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written.withColumns({"_file": F.xxhash64("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    ordered = placed.repartitionByRange(n, *order, "_file", "_row").sortWithinPartitions(*order, "_file", "_row").drop("_file", "_row")
    numbered = materialize(ordered.withColumn("_id", F.monotonically_increasing_id()), tag)
    part = F.shiftright("_id", _PLACE_BITS)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.col("_id").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return numbered.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("rank", F.col("_before") + place).drop("_part", "_before", "_id")
