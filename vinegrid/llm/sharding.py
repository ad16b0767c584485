"""Proportional stratified interleaving of documents into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vinegrid.llm.common import materialize, table

#: Hash ranges that split the ranking of one source, and ranges of the fractional rank that split the global one.
SOURCE_RANGES = 1 << 10
FRACTION_RANGES = 1 << 12


def interleave(docs: DataFrame, n_shards: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Deal rows into ``n_shards`` shards that all match the mixture of sources.

    Rows of a source are ranked in a seeded shuffle, the rank is divided by the source's size, and the rows of all sources
    are put in order of that fractional rank and cut into equal runs (row counts differ by one at most).

    No source meets in one task: the shuffle key's top bits split its ranking, counts per range give the offsets. Fractional
    ranks are even by construction (each source starts at an own offset between 0 and 1), so ranges of them split the global
    order evenly, too. The ids and sizes are written once to the shared folder, the texts are read once and never shuffled.

    Null texts count as empty (size 16), null sources are a source of their own, null and repeated ids are ranked like any
    others (ties by size and checksum; equal rows are interchangeable). An empty table gives no rows. Equal texts are not
    kept together: the law is on row counts and a group of copies may be larger than a shard.

    Returns ``(doc_id, source, size, text_crc32, shard, slot, position)``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.concat(F.when(F.col(source_col).isNull(), "0").otherwise("1"), F.coalesce(F.col(source_col).cast("string"), F.lit(""))).alias("stratum"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
        .withColumn("hr", F.shiftrightunsigned("h", 64 - SOURCE_RANGES.bit_length() + 1).cast("int")),
        "shard-thin",
    )
    counts = thin.groupBy("stratum", "hr").agg(F.count("*").alias("n"))
    by_source = Window.partitionBy("stratum")
    offsets = counts.select(
        "stratum", "hr",
        (F.sum("n").over(by_source.orderBy("hr").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
        F.sum("n").over(by_source).alias("of_source"),
    )
    order = Window.partitionBy("stratum", "hr").orderBy("h", "doc_id", "size", "text_crc32")
    start = (F.pmod(F.xxhash64(F.lit(seed + 1), "stratum"), F.lit(1 << 20)) + 0.5) / F.lit(float(1 << 20))
    ranked = materialize(
        thin.withColumn("in_range", F.row_number().over(order)).join(offsets, ["stratum", "hr"])
        .withColumn("rank", F.col("before") + F.col("in_range"))
        .withColumn("fraction", (F.col("rank") - start) / F.col("of_source"))
        .withColumn("fr", F.least(F.floor(F.col("fraction") * FRACTION_RANGES), F.lit(FRACTION_RANGES - 1)).cast("int"))
        .select("doc_id", "source", "stratum", "size", "text_crc32", "rank", "fraction", "fr"),
        "shard-ranked",
    )
    # at most FRACTION_RANGES rows, so that one task and a broadcast are safe
    per_range = ranked.groupBy("fr").agg(F.count("*").alias("n"))
    w = Window.orderBy("fr")
    per_range = per_range.select("fr", (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("first"), F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    position = Window.partitionBy("fr").orderBy("fraction", "stratum", "rank")
    return (
        ranked.withColumn("in_fr", F.row_number().over(position)).join(F.broadcast(per_range), "fr")
        .withColumn("position", F.col("first") + F.col("in_fr") - 1)
        .withColumn("shard", F.expr(f"int(position * {n_shards} div total)"))
        .withColumn("slot", F.expr(f"position - (shard * total + {n_shards - 1}) div {n_shards}"))
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot", "position")
    )


def write_shards(docs: DataFrame, dealt: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> None:
    """Write the documents in shard folders, rows in slot order. dealt: what ``interleave`` made of them.

    Rows meet their places by id, source, size and checksum, and in turn where these are equal, so null and repeated ids are
    written once each.
    """
    keys = ["_id", "_source", "_size", "_crc"]
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.withColumns({"_id": F.col(id_col), "_source": F.col(source_col), "_size": (F.octet_length(text) + 16).cast("long"), "_crc": F.crc32(text.cast("binary"))})
    own = own.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*docs.columns))))
    places = dealt.select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("text_crc32").alias("_c"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    places = places.withColumn("_n", F.row_number().over(Window.partitionBy("_i", "_s", "_z", "_c").orderBy("_shard", "_slot")))
    same = F.col("_id").eqNullSafe(F.col("_i")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_z")) & (F.col("_crc") == F.col("_c")) & (F.col("_nth") == F.col("_n"))
    (
        own.join(places, same).repartition("_shard", F.expr("_slot div 100000")).sortWithinPartitions("_shard", "_slot")
        .select(*docs.columns, F.col("_shard").alias("shard_number"), F.col("_slot").alias("slot"))
        .write.mode("overwrite").partitionBy("shard_number").parquet(path)
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = interleave(table(spark, sf_dir, "documents"), n_shards=40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
