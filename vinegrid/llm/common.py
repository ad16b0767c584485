"""Helpers that the training-data operators share: shared-folder tables and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's setting that deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's limit of an Arrow batch between an executor and its Python worker, and what the pipeline sets it to.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: ``spark.checkpoint.dir``; a local one where it is unset, for a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    return f"file://{tempfile.gettempdir()}/vinegrid-{spark.sparkContext.applicationId}"


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes for the session: by rows alone a batch holds 10,000 texts, in the executor and in the worker, coming and going.

    The setting stays, as it counts when a query runs, not when it is made. A smaller one is kept.
    """
    now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH)))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(BATCH, BATCH_BYTES)


#: What Python workers keep from task to task.
_CACHES: list[dict] = []


def worker_cache(cache: dict) -> dict:
    """Register a cache that a Python worker keeps from task to task, until a task of another kind runs in it (``keep_only``)."""
    _CACHES.append(cache)
    return cache


def keep_only(*own: dict) -> None:
    """At the start of a task: empty the caches that other kinds of tasks left in this worker, and give back Arrow's unused memory."""
    import pyarrow as pa

    for cache in _CACHES:
        if not any(cache is x for x in own):
            cache.clear()
    pa.default_memory_pool().release_unused()


def crc32_sql(words: str) -> str:
    """DuckDB's common table expressions up to ``crc (w, crc)``, the unsigned CRC-32 of the UTF-8 bytes of a query's strings ``w``; they need RECURSIVE."""
    return f"""crc_bits AS (
  SELECT i AS octet, i AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT octet, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM crc_bits WHERE k < 8
), crc_table AS (SELECT octet, v FROM crc_bits WHERE k = 8), crc_steps AS (
  SELECT w, hex(encode(w)) AS h, 0 AS k, 4294967295 AS a FROM ({words})
  UNION ALL SELECT w, h, k + 1, xor(a >> 8, v) FROM crc_steps JOIN crc_table ON octet = xor(a, ('0x' || substr(h, 2 * k + 1, 2))::BIGINT) & 255 WHERE 2 * k < length(h)
), crc AS (SELECT w, xor(a, 4294967295) AS crc FROM crc_steps WHERE 2 * k = length(h))"""


def materialize(df: DataFrame, tag: str, release: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation. The files go when the application ends, or with
    ``discard``. What was shuffled for it goes as soon as it is written: Spark is told to delete a query's shuffle files at its
    end, not when the driver's garbage collector finds them unused, which may be never. ``release``: what was shuffled for other
    queries before is large, too; the collector is asked to run now.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    if release:
        spark._jvm.System.gc()
    written = spark.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every node that has an edge to another node.

    Alternating large-star / small-star contraction: each round is two aggregate-and-join steps on the edge table, written to
    the shared folder. Minima are pre-aggregated before the shuffle and the joins are plain equi-joins with a unique right
    side, so a hub's edges can be split by adaptive execution. Self loops and null ends are ignored.

    Returns ``(node, component)``; nodes without edges are left out. An empty table gives an empty result.
    """
    pairs = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
        .distinct()
    )
    pairs = materialize(pairs, "cc-edges", release=True)
    if pairs.isEmpty():
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: every smaller neighbour of a node, and the node itself, is linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        done = materialize(small, "cc-edges")
        discard(pairs)
        # a forest of stars is a fixed point: no node is both a root and a leaf, and no leaf has two roots
        state = done.agg(F.count("u").alias("n"), F.countDistinct("u").alias("nodes")).first()
        roots_below = done.select(F.col("v").alias("u")).distinct().join(done.select("u").distinct(), "u", "left_semi")
        pairs = done
        if state["n"] == state["nodes"] and roots_below.isEmpty():
            break
    else:
        raise RuntimeError("connected components did not converge")
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.union(roots)


def sliced(batches, rows: int = 1000):
    """The same rows in batches of at most ``rows``, to bound what a worker holds at once."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def grouped_batches(batches, n_keys: int):
    """Arrow batches of a partition sorted by its first ``n_keys`` columns, dealt anew so that no run of equal keys is cut."""
    import numpy as np
    import pyarrow as pa

    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        new = np.zeros(batch.num_rows, bool)
        for x in keys:
            new[1:] |= x[1:] != x[:-1]
        cuts = np.flatnonzero(new)
        if len(cuts):
            last = int(cuts[-1])
            held[-1] = batch.slice(0, last)
            yield pa.Table.from_batches(held)
            held = [batch.slice(last)]
        elif len(held) > 1 and any(held[-2].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(n_keys)):
            yield pa.Table.from_batches(held[:-1])
            held = held[-1:]
    if held:
        yield pa.Table.from_batches(held)


def local_roots(n: int, i, j):
    """Smallest index that each of ``n`` nodes reaches over the links (i, j); numpy hooking and pointer jumping."""
    import numpy as np

    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (jumped := root[root] != root).any():
            root = np.where(jumped, root[root], root)
    return root


def keyed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add ``_key``: the id itself where ids are unique and not null, else ranks of (id, text's hash), a null id first.

    Rows that repeat both id and text are one document and share their key. Ranks are row numbers within ranges of the order,
    put together from the ranges' counts, of which there are as many as shuffle partitions.
    """
    doc_id = F.col(id_col).cast("long")
    if docs.groupBy(doc_id.alias("i")).agg(F.count("*").alias("n")).where("n > 1 OR i IS NULL").isEmpty():
        keyed = docs.withColumn("_key", doc_id)
        keyed._by_id = True
        return keyed
    spark = docs.sparkSession
    hashed = docs.withColumn("_h", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    order = [F.asc_nulls_first("_i"), F.asc("_g")]
    pairs = hashed.select(doc_id.alias("_i"), F.col("_h").alias("_g")).distinct().repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order)
    ranged = materialize(pairs.withColumn("_part", F.spark_partition_id()), "doc-ranges")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    ranks = materialize(ranged.withColumn("_nth", nth).join(F.broadcast(starts), "_part").select("_i", "_g", (F.col("_before") + F.col("_nth") - 1).alias("_key")), "doc-keys")
    return hashed.join(ranks, doc_id.eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_g"))).drop("_i", "_g", "_h")
