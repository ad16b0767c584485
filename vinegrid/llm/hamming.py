"""Exact top-k search on binary codes with incremental multi-index hashing."""

from __future__ import annotations

from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vinegrid.llm.common import materialize, table

K = 10
#: Bits of the distinct codes of one index block, and codes of a query block, at most; blocks are smaller while cores are idle.
INDEX_BITS = 1 << 26
QUERY_BLOCK = 1 << 14
#: Below so many codes an index block is not split.
SMALL_BLOCK = 1 << 13
#: Probes or comparisons that are made at once, in 64-bit words.
AT_ONCE = 1 << 21


def sign_code(vector: Column) -> Column:
    """Signs of the components, whatever their number: an array of that number and of 64-bit words, the first component highest.

    Null if there is no component or one is null or not finite.
    """
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bit = lambda x: F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    word = lambda w: F.aggregate(F.slice(vector, w * 64 + 1, F.lit(64)), F.lit(0).cast("long"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(bit(x)))
    size = F.size(vector)
    code = F.concat(F.array(size.cast("long")), F.transform(F.sequence(F.lit(0), F.floor((size - 1) / 64).cast("int")), word))
    return F.when(sound & (size > 0), code)


def _segments(bits: int, n: int) -> list[tuple[int, int]]:
    """Ranges of the bits, of about log2 of the number of codes each."""
    m = max(1, -(-bits // 62), round(bits / max(log2(max(n, 2)), 1)))
    edges = [bits * x // m for x in range(m + 1)]
    return list(zip(edges, edges[1:]))


def _part(words: np.ndarray, a: int, b: int, bits: int) -> np.ndarray:
    """Bits a to b, at most 62, of codes given as words; the last word holds what is left, lowest bits."""
    out = np.zeros(len(words), np.uint64)
    for w in range(a // 64, (b - 1) // 64 + 1):
        size = min(64, bits - 64 * w)
        low, high = max(a - 64 * w, 0), min(b - 64 * w, size)
        own = (words[:, w] >> np.uint64(size - high)) & np.uint64((1 << (high - low)) - 1)
        out = (out << np.uint64(high - low)) | own
    return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _covering(index: np.ndarray, counts: np.ndarray, queries: np.ndarray, k: int, bits: int, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, code, distance) that hold all codes as near as the k-th nearest row of each query.

    index: distinct codes (rows of words), counts: rows of each. The codes are cut into m segments. Step (r, s) looks up, in
    segment s, all values that differ in r bits. After it a code that was not met differs in over r bits of segments 0 to s and in
    r at least of the others, by m * r + s + 1 in all: so a query is done once its k-th verified distance is m * r + s at most.
    Segments have about as many values as there are codes, so all radii together cost m probes a code. work: gets radius and
    number of codes met for each step.
    """
    n = len(index)
    segments = []
    for a, b in _segments(bits, n):
        value = _part(index, a, b, bits)
        order = np.argsort(value, kind="stable")
        segments.append((_part(queries, a, b, bits), b - a, order, value[order]))
    m = len(segments)
    active = np.arange(len(queries))
    met = [np.zeros(0, np.int64)] * 3
    total = int(counts.sum())

    def add(q: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
        """Merge new pairs, drop repeats and what is further than the k-th row found so far."""
        key = np.concatenate([met[0], q]) * n + np.concatenate([met[1], c])
        key, at = np.unique(key, return_index=True)
        d = np.concatenate([met[2], d])[at]
        q, c = key // n, key % n
        order = np.lexsort((d, q))
        q, c, d = q[order], c[order], d[order]
        keep = d <= kth(q, c, d)[q]
        met[:] = q[keep], c[keep], d[keep]

    def kth(q: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Distance of the k-th row of each query, beyond all where fewer are known; pairs are sorted by query and distance."""
        have = np.cumsum(counts[c])
        first = np.searchsorted(q, np.arange(len(queries)))
        base = np.concatenate([[0], have])[first]
        reached = np.flatnonzero(have - base[q] >= min(k, total))
        out = np.full(len(queries), bits + 1)
        np.minimum.at(out, q[reached], d[reached])
        return out

    for r in range(max(width for _, width, _, _ in segments) + 1):
        for s, (own_part, width, order, value) in enumerate(segments):
            if not len(active):
                return met[0], met[1], met[2]
            masks = np.array([sum(1 << x for x in flip) for flip in combinations(range(width), r)], np.uint64)
            step = max(1, AT_ONCE // max(len(masks), 1))
            for low in range(0, len(active) if len(masks) else 0, step):
                own = active[low : low + step]
                probe = (own_part[own][:, None] ^ masks).ravel()
                start, stop = np.searchsorted(value, probe, "left"), np.searchsorted(value, probe, "right")
                hits = stop - start
                if work is not None:
                    work += [r, int(hits.sum())]
                for part in np.array_split(np.flatnonzero(hits), int(hits.sum()) * index.shape[1] // AT_ONCE + 1):
                    size = hits[part]
                    place = np.repeat(start[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    code, q = order[place], own[np.repeat(part, size) // len(masks)]
                    add(q, code, _distance(queries[q], index[code]))
            active = active[kth(*met)[active] > m * r + s]
    return met[0], met[1], met[2]


def _search(k: int):
    def words(table: pa.Table) -> np.ndarray:
        return table["code"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)

    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if index.num_rows and queries.num_rows:
            ids = index["ids"].combine_chunks()
            starts, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
            sizes = np.diff(starts)
            own, asked = words(index), words(queries)
            q, c, d = _covering(own[:, 1:].view(np.uint64), sizes, asked[:, 1:].view(np.uint64), k, int(own[0, 0]))
            size = sizes[c]
            place = np.repeat(starts[c] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            q, d, v = np.repeat(q, size), np.repeat(d, size), flat[place]
            order = np.lexsort((v, d, q))
            q, d, v = q[order], d[order], v[order]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            out = [list(asked[q[nth < k]]), v[nth < k], d[nth < k]]
        return pa.table({name: pa.array(x, kind) for name, x, kind in zip(("code", "vec_id", "distance"), out, (pa.list_(pa.int64()), pa.int64(), pa.int64()))})

    return search


def top_k(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The k rows of ``codes`` (id, code) nearest to each row of ``queries`` (id, code), ties by the smaller id.

    code: as sign_code makes it, of any length, or a 64-bit integer. Codes of another length than the query's are no answer.
    Rows of equal code are one entry with its k smallest ids, which no answer can go beyond, so a code that a third of the
    rows share costs no more than another. Distinct codes and distinct query codes are dealt into bounded blocks; a task
    searches a block of queries in an index block of its own making, and the best k of the blocks are merged. Null codes or
    ids neither ask nor answer; repeated ids count as rows; a query row is itself among the answers if it is in ``codes``.

    Returns ``(query_id, rank, vec_id, distance)``, fewer than k rows where there are fewer.
    """
    spark = codes.sparkSession
    if dict(codes.dtypes)["code"] == "bigint":
        wide = lambda df: df.withColumn("code", F.when(F.col("code").isNotNull(), F.array(F.lit(64).cast("long"), "code")))
        codes, queries = wide(codes), wide(queries)
    known = codes.where(F.col("id").isNotNull() & F.col("code").isNotNull())
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    classes = materialize(known.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "mih-codes")
    asked = queries.where(F.col("id").isNotNull() & F.col("code").isNotNull())
    asked_codes = materialize(asked.select("code").distinct(), "mih-queries")
    size = classes.agg(F.count("*").alias("n"), F.max(F.col("code")[0]).alias("bits")).first()
    n, n_q, cores = size["n"], asked_codes.count(), spark.sparkContext.defaultParallelism
    blocks = max(-(-n * (size["bits"] or 1) // INDEX_BITS), min(cores, -(-n // SMALL_BLOCK)), 1)
    q_blocks = max(-(-n_q // QUERY_BLOCK), min(-(-cores // blocks), n_q), 1)
    keys = ["bits", "index_block", "query_block"]

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        placed = df.withColumns({"bits": F.col("code")[0], own: F.pmod(F.xxhash64("code"), F.lit(n_own)).cast("int")})
        # by number, so that few bytes don't end up in one task
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).repartition(4 * blocks * q_blocks, *keys).groupBy(*keys)

    index = dealt(classes, "index_block", blocks, "query_block", q_blocks)
    asking = dealt(asked_codes, "query_block", q_blocks, "index_block", blocks)
    found = index.cogroup(asking).applyInArrow(_search(k), "code array<bigint>, vec_id long, distance long")
    best = F.row_number().over(Window.partitionBy("code").orderBy("distance", "vec_id"))
    merged = found.withColumn("rank", best).where(F.col("rank") <= k).groupBy("code").agg(F.collect_list(F.struct("rank", "vec_id", "distance")).alias("top"))
    return asked.join(materialize(merged, "mih-found"), "code").select(F.col("id").alias("query_id"), F.explode("top").alias("t")).select("query_id", "t.rank", "t.vec_id", "t.distance")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code"))
    return top_k(rows, rows.where("id % 50 = 0"))


#: Signs as text, compared place by place.
OP10_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings WHERE embedding IS NOT NULL),
d AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.b, r.b), lambda z: CASE WHEN z[1] = z[2] THEN 0 ELSE 1 END)) AS BIGINT) AS distance
  FROM c q CROSS JOIN c r WHERE q.vec_id % 50 = 0
),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM n WHERE rank <= 10
"""
