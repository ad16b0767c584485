"""Embedding near-duplicates: int8 tile products with error bounds, doubtful pairs recomputed in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vinegrid.llm.common import connected_components, local_roots, materialize, table

THRESHOLD = 0.93
#: A label's rows are cut into about TILES tiles, of TILE_ROWS[0] to TILE_ROWS[1] rows each.
TILES = 16
TILE_ROWS = (2048, 65536)
#: Rows of one block of a tile product.
BLOCK = 1024


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 codes, scale and error bound of unit vectors (rows, double).

    The bound is the norm of what the codes leave out, rounded up: |x - scale * code| <= bound.
    """
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    code = np.rint(x / scale[:, None]).astype(np.int8)
    left = np.sqrt(((x - scale[:, None] * code) ** 2).sum(axis=1))
    return code, scale, left * (1 + 1e-9) + 1e-12


def _bounds(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Product of the codes of two blocks (code, scale, err), and how far the cosine may be from it.

    For unit x, y with codes x', y': x.y - x'.y' = x.(y - y') + (x - x').y', so |x.y - x'.y'| <= e_y + e_x (1 + e_y). The product
    of the codes is exact: integers below 2**24 in single precision (double for more than 1040 dimensions).
    """
    kind = np.float32 if a[0].shape[1] <= 1040 else np.float64
    product = (a[0].astype(kind) @ b[0].astype(kind).T).astype(np.float64) * (a[1][:, None] * b[1])
    return product, a[2][:, None] * (1 + b[2]) + b[2]


#: Kinds of rows: a class with its number of linked rows and its root in the tile; a pair that the codes leave open.
LINKED, OPEN = 0, 1


def _tile_links(threshold: float):
    def links(part: pa.Table) -> pa.Table:
        order = np.argsort(part["tile"].to_numpy(), kind="stable")
        tile = part["tile"].to_numpy()[order]
        key = part["key"].take(pa.array(order)).combine_chunks()
        code = np.stack([np.frombuffer(x, np.int8) for x in part["code"].to_pylist()])[order]
        own = code, part["scale"].to_numpy()[order], part["err"].to_numpy()[order]
        weight = part["rows"].to_numpy()[order]
        # what single precision may add to the codes' own errors in the doubles: nothing beyond 1e-9
        n, cut = len(tile), int(np.searchsorted(tile, tile[0], "right"))
        one = part["tile_a"][0] == part["tile_b"][0]
        count, root = np.zeros(n, np.int64), np.arange(n)
        open_i, open_j = [], []
        end = n if one else cut
        for low in range(0, end, BLOCK):
            high = min(low + BLOCK, end)
            for start in range(low if one else cut, n, BLOCK):
                stop = min(start + BLOCK, n)
                near, slack = _bounds(tuple(x[low:high] for x in own), tuple(x[start:stop] for x in own))
                sure = near - slack >= threshold + 1e-9
                i, j = np.nonzero(sure)
                i, j = i + low, j + start
                if one:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    count += np.bincount(i, weight[j], minlength=n).astype(np.int64) + np.bincount(j, weight[i], minlength=n).astype(np.int64)
                    # links so far stand as one link from each row to its root
                    root = local_roots(n, np.concatenate([np.arange(n), i]), np.concatenate([root, j]))
                i, j = np.nonzero((near + slack >= threshold - 1e-9) & ~sure)
                i, j = i + low, j + start
                if one:
                    i, j = i[i < j], j[i < j]
                open_i.append(i), open_j.append(j)
        has = np.flatnonzero(count)
        i, j = np.concatenate(open_i), np.concatenate(open_j)
        left, right = np.concatenate([has, i]), np.concatenate([root[has], j])
        kind = np.repeat(np.array([LINKED, OPEN], np.int32), [len(has), len(i)])
        n_links = np.concatenate([count[has], np.zeros(len(i), np.int64)])
        return pa.table({"kind": pa.array(kind), "key": key.take(pa.array(left)), "other": key.take(pa.array(right)), "n": pa.array(n_links)})

    return links


def unit_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Rows that can link: ``(vec_id, label, dim, unit)``, unit as bytes of doubles; null, zero and non-finite vectors are left out."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for key, label, vector in zip(*(batch.column(k).to_pylist() for k in range(3))):
                x = np.array(vector, np.float64)  # null components become nan
                if not len(x) or not np.isfinite(x).all() or not x.any():
                    continue
                x = x / np.abs(x).max()  # no overflow in the norm
                x = x / np.sqrt((x * x).sum())
                for column, value in zip(out, (key, label, len(x), (x + 0.0).tobytes())):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["vec_id", "label", "dim", "unit"])

    usable = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull())
    thin = usable.select(F.col(id_col).cast("long"), F.col(label_col).cast("string"), F.col(vector_col).cast("array<double>"))
    return thin.mapInArrow(convert, "vec_id long, label string, dim int, unit binary")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(.., unit) to (.., code, scale, err)."""
    for batch in batches:
        found = [quantise(np.frombuffer(x, np.float64)[None]) for x in batch.column(batch.num_columns - 1).to_pylist()]
        code, scale, err = pa.array([c.tobytes() for c, _, _ in found], pa.binary()), pa.array([float(s[0]) for _, s, _ in found], pa.float64()), pa.array([float(e[0]) for _, _, e in found], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], code, scale, err], names=[*batch.schema.names[:-1], "code", "scale", "err"])


def _verified(threshold: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (batch.num_columns - 2, batch.num_columns - 1))
            near = [bool((np.frombuffer(x, np.float64) * np.frombuffer(y, np.float64)).sum() >= threshold) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(near, pa.bool_())) for x in batch.columns[:-2]], names=batch.schema.names[:-2])

    return verified


_KEY = "struct<low:bigint,hash:string>"


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links between vectors of one label by cosine: ``(vec_id, n_links, component_id, kept)``, a row per input row.

    Rows of a label with the same direction are one class, named by its smallest vec_id and a hash. Each label's classes are
    dealt into tiles; a task gets a pair of tiles, so a label that holds a third of all rows is spread over many tasks. Only
    codes, scales and bounds travel there: pairs surely above the threshold give a count and one link to a root for each class,
    and pairs that the bounds leave open fetch their doubles and are decided by them. The work is quadratic in a label's
    classes, as the exact result asks for; what int8 saves is the arithmetic.

    n_links counts the other rows that are linked, itself left out. Null labels, null, zero or non-finite vectors and vectors of
    another length link with nothing. Rows that repeat a vec_id are vectors of their own, linked if they are near; a null vec_id
    takes part but names no component unless all are null. An empty table gives no rows.
    """
    rows = materialize(unit_rows(vectors).withColumn("hash", F.sha2("unit", 256)), "emb-unit")
    classes = rows.groupBy("label", "dim", "hash").agg(F.min("vec_id").alias("low"), F.count("*").alias("rows"), F.first("unit").alias("unit"))
    classes = classes.select("label", "dim", F.struct("low", F.concat("hash", "label").alias("hash")).alias("key"), "rows", "unit")
    classes = materialize(classes.withColumn("copy", F.col("unit")).mapInArrow(_coded, f"label string, dim int, key {_KEY}, rows long, unit binary, code binary, scale double, err double"), "emb-classes")
    share = F.ceil(F.col("n") / TILES)
    tiles = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).select(
        "label", "dim", F.ceil(F.col("n") / F.least(F.greatest(share, F.lit(TILE_ROWS[0])), F.lit(TILE_ROWS[1]))).cast("int").alias("tiles")
    )
    dealt = (
        classes.drop("unit").join(tiles, ["label", "dim"])
        .withColumn("tile", F.pmod(F.xxhash64("key.hash"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("tile_a", F.least("tile", "other")).withColumn("tile_b", F.greatest("tile", "other"))
        .drop("tiles", "other")
    )
    found = materialize(dealt.groupBy("label", "dim", "tile_a", "tile_b").applyInArrow(_tile_links(threshold), f"kind int, key {_KEY}, other {_KEY}, n long"), "emb-links")
    units = classes.select("key", "rows", "unit")
    side = lambda x, y: units.select(F.col("key").alias(x), F.col("rows").alias(f"rows_{x}"), F.col("unit").alias(y))
    pairs = found.where(F.col("kind") == OPEN).select("key", "other").join(side("key", "unit_a"), "key").join(side("other", "unit_b"), "other")
    pairs = pairs.select("key", "other", "rows_key", "rows_other", "unit_a", "unit_b").mapInArrow(_verified(threshold), f"key {_KEY}, other {_KEY}, rows_key long, rows_other long")
    pairs = materialize(pairs, "emb-verified")
    sure = found.where(F.col("kind") == LINKED)
    both = sure.select("key", "n").union(pairs.select("key", F.col("rows_other").alias("n"))).union(pairs.select("other", F.col("rows_key").alias("n")))
    counts = both.groupBy("key").agg(F.sum("n").alias("others"))
    comps = connected_components(sure.select("key", "other").union(pairs.select("key", "other")), "key", "other").withColumnRenamed("node", "key")
    # a component's name is its smallest id that is not null
    lows = comps.groupBy("component").agg(F.min("key.low").alias("name"))
    named = classes.select("key", "rows").join(counts, "key", "left").join(comps.join(lows, "component"), "key", "left")
    linked = 0.0 if threshold > 1 else F.col("rows") - 1  # rows of one direction have cosine 1
    named = named.select(F.col("key.hash").alias("hash"), (F.coalesce("others", F.lit(0)) + linked).alias("n_links"), F.coalesce("name", F.col("key.low")).alias("component_id"))
    own = rows.select("vec_id", F.concat("hash", "label").alias("hash")).join(named, "hash").select("vec_id", "n_links", "component_id")
    # rows that link with nothing are those that unit_rows leaves out; equal ids are told apart by whether they are usable
    alone = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label").isNotNull() & F.coalesce(_usable(F.col("embedding").cast("array<double>")), F.lit(False))).alias("_usable")).where(~F.col("_usable"))
    return own.union(alone.select("vec_id", F.lit(0).cast("long"), "vec_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _usable(vector):
    """What unit_rows takes: no null or non-finite component, one that is not zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return sound & F.exists(vector, lambda x: x != 0)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs of a label, then what links reach.
OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0),
n AS (SELECT vec_id, label, e, list_inner_product(e, e) AS q FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.q > 0 AND b.q > 0 AND list_inner_product(a.e, b.e) / sqrt(a.q * b.q) >= 0.93
),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS vec_id, min(b) AS m FROM reach GROUP BY 1),
many AS (SELECT a AS vec_id, count(*) AS k FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(k, 0) AS n_links, least(e.vec_id, coalesce(m, e.vec_id)) AS component_id, e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN low USING (vec_id) LEFT JOIN many USING (vec_id)
"""
