"""SimHash near-duplicates: fingerprints of word shingles and a self-join of their binary trie."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinegrid.llm.common import bound_batches, connected_components, discard, grouped_batches, keyed_documents, local_roots, materialize, table
from vinegrid.llm.paragraphs import paragraph_groups
from vinegrid.llm.trie import trie_pairs

BUDGET = 2
SHINGLE = 3
SEED = 42
#: Distinct fingerprints below one node pair that a task takes at once; larger nodes are split further down the trie.
NODE_ROWS = 4096
#: Bits by which a large node is split in one step.
STEP = 6
#: Of the pipeline's stage: words of a shingle and the least Jaccard similarity of near-duplicates.
STAGE_SHINGLE = 5
STAGE_THRESHOLD = 0.8


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is in over half the shingles' hashes; no word gives 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return digest(b" ".join(words), SEED)
    counts, low = np.zeros(64, np.int64), 0
    while low <= len(words) - shingle:
        part = words[low : low + (1 << 16) + shingle - 1]
        hashes = np.array([digest(b" ".join(x), SEED) for x in zip(*(part[k:] for k in range(shingle)))], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        low += 1 << 16
    return int.from_bytes(np.packbits(2 * counts > len(words) - shingle + 1).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)``, fp as signed 64-bit integer; words are split at ASCII white space, A-Z lower-cased, whole texts."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(hashed, "doc_id long, fp long")


def _rotations(budget: int) -> list[tuple[int, int]]:
    """budget + 1 segments (first bit, width) of the 64 bits; two fingerprints within the budget agree on one of them."""
    edges = [64 * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _rotated(fp: Column, first: int) -> Column:
    return fp if not first else F.shiftleft(fp, first).bitwiseOR(F.shiftrightunsigned(fp, 64 - first))


_KEY = ["rot", "depth", "node_a", "node_b"]


def _join_nodes(budget: int, pairs: bool = False):
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped_batches(batches, len(_KEY)):
            rot, depth, node_a, node_b, side, value, rep, spent = (part.column(k).to_numpy() for k in range(8))
            new = np.ones(len(rot) + 1, bool)
            new[1:-1] = (rot[1:] != rot[:-1]) | (depth[1:] != depth[:-1]) | (node_a[1:] != node_a[:-1]) | (node_b[1:] != node_b[:-1])
            edges = np.flatnonzero(new)
            low, high = edges[:-1], edges[1:]
            right = np.concatenate([[0], np.cumsum(side)])
            mid = high - (right[high] - right[low])
            own = node_a[low] == node_b[low]
            a, b = np.stack([low, np.where(own, high, mid)], 1), np.stack([np.where(own, low, mid), high], 1)
            keep = np.where(own, high - low > 1, (low < mid) & (mid < high))
            i, j = trie_pairs(value.view(np.uint64), a[keep], b[keep], depth[low][keep].astype(np.int64), spent[low][keep].astype(np.int64), budget)
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["src", "dst"])
                continue
            root = local_roots(len(rep), i, j)
            linked = np.flatnonzero(root != np.arange(len(rep)))
            yield pa.RecordBatch.from_arrays([pa.array(rep[linked]), pa.array(rep[root[linked]])], names=["src", "dst"])

    return join


def fingerprint_links(reps: DataFrame, budget: int = BUDGET, pairs: bool = False) -> DataFrame:
    """Links that connect all fingerprints within ``budget`` differing bits: ``(src, dst)``.

    ``reps``: written table of distinct fingerprints (fp). Two fingerprints within the budget agree on a whole segment of
    the bits, so the trie is read in budget + 1 rotations, each from the nodes that lie a segment deep; there no bit differs.
    Node pairs are the shuffle key. A node pair with more than NODE_ROWS fingerprints is split STEP bits further down, into
    pairs of children with budget left, as often as needed, so no task gets an unbounded node; nothing is dropped. Each task
    contracts the pairs that it finds to a forest, of at most one link a fingerprint. ``pairs``: the pairs themselves are returned,
    up to budget + 1 times each; a fingerprint has no more than 2,080 others within 2 bits.
    """
    parts = [
        reps.select(F.lit(first).alias("rot"), F.lit(width).alias("depth"), F.shiftrightunsigned(_rotated(F.col("fp"), first), 64 - width).alias("node_a"), _rotated(F.col("fp"), first).alias("value"), F.col("fp").alias("rep"))
        for first, width in _rotations(budget)
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    rows = rows.select("rot", "depth", "node_a", F.col("node_a").alias("node_b"), F.lit(0).alias("side"), "value", "rep", F.lit(0).alias("spent"))
    ready = []
    masks = F.array(*[F.lit(m) for m in range(1 << STEP) if m.bit_count() <= budget])
    while True:
        large = rows.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") > NODE_ROWS).drop("n")
        large = materialize(large.where(f"depth <= {64 - STEP}"), "simhash-large")
        if large.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(large, _KEY, "left_anti"))
        child = F.expr(f"shiftrightunsigned(value, {64 - STEP} - depth) & {(1 << STEP) - 1}")
        split = rows.join(large, _KEY, "left_semi").withColumn("child", child.cast("long")).withColumn("mask", F.explode(masks))
        split = split.withColumn("spent", F.col("spent") + F.expr("bit_count(mask)")).where(F.col("spent") <= budget)
        other = F.expr("child ^ mask")
        own = F.col("node_a") == F.col("node_b")
        left = F.when(own, F.least(F.col("child"), other)).when(F.col("side") == 0, F.col("child")).otherwise(other)
        right = F.when(own, F.greatest(F.col("child"), other)).when(F.col("side") == 0, other).otherwise(F.col("child"))
        rows = materialize(
            split.select(
                "rot", (F.col("depth") + STEP).alias("depth"),
                (F.shiftleft("node_a", STEP) + left).alias("node_a"), (F.shiftleft("node_b", STEP) + right).alias("node_b"),
                F.when(own, (F.col("child") > other).cast("int")).otherwise(F.col("side")).alias("side"), "value", "rep", "spent",
            ),
            "simhash-split",
        )
    rows = ready[0]
    for more in ready[1:]:
        rows = rows.union(more)
    # all values of one side share their first bit, so the signed order is the unsigned one
    dealt = rows.repartition(*_KEY).sortWithinPartitions(*_KEY, "side", "value")
    return dealt.select(*_KEY, "side", "value", "rep", "spent").mapInArrow(_join_nodes(budget, pairs), "src long, dst long")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: ``(doc_id, fp, component_id)``, the smallest doc_id that links of near fingerprints reach.

    Equal fingerprints are one node, so copies never make pairs. Null and empty texts have the fingerprint 0 and are linked
    like any other. Components are made of fingerprints and named last, so a row with a null doc_id links and bridges like any
    other but never names a component, unless no other id is there (then null). Rows that repeat an id are rows of their own.
    """
    fps = materialize(fingerprints(docs, shingle=shingle), "simhash-fp")
    reps = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-reps")
    comps = connected_components(fingerprint_links(reps.select("fp"), budget)).withColumnRenamed("node", "fp")
    classes = reps.join(comps, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("class"))
    names = classes.groupBy("class").agg(F.min("low").alias("component_id"))
    named = materialize(classes.join(names, "class").select("fp", "component_id"), "simhash-classes")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def trie_candidates(texts: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Candidates ``(key_a, par_a, key_b, par_b)`` of distinct texts (key, par), par being their fingerprint.

    All pairs of fingerprints within the budget are found by the self-join of the trie of the whole table; each fingerprint stands
    for its text of the smallest key, and its other texts are candidates beside that one.
    """
    reps = materialize(texts.groupBy("par").agg(F.min("key").alias("key")), "simhash-reps")
    side = lambda x, end: reps.select(F.col("key").alias(f"key_{x}"), F.col("par").alias(end))
    links = fingerprint_links(reps.select(F.col("par").alias("fp")), budget, pairs=True).distinct()
    found = links.join(side("a", "src"), "src").join(side("b", "dst"), "dst").select("key_a", F.col("src").alias("par_a"), "key_b", F.col("dst").alias("par_b"))
    same = texts.join(reps.withColumnRenamed("key", "first"), "par").where("key <> first").select(F.col("first").alias("key_a"), F.col("par").alias("par_a"), F.col("key").alias("key_b"), F.col("par").alias("par_b"))
    a, b = F.struct(F.col("key_a").alias("key"), F.col("par_a").alias("par")), F.struct(F.col("key_b").alias("key"), F.col("par_b").alias("par"))
    ends = found.union(same).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return ends.select(F.col("a.key").alias("key_a"), F.col("a.par").alias("par_a"), F.col("b.key").alias("key_b"), F.col("b.par").alias("par_b"))


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates, the document with the smallest id stays.

    Near-duplicates are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and what such pairs
    link. Candidates come from the self-join of the trie of all texts' fingerprints at operator 6's BUDGET (``trie_candidates``).
    At 0.8 two fingerprints of five-word shingles differ in about 10 bits, at which a trie of the whole corpus prunes next to
    nothing; so texts are also blocked by MinHash bands, and in each block the trie's self-join goes up to TEXT_BUDGET bits.
    Blocks of many texts are compared in tiles, pair by pair. Each candidate is verified by its exact similarity. Texts without
    words are copies of each other.

    Rows are judged by id and text: rows that share an id but not the text are documents of their own, and of rows that repeat
    both one stays, the least by its columns in turn. A null id comes before all others, so of copies its row stays.
    """
    bound_batches(spark)
    keyed = keyed_documents(docs)
    found, _, written = paragraph_groups(keyed.select("_key", "text"), STAGE_THRESHOLD, min_words=0, shingle=STAGE_SHINGLE, whole=True, joined=trie_candidates)
    gone = materialize(found.select(F.col("key").alias("_key")).distinct(), "simhash-gone", release=True)
    discard(*written)
    kept = keyed.join(gone, "_key", "left_anti")
    if not keyed.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        kept = kept.groupBy("_key").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.select(*docs.columns)
