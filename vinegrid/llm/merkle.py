"""Merkle manifest of a dataset: a tree of row digests for each group, and one over the groups; proofs by octopus multiproofs.

Digests are SHA-256 over the concatenated inputs, with digests as lowercase hex text; tables hold them as 32 bytes. A level's
nodes are put together in runs of ``fanout``; a last run may hold fewer, even one, which is hashed, too. The trees are built and
proved in blocks of consecutive leaves, so that no task sees more than ``BLOCK`` of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vinegrid.llm.common import crc32_sql, materialize, table
from vinegrid.llm.ranking import ranked

#: Leaves of a block at most; a block is a power of the fanout.
BLOCK = 4096
#: Number of the tree over the groups' roots.
TOP = -1

c = F.col


class Manifest(NamedTuple):
    """``leaves`` (row columns, leaf, tree, idx, n), ``nodes`` (tree, level, idx, digest; level 0: leaves), ``trees`` (group, tree, n)."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    n_trees: int
    fanout: int


def _hash(digests: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def _block_levels(fanout: int) -> int:
    """Levels of a block's subtree."""
    levels = 1
    while fanout ** (levels + 1) <= BLOCK:
        levels += 1
    return levels


def _height(n: int, fanout: int) -> int:
    height = 0
    while n > 1:
        n, height = -(-n // fanout), height + 1
    return height


def _size(n: int, level: int, fanout: int) -> int:
    """Nodes of a level of a tree with ``n`` leaves."""
    for _ in range(level):
        n = -(-n // fanout)
    return n


def row_digest(columns: Sequence[Column]) -> Column:
    """Digest of a row: each value as ``<UTF-8 bytes>:<value>``, or ``-`` for null, one after the other; integers as decimals."""
    text = [x.cast("string") for x in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in text]), 256))


def _grower(base: int, step: int, fanout: int):
    """Function of a block's nodes of level ``base`` that gives its inner nodes of the next levels."""

    def grown(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        tree, n, first = rows["tree"][0].as_py(), rows["n"][0].as_py(), rows["idx"][0].as_py()
        digests = rows["digest"].to_pylist()
        found: list[tuple] = []
        for level in range(base + 1, min(base + step, _height(n, fanout)) + 1):
            digests, first = [_hash(digests[k : k + fanout]) for k in range(0, len(digests), fanout)], first // fanout
            found.extend((tree, level, first + k, d, n) for k, d in enumerate(digests))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else [[]] * 5, types)], names=["tree", "level", "idx", "digest", "n"])

    return grown


def _forest(leaves: DataFrame, largest: int, fanout: int, tag: str) -> list[DataFrame]:
    """All inner nodes (tree, level, idx, digest) above leaves (tree, idx, n, digest), in tables by rounds of a block's levels."""
    step, rounds, base, low = _block_levels(fanout), [], 0, leaves
    schema = "tree long, level int, idx long, digest binary, n long"
    while _size(largest, base, fanout) > 1:
        block = F.expr(f"idx div {fanout**step}L").alias("block")
        made = materialize(low.select("tree", "idx", "n", "digest", block).groupBy("tree", "block").applyInArrow(_grower(base, step, fanout), schema), tag)
        rounds.append(made.drop("n"))
        base += step
        # a tree that ends at this very level has one node there
        low = made.where((c("level") == base) & (c("n") > F.lit(fanout**base)))
    return rounds


def build(docs: DataFrame, leaf: Column, order: str, group: str, fanout: int = 2, carry: dict[str, Column] | None = None) -> Manifest:
    """Manifest of all rows: a tree for each value of ``group``, leaves by ``order``, and a tree over the trees' roots.

    ``leaf``: the row's digest (``row_digest``), ``carry``: more columns that leaves keep. A null group is one of its own, the
    first; a null order comes first; rows of equal order follow their digests, and equal rows their place. Rows are numbered by
    ranges of (group, order), so neither a group nor a repeated id meets in one task. Only what is named is read, so other
    columns' names can't clash. An empty table has no trees.
    """
    if fanout < 2 or fanout > BLOCK:
        raise ValueError(f"fanout must be from 2 to {BLOCK}")
    # a mark in front keeps null apart, and first
    named = F.coalesce(F.concat(F.lit("1"), c(group).cast("string")), F.lit("0"))
    thin = materialize(docs.select(named.alias("grp"), c(order).alias("key"), leaf.alias("leaf"), *[v.alias(k) for k, v in (carry or {}).items()]), "merkle-leaves")
    placed = ranked(thin, [c("grp"), c("key").asc_nulls_first(), c("leaf")], "merkle-ranked")
    groups = materialize(placed.groupBy("grp").agg(F.min("rank").alias("first"), F.count("*").alias("n")), "merkle-groups")
    trees = materialize(ranked(groups, [c("grp")], "merkle-trees").withColumnRenamed("rank", "tree"), "merkle-trees")
    facts = trees.agg(F.count("*").alias("trees"), F.max("n").alias("largest")).first()
    leaves = materialize(
        placed.join(trees, "grp").select(*[x for x in placed.columns if x not in ("grp", "rank")], "tree", (c("rank") - c("first")).alias("idx"), "n"), "merkle-placed"
    )
    bottom = leaves.select("tree", F.lit(0).alias("level"), "idx", c("leaf").alias("digest"), "n")
    inner = _forest(bottom, facts["largest"] or 0, fanout, "merkle-nodes")
    nodes = bottom.drop("n")
    for made in inner:
        nodes = nodes.union(made)
    top = trees.select("tree", "n", F.expr(_height_sql("n", fanout)).cast("int").alias("level"), F.lit(0).cast("long").alias("idx"))
    roots = nodes.join(top.drop("n"), ["tree", "level", "idx"])
    low = materialize(roots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), c("tree").alias("idx"), "digest", F.lit(facts["trees"]).cast("long").alias("n")), "merkle-roots")
    nodes = nodes.union(low.drop("n"))
    for made in _forest(low, facts["trees"], fanout, "merkle-top"):
        nodes = nodes.union(made)
    group_name = F.when(c("grp") != "0", F.substring("grp", 2, 2147483647)).alias("group")
    return Manifest(leaves, nodes, trees.select(group_name, "tree", "n"), facts["trees"], fanout)


def _height_sql(n: str, fanout: int) -> str:
    """Levels above ``n`` leaves: the number of powers of the fanout, from 1, that are below it."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= fanout
    return f"size(filter(array({', '.join(f'{x}L' for x in powers)}), x -> x < {n}))"


def _missing(known: Sequence[int], n: int, fanout: int) -> list[tuple[int, int]]:
    """Octopus: (level, idx) of the fewest nodes beside these leaves from which the tree's root follows."""
    at, found = sorted(set(known)), []
    for level in range(_height(n, fanout)):
        size, have = _size(n, level, fanout), set(at)
        runs = sorted({k // fanout for k in at})
        found.extend((level, k) for run in runs for k in range(run * fanout, min(run * fanout + fanout, size)) if k not in have)
        at = runs
    return found


class _Tree:
    """Nodes that a block knows of one tree: its leaves, what it fetched, and what follows from them."""

    def __init__(self, n: int, fanout: int, known: dict[tuple[int, int], bytes], leaves: Sequence[int]):
        self.n, self.fanout, self.nodes, self.height = n, fanout, known, _height(n, fanout)
        at = sorted(set(leaves))
        for level in range(self.height):
            at = sorted({k // fanout for k in at})
            for k in at:
                self.nodes[level + 1, k] = _hash([self.nodes[level, i] for i in self.run(level, k)])

    def run(self, level: int, parent: int) -> range:
        return range(parent * self.fanout, min(parent * self.fanout + self.fanout, _size(self.n, level, self.fanout)))

    def path(self, idx: int, digest: bytes) -> tuple[list[bytes], bytes]:
        """Siblings of a leaf, level by level and from left to right, and the root that follows from them and ``digest``."""
        siblings: list[bytes] = []
        for level in range(self.height):
            run = self.run(level, idx // self.fanout)
            others = [self.nodes[level, i] for i in run if i != idx]
            siblings.extend(others)
            here = idx - run.start
            digest, idx = _hash([*others[:here], digest, *others[here:]]), idx // self.fanout
        return siblings, digest


def prove(manifest: Manifest, wanted: DataFrame, claimed: str = "claimed") -> DataFrame:
    """Proofs for leaves of a manifest (tree, idx, n, leaf, ``claimed`` and more columns), any part or all of them.

    Each block of leaves works out the smallest set of nodes that it lacks, up to the root; these coordinates are joined with the
    nodes once, with the two roots; the block derives the shared inner nodes and takes each leaf's own siblings from them. Adds
    ``proof`` (siblings up to the tree's root, then up to the root), ``subroot`` and ``root`` as the manifest has them, and
    ``folded_root``, which follows from ``claimed`` and the siblings. A leaf that is asked for twice gets two rows.
    """
    fanout, n_top = manifest.fanout, manifest.n_trees
    step = _block_levels(fanout)
    asked = wanted.withColumn("block", F.expr(f"idx div {fanout**step}L"))

    def lacking(rows: pa.Table) -> pa.Table:
        tree, block, n = (rows[x][0].as_py() for x in ("tree", "block", "n"))
        own = [*_missing(rows["idx"].to_pylist(), n, fanout), (_height(n, fanout), 0)]
        top = [*_missing([tree], n_top, fanout), (_height(n_top, fanout), 0)]
        found = [(tree, block, tree, *x) for x in own] + [(tree, block, TOP, *x) for x in top]
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), types)], names=["tree", "block", "of", "level", "idx"])

    lacks = asked.select("tree", "block", "idx", "n").groupBy("tree", "block").applyInArrow(lacking, "tree long, block long, of long, level int, idx long")
    nodes = manifest.nodes.withColumnRenamed("tree", "of")
    fetched = lacks.join(nodes, ["of", "level", "idx"]).select("tree", "block", "of", "level", "idx", "digest")
    schema = wanted.drop("leaf", "idx", "n", "tree", claimed).schema
    carried = schema.names
    out = ", ".join(["leaf binary", "proof array<binary>", "subroot binary", "root binary", "folded_root binary"])

    def proved(leaves: pa.Table, found: pa.Table) -> pa.Table:
        tree, n = leaves["tree"][0].as_py(), leaves["n"][0].as_py()
        idx, leaf, claims = leaves["idx"].to_pylist(), leaves["leaf"].to_pylist(), leaves[claimed].to_pylist()
        nodes = {(of, level, k): d for of, level, k, d in zip(*(found[x].to_pylist() for x in ("of", "level", "idx", "digest")))}
        subroot, root = nodes[tree, _height(n, fanout), 0], nodes[TOP, _height(n_top, fanout), 0]
        known = {(level, k): d for (of, level, k), d in nodes.items() if of == tree} | {(0, k): d for k, d in zip(idx, leaf)}
        own = _Tree(n, fanout, known, idx)
        top = _Tree(n_top, fanout, {(level, k): d for (of, level, k), d in nodes.items() if of == TOP} | {(0, tree): own.nodes[own.height, 0]}, [tree])
        proofs, folded = [], []
        for k, claim in zip(idx, claims):
            low, digest = own.path(k, claim)
            high, digest = top.path(tree, digest)
            proofs.append(low + high), folded.append(digest)
        columns = [leaves[x].combine_chunks() for x in carried]
        columns += [pa.array(leaf, pa.binary()), pa.array(proofs, pa.list_(pa.binary())), pa.array([subroot] * len(idx), pa.binary()), pa.array([root] * len(idx), pa.binary()), pa.array(folded, pa.binary())]
        return pa.Table.from_arrays(columns, names=[*carried, "leaf", "proof", "subroot", "root", "folded_root"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema.fields)
    return asked.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(proved, kept + out)


#: Rows whose decimal id's checksum this divides are tampered with.
TAMPER = 7


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = lambda n_chars: row_digest([c("doc_id"), c("source"), c("lang"), n_chars, c("text")])
    tampered = F.pmod(F.crc32(c("doc_id").cast("string").cast("binary")), F.lit(TAMPER)) == 0
    # one more, in decimals that no integer type overflows
    claim = F.when(tampered, own((c("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")))
    manifest = build(docs, own(c("n_chars")), "doc_id", "lang", carry={"claim": claim})
    wanted = manifest.leaves.select(c("key").alias("doc_id"), "leaf", "tree", "idx", "n", F.coalesce("claim", "leaf").alias("claimed"))
    text = lambda x: F.lower(F.hex(x))
    proof = F.sha2(F.array_join(F.transform("proof", text), ""), 256)
    return prove(manifest, wanted).select(
        "doc_id", text(c("leaf")).alias("leaf"), text(c("subroot")).alias("subroot"), text(c("root")).alias("root"), proof.alias("proof_sha256"),
        text(c("folded_root")).alias("folded_root"), (c("folded_root") == c("root")).alias("verified"),
    )


_FIELDS = lambda n: " || ".join(f"coalesce(strlen({x}::VARCHAR) || ':' || {x}, '-')" for x in ("doc_id", "source", "lang", n, "text"))
_FOLD = """{0} AS (
  {1}
  UNION ALL
  SELECT f.id, f.tree, f.level + 1, f.idx // 2, f.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN s.digest IS NULL THEN f.x WHEN f.idx % 2 = 0 THEN f.x || s.digest ELSE s.digest || f.x END)
  FROM {0} f JOIN heights h ON h.tree = f.tree AND f.level < h.height LEFT JOIN nodes s ON s.tree = f.tree AND s.level = f.level AND s.idx = xor(f.idx, 1)
)"""
_GROW = """{0} AS (
  {1}
  UNION ALL
  SELECT tree, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {0}) WHERE n > 1 GROUP BY tree, level, idx // 2
)"""

OP13_SQL = f"""
WITH RECURSIVE {crc32_sql("SELECT DISTINCT doc_id::VARCHAR AS w FROM documents WHERE doc_id IS NOT NULL")},
rows_ AS (
  SELECT row_number() OVER () AS id, doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, lang,
    sha256({_FIELDS("n_chars")}) AS leaf, sha256({_FIELDS("(n_chars + 1)")}) AS changed, crc % {TAMPER} = 0 AS tampered
  FROM documents LEFT JOIN crc ON w = doc_id::VARCHAR
),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM rows_),
{_GROW.format("low", "SELECT tree::BIGINT AS tree, 0 AS level, idx::BIGINT AS idx, leaf AS digest FROM leaves")},
subroots AS (SELECT tree, max(level) AS height, arg_max(digest, level) AS subroot FROM low GROUP BY tree),
{_GROW.format("high", "SELECT -1::BIGINT AS tree, 0 AS level, tree AS idx, subroot AS digest FROM subroots")},
nodes AS (SELECT * FROM low UNION ALL SELECT * FROM high),
heights AS (SELECT tree, max(level) AS height FROM nodes GROUP BY tree),
{_FOLD.format("own", "SELECT id, tree::BIGINT AS tree, 0 AS level, idx::BIGINT AS idx, '' AS proof, CASE WHEN tampered THEN changed ELSE leaf END AS x FROM leaves")},
{_FOLD.format("top", "SELECT o.id, -1::BIGINT AS tree, 0 AS level, o.tree AS idx, o.proof, o.x FROM own o JOIN heights h ON h.tree = o.tree AND h.height = o.level")},
root AS (SELECT arg_max(digest, level) AS root FROM high)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified
FROM leaves JOIN subroots USING (tree) JOIN (SELECT t.id, t.proof, t.x FROM top t JOIN heights h ON h.tree = t.tree AND h.height = t.level) USING (id), root
"""
