"""A Merkle tree over the rows of a dataset, with a proof for each row: superblocks of several levels at a time.

A row's leaf is the SHA-256 of its fields. The leaves of a tree stand in order of their keys; FANOUT consecutive
digests become the digest of their concatenated hex texts, until one is left. The trees' roots, in order of the trees,
become the root of the dataset in the same way.

Digests are numbered in their tree and put into superblocks of FANOUT ** LEVELS consecutive ones. One task collapses
a superblock by LEVELS levels at once and returns one row with all digests of its subtree (collapsed). The roots of the
superblocks are the leaves of the next step. A proof is that part which lies within the row's superblock, followed by the
proof of the superblock's root; so the proofs of upper levels are joined to superblocks, never to rows, and the proofs
of rows are made where they are used, from one superblock at a time.

Cases: a null field counts as `-`, which no value is written as; null trees come first and null keys before all others;
rows of equal keys are in order of their leaves, so repeated rows stand side by side and each has its own proof; a tree
of one row has its leaf as root and an empty proof; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resistrum.llm.common import lookup_join, numbered, written

FANOUT, LEVELS = 8, 3
#: A level of a proof: the place among the run's digests, and the hex texts of the others.
PROOF = "array<struct<place: int, siblings: string>>"
_HEX = 64


def digest(*fields: Column) -> Column:
    """The SHA-256 of fields: each `-` if null, else its number of bytes, `:` and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _collapse(leaves: list[str], levels: int, fanout: int) -> list[list[str]]:
    out = [leaves]
    for _ in range(levels):
        low = out[-1]
        out.append([hashlib.sha256("".join(low[k : k + fanout]).encode()).hexdigest() for k in range(0, len(low), fanout)])
    return out


def _path(tree: list[list[str]], at: int, fanout: int) -> list[dict]:
    """The levels of the proof of leaf `at` that lie within its superblock."""
    out = []
    for row in tree[:-1]:
        run = row[at - at % fanout : at - at % fanout + fanout]
        out.append({"place": at % fanout, "siblings": "".join(run[: at % fanout] + run[at % fanout + 1 :])})
        at //= fanout
    return out


def collapsed(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """A row per superblock of nodes (tree_no, place, depth, leaf, claim, key), depth being the levels above them in their tree.

    Returns tree_no, block, depth (above the superblock's root), root, keys, claims, and digests with sizes (of each level, leaves
    first). A superblock has at most fanout ** levels nodes, so a group's size doesn't grow with the data.
    """
    size = fanout**levels

    def collapse(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place")
        up = min(levels, int(group["depth"].iloc[0]))
        tree = _collapse(group["leaf"].tolist(), up, fanout)
        packed = {"tree_no": group["tree_no"].iloc[0], "block": group["place"].iloc[0] // size, "depth": group["depth"].iloc[0] - up, "root": tree[-1][0]}
        keys = [None if pd.isna(k) else int(k) for k in group["key"]]
        return pd.DataFrame([packed | {"keys": keys, "claims": group["claim"].tolist(), "digests": bytes.fromhex("".join("".join(x) for x in tree)), "sizes": [len(x) for x in tree]}])

    schema = "tree_no long, block long, depth int, root string, keys array<long>, claims array<string>, digests binary, sizes array<int>"
    return nodes.withColumn("block", F.expr(f"place div {size}")).groupBy("tree_no", "block").applyInPandas(collapse, schema)


def _unpacked(digests: bytes, sizes: list[int]) -> list[list[str]]:
    text, at, out = digests.hex(), 0, []
    for n in sizes:
        out.append([text[k : k + _HEX] for k in range(at, at + n * _HEX, _HEX)])
        at += n * _HEX
    return out


def _proved(blocks: DataFrame, fanout: int) -> DataFrame:
    """tree_no, place, key, leaf, claim and proof of each leaf of blocks, which have the proofs of their roots as upper."""

    def unfold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame.itertuples(index=False):
                tree, upper = _unpacked(b.digests, list(b.sizes)), [{"place": int(p["place"]), "siblings": p["siblings"]} for p in b.upper]
                n = len(tree[0])
                yield pd.DataFrame({
                    "tree_no": b.tree_no, "place": b.first + np.arange(n), "key": pd.array([None if pd.isna(k) else int(k) for k in b.keys], dtype="Int64"), "leaf": tree[0], "claim": list(b.claims), "proof": [_path(tree, k, fanout) + upper for k in range(n)]
                })

    return blocks.select("tree_no", "first", "keys", "claims", "digests", "sizes", "upper").mapInPandas(unfold, f"tree_no long, place long, key long, leaf string, claim string, proof {PROOF}")


def _depth(count: Column, fanout: int) -> Column:
    """The levels above `count` leaves: the digits of count - 1 to the base of the fanout."""
    top = 0
    while fanout**top < 1 << 62:
        top += 1
    found = F.lit(0)
    for k in range(top):
        found = F.when(count > F.lit(fanout**k), k + 1).otherwise(found)
    return found.cast("int")


def proved(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Of nodes (tree_no, place, depth, leaf, claim, key): the trees' roots (tree_no, root), and each leaf's row with its proof up to that root."""
    blocks = written(collapsed(nodes, fanout, levels), "superblocks")
    sized = blocks.withColumn("first", F.col("block") * fanout**levels)
    tops = blocks.where("depth = 0").select("tree_no", "root")
    rest = blocks.where("depth > 0").select("tree_no", F.col("block").alias("place"), "depth", F.col("root").alias("leaf"), F.lit(None).cast("string").alias("claim"), F.lit(None).cast("long").alias("key"))
    whole = _proved(sized.where("depth = 0").withColumn("upper", F.array().cast(PROOF)), fanout)
    if rest.isEmpty():
        return tops, whole
    roots, upper = proved(rest, fanout, levels)
    parts = sized.where("depth > 0").join(upper.select("tree_no", F.col("place").alias("block"), F.col("proof").alias("upper")), ["tree_no", "block"])
    return tops.union(roots), whole.union(_proved(parts, fanout))


def manifest(rows: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """For each of rows (key, tree, leaf, claim): key, tree, leaf, claim, subroot, root and proof.

    claim is a digest to be held against the proof of leaf (see folded), such as that of a later copy of the row. proof
    leads from leaf to its tree's subroot and on to the root of all trees.
    """
    leaves = written(rows.select(F.col("key").cast("long").alias("key"), "tree", "leaf", "claim"), "leaves")
    nodes = numbered(leaves.withColumn("_row", F.monotonically_increasing_id()), [F.col("tree").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("_row")], "_at").drop("_row")
    trees = numbered(nodes.groupBy("tree").agg(F.min("_at").alias("_first"), F.count("*").alias("_count")), [F.col("tree").asc_nulls_first()], "tree_no")
    trees = written(trees, "trees")
    n_trees = trees.count()
    placed = lookup_join(nodes, trees, "tree", F.xxhash64("_at"))
    roots, lower = proved(placed.select("tree_no", (F.col("_at") - F.col("_first")).alias("place"), _depth(F.col("_count"), fanout).alias("depth"), "leaf", "claim", "key"), fanout, levels)
    roots = written(roots, "subroots")
    one_tree = roots.select(F.lit(0).cast("long").alias("tree_no"), F.col("tree_no").alias("place"), _depth(F.lit(n_trees), fanout).alias("depth"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("claim"), F.lit(None).cast("long").alias("key"))
    root, upper = proved(one_tree, fanout, levels)
    top = root.head()  # one row, or none of an empty table
    named = trees.select("tree_no", "tree").join(upper.select(F.col("place").alias("tree_no"), F.col("leaf").alias("subroot"), F.col("proof").alias("_upper")), "tree_no").withColumn("root", F.lit(top and top.root).cast("string"))
    found = lookup_join(lower, written(named, "tops"), "tree_no", F.xxhash64("place"))
    return found.select("key", "tree", "leaf", "claim", "subroot", "root", F.concat("proof", "_upper").alias("proof"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that leaf and the siblings of a proof lead to."""
    return F.aggregate(proof, leaf, lambda d, p: F.sha2(F.concat(F.substr(p["siblings"], F.lit(1), p["place"] * _HEX), d, F.substr(p["siblings"], p["place"] * _HEX + 1)), 256))


def proof_digest(proof: Column) -> Column:
    """The SHA-256 of all siblings of a proof, upwards."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: p["siblings"]), ""), 256)
