"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star edges.

A document's set is that of its distinct word shingles. Equal sets become one node first, so that a group of
copies costs one row. Each node's signature has one smallest hash per bin; an empty bin copies a bin that a hash
of its number and the attempt picks, so that two sets agree in a bin with the probability of their similarity.
Nodes with an equal band share a bucket. In each bucket, nodes are compared with its smallest set (a star), those outside its
largest component with a few of it, and a bounded number of those left with all; other members meet again by what this hub lacks (see linked), until no
bucket holds two components that could be one. Links are confirmed on the full sets. Pairs grow with the members of buckets.
The first FIRST bands go before the others, of which only those buckets are looked at that still hold several components.

The default bands find a pair of similarity 0.8 with probability 0.99994.

Cases: a null or empty text, or one of white space, has an empty set and is linked with nothing; a text with fewer
words than a shingle is one shingle of all its words; repeated rows and equal texts are one component; rows without
doc_id take part in no link; an empty table gives an empty result; other columns are kept by deduplicated() and
ignored elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resistrum.llm.common import BROADCAST_ROWS, dealt_join, dropped, if_small, narrow_join, written
from resistrum.llm.components import components

BANDS, ROWS = 32, 6
FIRST = 8
#: Texts at a time within a task, and words whose hashes a task remembers.
SLICE, REMEMBERED = 200, 300_000
#: So many members of a bucket outside its largest component are compared with all others.
SMALL = 64
#: If the pairs of these would be more than PROBED, they are compared with PROBES members of the largest component before.
PROBES, PROBED = 4, 100_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Sketcher:
    """Shingle sets and band keys of texts."""

    def __init__(self, shingle: int, bands: int = BANDS, rows: int = ROWS):
        self.shingle, self.bands, self.rows, self.bins = shingle, bands, rows, bands * rows
        self.hashes = _WordHashes()
        self.bounds = np.array([-(-(i << 64) // self.bins) for i in range(self.bins)], dtype=np.uint64)
        tries = np.arange(64 * self.bins, dtype=np.uint64).reshape(64, self.bins)
        self.donors = (mixed_bits(tries * _M1 + _M2) % np.uint64(self.bins)).astype(np.int64)
        self.turns = mixed_bits(np.arange(1, rows + 1, dtype=np.uint64) * _M1) | np.uint64(1)
        self.band_turns = mixed_bits(np.arange(1, bands + 1, dtype=np.uint64) * _M2)

    def set_of(self, text: str | None) -> np.ndarray:
        """The sorted 64-bit hashes of the distinct shingles."""
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        h = np.array(list(map(self.hashes.__getitem__, words)), dtype=np.uint64)
        n = min(self.shingle, len(h))
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            out = mixed_bits(out * _M1 + h[k : len(h) - n + 1 + k] * _M3 + _M2)
        return np.unique(out)

    def band_keys(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(hashes, self.bounds)
        ends = np.append(at[1:], len(hashes))
        filled = at < ends
        sig = hashes[np.minimum(at, len(hashes) - 1)]
        empty, first = np.flatnonzero(~filled), 0
        while len(empty):
            donors = self.donors if not first else (mixed_bits((np.arange(64 * self.bins, dtype=np.uint64).reshape(64, self.bins) + np.uint64(first)) * _M1 + _M2) % np.uint64(self.bins)).astype(np.int64)
            picks = donors[:, empty]
            good = filled[picks]
            which = good.argmax(axis=0)
            done = good.any(axis=0)
            sig[empty[done]] = sig[picks[which[done], np.flatnonzero(done)]]
            empty, first = empty[~done], first + 64 * self.bins
        return mixed_bits((sig.reshape(self.bands, self.rows) * self.turns).sum(axis=1, dtype=np.uint64) + self.band_turns)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list]]:
    for b in batches:
        for k in range(0, b.num_rows, SLICE):
            part = b.slice(k, SLICE)
            yield part.column(0), part.column(1).to_pylist()


def sketches(docs: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_id (a digest of the set; null if it is empty) and keys (of its bands)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sketcher(shingle, bands, rows)
        for ids, texts in _slices(batches):
            sets = [s.set_of(t) for t in texts]
            yield pa.record_batch([
                ids, pa.array([len(x) for x in sets], pa.int64()),
                pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets], pa.binary()),
                pa.array([s.band_keys(x).view(np.int64) if len(x) else None for x in sets], pa.list_(pa.int64())),
            ], names=["doc_id", "n_shingles", "set_id", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, keys array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """The full set of shingle hashes of each doc_id, as (node, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Sketcher(shingle)
        for ids, texts in _slices(batches):
            yield pa.record_batch([ids, pa.array([s.set_of(t).view(np.int64) for t in texts], pa.list_(pa.int64()))], names=["node", "set"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "node long, set array<long>")


def common_members(x: str, y: str) -> Column:
    return F.size(F.array_intersect(x, y))


def similar(pairs: DataFrame, sets: DataFrame, percent: int, n_shared: Callable[[str, str], Column] = common_members) -> DataFrame:
    """Those pairs (hub, node, with the sizes hub_n and n) whose sets have 100 * intersection >= percent * union; written.

    sets has a row (node, set) per node; n_shared counts what two sets share. Pairs of too different sizes are not looked at.
    """
    alike = written(pairs.where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")).select("hub", "node", "hub_n", "n").distinct(), "pairs")
    both = _with_sets(alike, sets).withColumn("_shared", n_shared("_x", "_y"))
    found = written(both.where((100 + percent) * F.col("_shared") >= percent * (F.col("n") + F.col("hub_n"))).select("hub", "node"), "links")
    dropped(alike)
    return found


def _with_sets(pairs: DataFrame, sets: DataFrame, other: str | None = None) -> DataFrame:
    """pairs (written) with the sets _x of hub and _y of node, and _z of other, of which each hub has one."""
    few = pairs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = F.broadcast if few else lambda df: df
    members = small(pairs).join(sets.select("node", F.col("set").alias("_y")), "node")
    counts = pairs.groupBy("hub").agg(F.count("*").alias("_n"))
    hubs = pairs.select("hub", *([other] if other else [])).distinct()
    of_hubs = small(hubs).join(sets.select(F.col("node").alias("hub"), F.col("set").alias("_x")), "hub")
    if other:
        of_hubs = small(hubs).join(sets.select(F.col("node").alias(other), F.col("set").alias("_z")), other).select("hub", "_z").join(of_hubs, "hub")
    return dealt_join(members, of_hubs.drop(*([other] if other else [])), ["hub"], F.xxhash64("node"), counts)


def in_shared_buckets(placed: DataFrame, by: str = "node") -> DataFrame:
    """The distinct rows (key, node and more) of placed whose key rows of another node (or label) have too; written."""
    buckets = placed.groupBy("key").agg(F.min(by).alias("_low"), F.max(by).alias("_high"), F.count("*").alias("_n"))
    shared = written(buckets.where("_low < _high").select("key", "_n"), "shared")
    if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        met = placed.join(F.broadcast(shared.select("key")), "key")
    else:
        met = dealt_join(placed, shared.select("key"), ["key"], F.xxhash64("node"), shared)
    active = written(met.select("key", *[c for c in placed.columns if c != "key"]).distinct(), "members")
    dropped(shared)
    return active


def _rest(percent: int, as_set: Callable[[str], Column]) -> Column:
    """Of a node's set _y, those members that its hub's set _x lacks of which it shares one with each similar node in another component.

    A node similar to this one has at least percent % of its size, and as many as the hub; so they share at least `need`
    members, of which the hub can have no more than it shares with this node. Members that another node of the group
    (_z) has too come last, as they tell less; any order common to a group loses nothing.
    """
    need = F.ceil(F.lit(percent) * (F.col("n") + F.greatest(F.col("hub_n"), F.ceil(F.col("n") * percent / 100))) / (100 + percent))
    long = lambda r: F.size(r) + 1 - F.greatest(F.lit(1), need - F.col("n") + F.size(r)).cast("int")
    ordered = lambda r, z: F.concat(F.array_sort(F.array_except(r, z)), F.array_sort(F.array_intersect(r, z)))
    lacks = F.array(F.struct(F.array_except(as_set("_y"), as_set("_x")).alias("r"), as_set("_z").alias("z")))
    return F.transform(lacks, lambda p: F.slice(ordered(p["r"], p["z"]), F.lit(1), long(p["r"])))[0]


def _outside(members: DataFrame, label: str) -> DataFrame:
    """For each key with several labels: its rows (_n), its most frequent label (_most), and how many rows have another (_out)."""
    sizes = members.groupBy("key", F.col(label).alias("_label")).agg(F.count("*").alias("_c"))
    found = sizes.groupBy("key").agg(F.sum("_c").alias("_n"), F.max(F.struct("_c", "_label")).alias("_m"))
    return found.select("key", "_n", F.col("_m._label").alias("_most"), (F.col("_n") - F.col("_m._c")).alias("_out")).where("_out > 0")


def linked(active: DataFrame, sets: DataFrame, percent: int, as_set: Callable[[str], Column] = F.col, n_shared: Callable[[str, str], Column] = common_members, labels: DataFrame | None = None) -> DataFrame:
    """The components (id, component), written, of nodes that similar ones join, if they share a bucket.

    active has a row (key, node, n) for each bucket of a node, n the size of its set; as_set turns a row's set into an
    array. labels are the components of an earlier call, which go on in this one and are deleted; active then has the
    node's as label. A bucket's hub is its smallest set, and all members in another component are compared with it. The
    links of all buckets make components before anything else is compared, as what one hub is not similar to is mostly
    joined by that of another bucket; where many pairs would be left, a few other members of the bucket's largest component
    are asked too, of which one is mostly similar. If then at most SMALL members are outside the bucket's largest component, these are
    compared with all others. So pairs grow with members. In a bucket with more of them, two members of which one isn't
    similar to the hub can be similar only if they share a member of their sets that the hub lacks, as the hub is not
    larger than either. These, by hub, are the next round's buckets. No pair is lost, and a round's buckets lack the hub of
    the one before. A round joins its links to the components so far, a star for each.
    """
    active = written(active if labels is not None else active.withColumn("label", F.col("node")), "members")
    while True:
        hubs = written(active.groupBy("key").agg(F.min(F.struct("n", "node", "label")).alias("h"), F.count("*").alias("_n")).select("key", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.label").alias("hub_label"), "_n"), "hubs")
        met = written(narrow_join(active, hubs, ["key"], F.xxhash64("node"), hubs.select("key", "_n")).where("node <> hub"), "met")
        near = similar(met.where("label <> hub_label"), sets, percent, n_shared)
        labels = _joined(near, labels)
        left = _labelled(met.select("key", "hub", "hub_n", "node", "n"), labels)
        mixed = written(_outside(left, "label"), "mixed")
        for done in (active, hubs, met, near):
            dropped(done)
        if (mixed.agg(F.sum(F.col("_n") * F.col("_out"))).first()[0] or 0) > PROBED:
            asked = left.select("key", "node", "n", "label").join(if_small(mixed.select("key", "_most")), "key")
            picks = [F.min(F.when(F.col("label") == F.col("_most"), F.struct(F.xxhash64("node", F.lit(j)).alias("h"), "node", "n"))).alias(f"_p{j}") for j in range(PROBES)]
            probes = written(asked.groupBy("key", "_most").agg(F.array(*picks).alias("_probes")), "probes")
            pairs = narrow_join(left, probes, ["key"], F.xxhash64("node"), mixed.select("key", "_n")).where("label <> _most").select("node", "n", F.explode(F.array_distinct("_probes")).alias("o"))
            near = similar(pairs.select(F.col("o.node").alias("hub"), F.col("o.n").alias("hub_n"), "node", "n"), sets, percent, n_shared)
            labels = _joined(near, labels)
            before, left = left, _labelled(left.drop("label"), labels)
            for done in (before, mixed, probes, near):
                dropped(done)
            mixed = written(_outside(left, "label"), "mixed")
        few, wide = mixed.where(F.col("_out") <= SMALL), mixed.where(F.col("_out") > SMALL)
        if not few.isEmpty():
            # at most SMALL rows of a key are collected
            out = narrow_join(left, few.select("key", "_most"), ["key"], F.xxhash64("node"), few.select("key", "_n")).where("label <> _most")
            out = written(out.groupBy("key", "_most").agg(F.collect_list(F.struct("node", "n", "label")).alias("_others")), "out")
            pairs = narrow_join(left, out, ["key"], F.xxhash64("node"), few.select("key", "_n")).select("node", "n", "label", "_most", F.explode("_others").alias("o"))
            pairs = pairs.where("label <> o.label AND (label = _most OR node > o.node)").select(F.col("o.node").alias("hub"), F.col("o.n").alias("hub_n"), "node", "n")
            rest = similar(pairs, sets, percent, n_shared)
            labels = _joined(rest, labels)
            for done in (out, rest):
                dropped(done)
        if wide.isEmpty():
            for done in (left, mixed):
                dropped(done)
            return labels
        plain = written(narrow_join(left, wide.select("key"), ["key"], F.xxhash64("node"), wide.select("key", "_n")).select("hub", "hub_n", "node", "n").distinct(), "open")
        members = _labelled(plain, labels)
        other = F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("other")
        refs = written(members.groupBy("hub").agg(other, F.count("*").alias("_n")), "refs")
        with_other = written(narrow_join(members, refs.select("hub", "other"), ["hub"], F.xxhash64("node"), refs.select("hub", "_n")), "open")
        lacks = _with_sets(with_other, sets, "other").select("hub", "node", "n", "label", F.explode(_rest(percent, as_set)).alias("_member"))
        placed = written(lacks.select(F.xxhash64("hub", "_member").alias("key"), "node", "n", "label"), "placed")
        buckets = written(placed.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"), F.count("*").alias("_n")).where("_low < _high").select("key", "_n"), "shared")
        active = written(narrow_join(placed, buckets.select("key"), ["key"], F.xxhash64("node"), buckets).select("key", "node", "n", "label").distinct(), "members")
        for done in (left, mixed, plain, members, refs, with_other, placed, buckets):
            dropped(done)


def _joined(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """labels (deleted) after links (hub, node) have joined their components."""
    found = components((links if labels is None else links.union(labels)).toDF("a", "b"))
    if labels is not None:
        dropped(labels)
    return found


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (read from a written table) with the component of node as label; written."""
    counts = rows.groupBy("node").agg(F.count("*").alias("_n"))
    return written(narrow_join(rows, labels.toDF("node", "label"), ["node"], F.xxhash64("hub"), counts, "left").withColumn("label", F.coalesce("label", "node")), "labelled")


def classes(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) for each row of docs."""
    sketched = written(sketches(docs, shingle, bands, rows), "sketches")
    nodes = written(sketched.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.count("*").alias("_n")), "nodes")
    known = nodes.where("node IS NOT NULL")
    labels = None
    for bands_of in (F.slice("keys", 1, FIRST), F.slice("keys", FIRST + 1, max(bands - FIRST, 1))):
        named = known.withColumn("label", F.col("node")) if labels is None else known.join(if_small(labels.toDF("node", "label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
        active = in_shared_buckets(named.select("node", "n", "label", F.explode(bands_of).alias("key")), "label")
        ids = written(active.select(F.col("node").alias("doc_id")).distinct(), "ids")
        sets = written(shingle_sets(docs.select("doc_id", "text").join(if_small(ids), "doc_id"), shingle), "sets")
        labels = linked(active, sets, percent, labels=labels)
        for done in (active, ids, sets):
            dropped(done)
    nodes_of = nodes.join(labels.toDF("node", "component"), "node", "left")
    # all other sets have one row, which is its own component
    named = written(nodes_of.where("_n > 1 OR component <> node").select("set_id", F.coalesce("component", "node").alias("component"), "_n"), "named")
    for done in (labels, nodes):
        dropped(done)
    found = dealt_join(sketched, named.drop("_n"), ["set_id"], F.xxhash64("doc_id"), named.select("set_id", "_n"), "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each class, that of the smallest doc_id; of rows with that doc_id, one.

    Documents without words and rows without doc_id stay.
    """
    found = written(classes(docs, shingle, percent), "classes")
    gone = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    again = written(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    stay = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if again.isEmpty():
        return stay
    return stay.join(again, "doc_id", "left_anti").select(*docs.columns).union(stay.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))
