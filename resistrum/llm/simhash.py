"""SimHash near-duplicates: fingerprints of word shingles, linked by way of the anchors of a covering code.

A fingerprint has a bit where more than half of the text's shingle hashes have it. The anchors are the words of a
covering code: the binary Golay code over 23 bits, of which every bit pattern has exactly one word within 3 bits, or the
product of two of them over 46 bits (within 6). A fingerprint's home is the anchor within the code's radius, and it is
copied to every anchor within radius plus threshold. Two fingerprints that differ in at most `threshold` bits therefore
meet at the home of either, and there all homes are compared with all copies on their 64 bits, in blocks. The bits
that the code doesn't look at only take part in this comparison. Nothing is left to chance: no link is lost.

Equal fingerprints become one node first. A product of two codes makes 341 copies where one code makes 71, but has
4,096 times as many anchors; `anchor_bits` picks it beyond ONE_CODE fingerprints, so that groups stay small. Results
are the same. An anchor of more than CELL homes or copies is dealt over cells of its comparison matrix, a task each.
What an anchor finds leaves it as stars, one edge for each linked fingerprint, never as all pairs of a group.

Cases: a text without words, empty or null, has fingerprint zero and is linked like any other; one with fewer words than
a shingle is one shingle of all its words; repeated rows and equal texts are one component; rows without doc_id get a
fingerprint, take part in no link and have no component; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resistrum.llm.common import dealt_join, lookup_join, written
from resistrum.llm.components import components

SHINGLE, THRESHOLD, SEED = 3, 3, 42
#: The generator polynomial of the binary Golay code, the length of its words, and their radius: fixed values.
GOLAY, LENGTH, RADIUS = 0b110001110101, 23, 3
#: Beyond so many different fingerprints the anchors are those of a product of two codes.
ONE_CODE = 4_000_000
#: Most homes and copies of an anchor that one task compares; fingerprints compared at a time; hashes and rows at a time.
CELL, BLOCK, SLICE, ROWS = 1_000_000, 256, 1 << 16, 4096


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64 bits of a text, as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = min(shingle, len(words))
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(begins[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in spans), dtype=np.uint64, count=len(words) - n + 1)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), SLICE):
        bits = np.unpackbits(hashes[k : k + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint (64 bits as a long) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(found.view(np.int64), pa.int64())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint long")


@cache
def _syndromes() -> np.ndarray:
    """The remainder of each pattern of 23 bits by the generator: patterns with equal ones differ by a word of the code."""
    left = np.arange(1 << LENGTH, dtype=np.int32)
    for bit in range(LENGTH - 1, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GOLAY << (bit - 11)), left)
    return left.astype(np.int16)


@cache
def _steps(most: int) -> list[list[np.ndarray]]:
    """By syndrome and weight (up to most): the patterns that lead from a vector of that syndrome to a word of the code."""
    weights = np.bitwise_count(np.arange(1 << LENGTH, dtype=np.int32))
    light = np.flatnonzero(weights <= most).astype(np.int32)
    light = light[np.lexsort((weights[light], _syndromes()[light]))]
    keys = _syndromes()[light].astype(np.int64) * (most + 1) + weights[light]
    bounds = np.searchsorted(keys, np.arange(2048 * (most + 1) + 1))
    return [[light[bounds[s * (most + 1) + w] : bounds[s * (most + 1) + w + 1]] for w in range(most + 1)] for s in range(2048)]


def anchors(print_: int, codes: int = 1, threshold: int = THRESHOLD) -> tuple[int, np.ndarray]:
    """The home of a fingerprint, and all anchors within radius plus threshold (the home too). An anchor is a number of 12 bits a code."""
    reach = codes * RADIUS + threshold
    steps = _steps(reach)
    found = {0: np.zeros(1, dtype=np.int64)}  # by distance
    home = 0
    for k in range(codes):
        part = print_ >> (LENGTH * k) & ((1 << LENGTH) - 1)
        words = [(part ^ x) >> 11 for x in steps[int(_syndromes()[part])]]  # the leading 12 bits tell words apart
        home = home << 12 | int(next(w for w in words[: RADIUS + 1] if len(w))[0])
        both: dict[int, list[np.ndarray]] = {}
        for d, xs in found.items():
            for w, ys in enumerate(words[: reach - d + 1]):
                if len(ys):
                    both.setdefault(d + w, []).append((xs[:, None] << 12 | ys[None, :].astype(np.int64)).ravel())
        found = {d: np.concatenate(x) for d, x in both.items()}
    return home, np.concatenate(list(found.values()))


def copies(nodes: DataFrame, codes: int = 1, threshold: int = THRESHOLD) -> DataFrame:
    """anchor, near and home (packed fingerprints), n_near and n_home: what nodes (fingerprint) send to each anchor, gathered by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                prints = b.column(0).slice(k, ROWS).to_numpy(zero_copy_only=False)
                to = [anchors(p, codes, threshold) for p in prints.tolist()]
                homes, near = np.array([h for h, _ in to], dtype=np.int64), np.concatenate([x for _, x in to])
                sent = np.repeat(prints, [len(x) for _, x in to])
                every, at = np.unique(near, return_inverse=True)
                sent = sent[np.argsort(at, kind="stable")]
                ends = np.cumsum(np.bincount(at, minlength=len(every)))
                order = np.argsort(homes, kind="stable")
                lows, highs = np.searchsorted(homes[order], every), np.searchsorted(homes[order], every, side="right")
                own, begins = prints[order], np.concatenate([[0], ends[:-1]])
                yield pa.record_batch([
                    pa.array(every, pa.int64()), pa.array([sent[a:z].tobytes() for a, z in zip(begins, ends, strict=True)], pa.binary()), pa.array([own[a:z].tobytes() for a, z in zip(lows, highs, strict=True)], pa.binary()),
                    pa.array(ends - begins, pa.int64()), pa.array(highs - lows, pa.int64()),
                ], names=["anchor", "near", "home", "n_near", "n_home"])

    return nodes.select("fingerprint").mapInArrow(run, "anchor long, near binary, home binary, n_near long, n_home long")


def _stars(homes: np.ndarray, near: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that join what the links (home < near) between homes and near join: one for each fingerprint but the least."""
    homes, near = np.unique(homes), np.unique(near)
    ends: list[np.ndarray] = []
    for k in range(0, len(homes), BLOCK):
        h = homes[k : k + BLOCK]
        for j in range(0, len(near), 64 * BLOCK):
            m = near[j : j + 64 * BLOCK]
            met = np.bitwise_count((h[:, None] ^ m[None, :]).view(np.uint64)) <= threshold  # of a signed number it counts its absolute value
            met &= h[:, None] < m[None, :]
            linked = np.flatnonzero(met.any(axis=0))
            if not len(linked):
                continue
            met = met[:, linked]
            first = met.argmax(axis=0)  # of each near one, its least home here
            ends.append(np.stack([h[first], m[linked]], axis=1))
            joint = np.zeros((len(h), len(h)), dtype=bool)  # homes of one near fingerprint
            at, of = np.nonzero(met)
            joint[at, first[of]] = True
            a, b = np.nonzero(joint)
            ends.append(np.stack([h[b], h[a]], axis=1)[a != b])
    if not ends:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    known, pairs = np.unique(np.concatenate(ends), return_inverse=True)
    pairs, least = pairs.reshape(-1, 2), np.arange(len(known))
    while True:
        low = np.minimum(least[pairs[:, 0]], least[pairs[:, 1]])
        after = least.copy()
        for side in (least[pairs[:, 0]], least[pairs[:, 1]], pairs[:, 0], pairs[:, 1]):
            np.minimum.at(after, side, low)
        after = after[after]
        if (after == least).all():
            break
        least = after
    moved = np.flatnonzero(least != np.arange(len(known)))
    return known[moved], known[least[moved]]


def links(nodes: DataFrame, codes: int = 1, threshold: int = THRESHOLD, cell: int = CELL) -> DataFrame:
    """Edges (a, b) of fingerprints that join the same components as all pairs of nodes (fingerprint, distinct) within threshold bits."""
    if not 0 <= threshold <= RADIUS or codes not in (1, 2):
        raise ValueError("one or two codes, and a threshold of at most 3")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        homes, near = (np.frombuffer(b"".join(x for x in group[c] if x), dtype=np.int64) for c in ("home", "near"))
        a, b = _stars(homes, near, threshold)
        return pd.DataFrame({"a": a, "b": b})

    sent = written(copies(nodes, codes, threshold), "copies")
    sums = sent.groupBy("anchor").agg(F.sum("n_home").alias("_homes"), F.sum("n_near").alias("_near"))
    parts = written(sums.where("_homes > 0 AND _near > 1").select("anchor", F.ceil(F.greatest("_homes", "_near") / cell).cast("int").alias("_parts")), "parts")
    chunk = F.xxhash64("near", "home")
    met = lookup_join(sent, parts, "anchor", chunk)
    own, every = F.pmod(chunk, F.col("_parts")).cast("int"), F.sequence(F.lit(0), F.col("_parts") - 1)
    none = F.lit(None).cast("binary")
    single = met.where("_parts = 1").select("anchor", F.lit(0).alias("row"), F.lit(0).alias("col"), "home", "near")
    dealt = met.where("_parts > 1")
    rows = dealt.where("n_home > 0").select("anchor", own.alias("row"), F.explode(every).alias("col"), "home", none.alias("near"))
    cols = dealt.select("anchor", F.explode(every).alias("row"), own.alias("col"), none.alias("home"), "near")
    return single.union(rows).union(cols).groupBy("anchor", "row", "col").applyInPandas(compare, "a long, b long")


def classes(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, seed: int = SEED, one_code: int = ONE_CODE, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (a long) and component_id (the smallest doc_id that links lead to) for each row of docs."""
    prints = written(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("node"), F.count("*").alias("_n")), "nodes")
    known = nodes.where("node IS NOT NULL")
    found = components(links(known, 1 if known.count() <= one_code else 2, threshold, cell))
    named = known.join(found.toDF("fingerprint", "_class"), "fingerprint", "left").withColumn("_class", F.coalesce("_class", "fingerprint"))
    least = named.groupBy("_class").agg(F.min("node").alias("component"))
    named = written(named.join(least, "_class").where("_n > 1 OR component <> node").select("fingerprint", "component", "_n"), "named")
    out = dealt_join(prints, named.drop("_n"), ["fingerprint"], F.xxhash64("doc_id"), named.select("fingerprint", "_n"), "left")
    return out.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
