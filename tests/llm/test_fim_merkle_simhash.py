"""Fill-in-middle, the Merkle manifest and SimHash against plain Python, on awkward rows too."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from resistrum.llm import fim, merkle, queries, simhash
from resistrum.llm.common import table

AWKWARD = [
    (1, "One two, three!\nfour"), (1, "One two, three!\nfour"), (2, None), (3, ""), (4, " \t\n"), (5, "a<P>b"), (6, "x<"), (7, "<" * 50 + "P>" * 20), (8, "\U0001f600é\U0001f600a\U0001f600b\n\r\v"), (9, "word " * 3000), (None, "no id at all"),
    (10, "Ünïcode wörds, straße"), (11, "$1 \\n [x] (y) ^z"), (12, "$1 \\n [x] (y) ^z"),
]


def awkward(spark, rows=AWKWARD):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.select("*", *[F.lit("clash").alias(c) for c in ("n_units", "form", "output", "fingerprint", "component", "node", "key", "place", "leaf")])


def plain_fim(doc_id, text):
    text = text or ""
    us = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(us) + 1), h[1] % (len(us) + 1)))
    p, m, s = "".join(us[:a]), "".join(us[a:b]), "".join(us[b:])
    if not text or any(x in text for x in fim.MARKERS) or h[2] % 100 >= 90:
        return doc_id, text, len(us), "plain", text
    return (doc_id, text, len(us), "spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (doc_id, text, len(us), "psm", f"<P>{p}<S>{s}<M>{m}")


def test_fim_of_awkward_texts(spark):
    rows = AWKWARD + [(100 + k, "Some text. " * k + "<" * (k % 3)) for k in range(60)]
    made = fim.transformed(awkward(spark, rows)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, r.text, r.n_units, r.form, r.output) for r in made), key=key) == sorted((plain_fim(*r) for r in rows), key=key)
    assert all(r.back == r.text for r in made)
    assert {r.form for r in made} == {"plain", "psm", "spm"}
    assert fim.transformed(awkward(spark, [])).count() == 0


@pytest.mark.parametrize("grammar", [fim.LETTER_RUNS, fim.CHARACTERS, r"[0-9]+|[\s]+|[^0-9\s]", r"[^\n]+|[\n]"])
def test_units_of_any_grammar(spark, grammar):
    texts = [t for _, t in AWKWARD if t] + ["12 345\n\n6a7", "ab12", "1"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(fim.units(F.col("text"), grammar).alias("u")).collect()
    assert [r.u for r in got] == [re.findall(grammar.replace(r"\s", r"\t-\r\x20") if "0-9" in grammar else grammar, t) for t in texts]


@pytest.mark.parametrize("grammar", ["", "a+", "[a]+|[b]", "[a-c]|[^a]", "[a][b]"])
def test_other_grammars_are_refused(grammar):
    with pytest.raises(ValueError):
        fim.boundary(grammar)


def test_fim_query_restores_every_text(spark, sf):
    want = table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("t"))
    assert queries.op11_fill_in_middle(spark, sf).join(want, "doc_id").where("restored_sha256 <> t").count() == 0


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(leaves):
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([sha("".join(rows[-1][k : k + 8])) for k in range(0, len(rows[-1]), 8)])
    return rows


def siblings(rows, at):
    out = []
    for row in rows[:-1]:
        out += [d for k, d in enumerate(row[at // 8 * 8 : at // 8 * 8 + 8]) if k != at % 8]
        at //= 8
    return out


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_merkle_against_whole_trees(spark, levels):
    sizes = {"a": 1, "b": 8, "c": 9, None: 64, "d": 65, "é": 600, "": 7} | {f"t{k}": 2 for k in range(12)}
    rows = [(k if t != "d" else k // 2, t, sha(f"{t}{k}")) for t, n in sizes.items() for k in range(n)] + [(None, "c", sha("null")), (3, "b", sha("b3"))]
    d = spark.createDataFrame(rows, "key long, tree string, leaf string").withColumn("claim", F.when(F.col("key") % 5 == 2, F.sha2("leaf", 256)).otherwise(F.col("leaf"))).withColumn("place", F.lit("clash")).withColumn("_at", F.lit(1))
    made = merkle.manifest(d, levels=levels).withColumn("fold", merkle.folded(F.col("claim"), F.col("proof"))).withColumn("sum", merkle.proof_digest(F.col("proof"))).collect()
    names = sorted(sizes, key=lambda t: (t is not None, (t or "").encode()))
    trees = {t: plain_tree([x[2] for x in sorted((r for r in rows if r[1] == t), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))]) for t in names}
    top = plain_tree([trees[t][-1][0] for t in names])
    want = sorted((t or "-", x, trees[t][-1][0], top[-1][0], sha("".join(siblings(trees[t], k) + siblings(top, names.index(t))))) for t in names for k, x in enumerate(trees[t][0]))
    assert sorted((r.tree or "-", r.leaf, r.subroot, r.root, r.sum) for r in made) == want
    assert all((r.fold == r.root) == (r.claim == r.leaf) for r in made)


def test_merkle_of_few_rows(spark):
    none = spark.createDataFrame([], "key long, tree string, leaf string, claim string")
    assert merkle.manifest(none).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, None, "ab" * 32, "cd" * 32)], "key long, tree string, leaf string, claim string")).collect()[0]
    assert one.subroot == one.root == one.leaf and one.proof == []


def test_digest_tells_nulls_from_texts(spark):
    d = spark.createDataFrame([(None, None), ("-", "x"), ("é", "1:x")], "a string, b string").select(merkle.digest(F.col("a"), F.col("b")).alias("h")).collect()
    assert [r.h for r in d] == [sha("--"), sha("1:-1:x"), sha("2:é3:1:x")]


def plain_print(text):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_classes(rows):
    """The smallest id that links lead to, by comparing all pairs."""
    prints = {i: plain_print(t) for i, t in rows}
    left, out = set(prints), {}
    while left:
        group = todo = {min(left)}
        while todo:
            todo = {j for j in left - group if any((prints[i] ^ prints[j]).bit_count() <= 3 for i in todo)}
            group = group | todo
        out |= dict.fromkeys(group, min(group))
        left -= group
    return prints, out


def test_golay_code_covers_every_pattern_once():
    weights = np.bitwise_count(np.arange(1 << 23, dtype=np.int32))
    light = np.flatnonzero(weights <= simhash.RADIUS)
    assert len(light) == 2048 and len(np.unique(simhash._syndromes()[light])) == 2048


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3), st.sampled_from([1, 2]))
def test_near_fingerprints_meet_at_both_homes(x, bits, codes):
    y = x
    for b in bits:
        y ^= 1 << b
    (home, near), (other, more) = simhash.anchors(x, codes), simhash.anchors(y, codes)
    assert home in more and other in near and len(set(near.tolist())) == len(near)


def test_fingerprints(spark):
    rows = [r for r in AWKWARD if r[0] is not None]
    got = simhash.fingerprints(awkward(spark, rows)).collect()
    assert [(r.doc_id, r.fingerprint % 2**64) for r in got] == [(i, plain_print(t)) for i, t in rows]


def near_texts():
    rng = np.random.default_rng(5)
    rows = []
    for g in range(30):
        base = rng.integers(0, 5000, 400).tolist()
        for _ in range(6):
            ws = list(base)
            for _ in range(int(rng.integers(0, 6))):
                ws[int(rng.integers(0, len(ws)))] = int(rng.integers(0, 5000))
            rows.append((len(rows) * 7 % 1000 + 1, " ".join(f"w{x}" for x in ws)))
    return rows + [(2000, ""), (2001, None), (2002, "\n"), (2003, "A b"), (2004, "a  B"), (2005, "a"), (2006, rows[0][1].upper())]


@pytest.mark.parametrize(("one_code", "cell"), [(10**6, 10**6), (0, 10**6), (10**6, 8)], ids=["one code", "two codes", "cells"])
def test_simhash_classes_against_all_pairs(spark, one_code, cell):
    rows = near_texts()
    prints, want = plain_classes(rows)
    got = simhash.classes(awkward(spark, rows), one_code=one_code, cell=cell).collect()
    assert {r.doc_id: r.fingerprint % 2**64 for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(rows) - 50  # the texts do hold links


def test_simhash_of_chains_copies_and_missing_ids(spark):
    rows = [(5, "same text here"), (5, "same text here"), (3, "same text here"), (None, "same text here"), (None, "other"), (9, None), (8, "")]
    got = simhash.classes(awkward(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("3", 3), ("5", 3), ("5", 3), ("8", 8), ("9", 8), ("None", None), ("None", None)]
    assert simhash.classes(awkward(spark, [])).count() == 0
    nodes = spark.range(0, 400).selectExpr("(bigint(1) << int(id % 60)) - 1 + (id div 60 << 61) AS fingerprint").distinct()
    edges = simhash.links(nodes).collect()
    assert len(edges) <= 80 * nodes.count()  # stars, not all pairs


def test_simhash_query_against_all_pairs(spark, sf):
    prints, want = plain_classes([(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()])
    got = queries.op13_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}
