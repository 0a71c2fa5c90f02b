"""Near-duplicates of documents and lines against brute force, the pipeline's stages, and awkward rows."""

import random
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from resistrum.llm import bpe, components, langid, linededup, minhash, mixing, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def groups(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def similar(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def sentences(seed, n=60):
    """Texts of many words with copies that differ in few to many places, chains and short ones."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    out = []
    for _ in range(n // 6):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 5, 40, 120]))]
        out.append(" ".join(base))
        now = list(base)
        for _ in range(5):
            for _ in range(rnd.randint(0, 1 + len(base) // 25)):
                now[rnd.randrange(len(now))] = rnd.choice(words)
            out.append(" ".join(now))
    return out


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], COLUMNS)


@pytest.mark.parametrize("n", [2, 5])
def test_minhash_groups(spark, n):
    texts = [*sentences(n), None, "", "   ", "one", "ONE", "one two"]
    sets = [shingles(t, n) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.classes(documents(spark, texts), n).collect()}
    want = groups(links, range(len(texts)))
    assert got == {i: (len(sets[i]), want[i]) for i in range(len(texts))}


def test_minhash_looks_at_few_buckets_of_one_component(spark, monkeypatch):
    """The first bands link near copies, so that the others' buckets aren't compared again."""
    rnd, link, rows = random.Random(3), minhash.linked, []
    base = [f"word{rnd.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join([*base[:k], f"other{k}", *base[k + 1 :]]) for k in range(60)]
    monkeypatch.setattr(minhash, "linked", lambda active, *a, **b: rows.append(active.count()) or link(active, *a, **b))
    got = [r.component_id for r in minhash.classes(documents(spark, texts), 2).collect()]
    assert got == [0] * 60 and sum(rows) < 60 * 16


def test_links_of_all_buckets_count_before_pairs_are_made(spark, monkeypatch):
    """What the hub of one bucket isn't similar to, but that of another is, isn't compared in pairs."""
    compare, rows = minhash.similar, []
    sets = [(0, list(range(78)))] + [(k, [*range(100), 1000 + k]) for k in range(1, 41)]
    active = [(key, node, len(x)) for key in (1, 2) for node, x in sets if node or key == 1]
    monkeypatch.setattr(minhash, "similar", lambda pairs, *a: rows.append(pairs.count()) or compare(pairs, *a))
    got = minhash.linked(spark.createDataFrame(active, "key long, node long, n long"), spark.createDataFrame(sets, "node long, set array<long>"), 80).collect()
    assert {r.id: r.component for r in got} == dict.fromkeys(range(1, 41), 1) and sum(rows) < 100


@pytest.mark.parametrize("small", [2, 64])
def test_members_of_the_largest_component_are_asked_first(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "PROBED", 0)
    monkeypatch.setattr(minhash, "SMALL", small)
    texts = sentences(11)
    sets = [shingles(t, 2) for t in texts]
    want = groups([(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])], range(len(texts)))
    assert {r.doc_id: r.component_id for r in minhash.classes(documents(spark, texts), 2).collect()} == want


@pytest.mark.parametrize("few", [0, 100])
def test_components_of_few_and_many_edges(spark, monkeypatch, few):
    monkeypatch.setattr(components, "BROADCAST_ROWS", few)
    rnd = random.Random(6)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(90)]
    want = groups(edges, {x for e in edges for x in e})
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_densified_bins_agree_as_often_as_sets_are_similar():
    s, rnd, hits, total = minhash.Sketcher(2, 32, 1), random.Random(1), 0, 0
    for _ in range(300):
        words = [str(rnd.random()) for _ in range(10)]
        a, b = s.set_of(" ".join(words[:9])), s.set_of(" ".join(words[1:]))
        hits += int((s.band_keys(a) == s.band_keys(b)).sum())
        total += 32
    assert hits / total == pytest.approx(7 / 9, abs=0.03)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def line_set(line):
    n = linededup.SHINGLE
    return {line[i : i + n] for i in range(max(1, len(line) - n + 1))}


def brute_lines(texts):
    """The texts without lines that are near copies of an earlier one."""
    lines = [(i, k, raw.strip(" \t\r\x0b\x0c").lower()) for i, t in enumerate(texts) for k, raw in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[2]) >= linededup.LEAST_CHARS]
    sets = [line_set(x[2]) for x in lines]
    found = groups([(i, j) for i in range(len(lines)) for j in range(i) if similar(sets[i], sets[j])], range(len(lines)))
    gone = {lines[i][:2] for i, head in found.items() if head != i}
    return [None if t is None else "\n".join(raw for k, raw in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in enumerate(texts)]


def line_texts(seed):
    rnd, pool = random.Random(seed), [s for s in sentences(seed, 90) if len(s) > 20]
    return ["\n".join(rnd.choice([rnd.choice(pool), rnd.choice(pool).upper(), "", "short", "  " + rnd.choice(pool)]) for _ in range(rnd.randrange(6))) for _ in range(40)] + [None, "", "\n\n"]


def test_fuzzy_lines(spark):
    texts = line_texts(7)
    got = {r.doc_id: r.text for r in linededup.deduplicated(documents(spark, texts)).collect()}
    assert got == dict(enumerate(brute_lines(texts)))


def test_short_lines_go_too(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 34))).strip() for _ in range(60)]
    lines = [x for b in base for x in (b, b + "s", "x" + b, b[1:], b.upper(), b + b)] + ["all rights reserved.", "All rights reserved.", "aaaaaaaa", "a" * 12, "a" * 60, "ok", "OK", "ab" * 40, "ab" * 5, ""]
    rnd.shuffle(lines)
    texts = ["\n".join(lines[k : k + 7]) for k in range(0, len(lines), 7)]
    split = [[x.strip().lower() for x in t.split("\n")] for t in texts]
    flat = [(i, k, x) for i, xs in enumerate(split) for k, x in enumerate(xs) if x]
    sets = [line_set(x[2]) for x in flat]
    found = groups([(i, j) for i in range(len(flat)) for j in range(i) if similar(sets[i], sets[j])], range(len(flat)))
    gone = {flat[i][:2] for i, head in found.items() if head != i}
    got = {r.doc_id: r.text for r in linededup.deduplicated(documents(spark, texts)).collect()}
    assert got == {i: "\n".join(raw for k, raw in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in enumerate(texts)}


def test_lines_that_repeat_themselves(spark):
    """Lines of nearly equal sets whose parts are repeated differently often, and short words in long lines."""
    rnd = random.Random(9)
    texts = []
    for _ in range(12):
        words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(40)]
        again = words[:8]
        texts += [" ".join(words + again * 2), " ".join(words + again * 40), " ".join(again * 90 + words)]
        long = "".join(rnd.choice("abcdefghij") for _ in range(700))
        texts += [" ".join([*"klmnopqrst", long]), " ".join([*"uvwxyzuvwx", long])]
    rnd.shuffle(texts)
    got = {r.doc_id: r.text for r in linededup.deduplicated(documents(spark, texts)).collect()}
    assert got == dict(enumerate(brute_lines(texts)))


def near_lines(kind, rnd):
    """Two lines of similarity 0.8 to 0.9."""
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    while True:
        if kind == "edge":
            words, tail = [word(rnd.randint(2, 4)) for _ in range(rnd.randint(6, 9))], ""
        elif kind == "repeats":
            words, tail = [word(rnd.randint(2, 9)) for _ in range(3)] * 5, word(rnd.randint(50, 70))
        elif kind == "address":
            words, tail = [word(rnd.randint(2, 4)) for _ in range(11)], word(600)
        elif kind == "tail":
            words, tail = [word(rnd.randint(1, 3)) for _ in range(10)], word(rnd.randint(150, 250))
        else:
            words, tail = [word(rnd.randint(2, 9)) for _ in range(rnd.randint(14, 60))], ""
        other = list(words)
        if kind in ("edge", "repeats"):  # another end, of up to four characters
            other[-1] += word(rnd.randint(1, 4))
        for _ in range(0 if kind in ("edge", "repeats") else rnd.randint(1, 11)):
            other[rnd.randrange(len(other))] = word(rnd.randint(2, 7))
        a, b = (" ".join([*w, tail]).strip() for w in (words, other))
        x, y = line_set(a), line_set(b)
        if 0.8 <= len(x & y) / len(x | y) <= 0.9:
            return a, b


@pytest.mark.parametrize("kind", ["address", "tail", "prose", "edge", "repeats"])
def test_recall_of_fuzzy_lines(spark, kind):
    rnd = random.Random(kind)
    pairs = [near_lines(kind, rnd) for _ in range(300)]
    got = linededup.deduplicated(documents(spark, [x for p in pairs for x in p])).agg(F.sum("n_removed")).first()[0]
    assert 0.99 * len(pairs) <= got <= len(pairs)


def test_line_dedup_uses_no_python(spark, monkeypatch):
    """Neither the result's plan nor that of any table written on the way."""
    plans, write = [], linededup.written
    noted = lambda df, label: plans.append(df._jdf.queryExecution().toString()) or write(df, label)
    for module in (linededup, minhash, components):
        monkeypatch.setattr(module, "written", noted)
    plans.append(linededup.deduplicated(documents(spark, line_texts(3)).repartition(2))._jdf.queryExecution().toString())
    assert len(plans) > 10
    for plan in plans:
        assert not re.search("ArrowEval|BatchEvalPython|MapInArrow|MapInPandas|InPandas|pythonUDF", plan)


def test_line_dedup_writes_less_than_its_texts(spark, monkeypatch):
    """What it keeps in the shared folder at a time, of lines that have no near copy."""
    rnd, write, most = random.Random(8), linededup.written, [0]
    texts = ["\n".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz 0123456789") for _ in range(300)) for _ in range(20)) for _ in range(100)]
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = size()

    def noted(df, label):
        out = write(df, label)
        most[0] = max(most[0], size() - before)
        return out

    for module in (linededup, minhash, components):
        monkeypatch.setattr(module, "written", noted)
    got = linededup.deduplicated(documents(spark, texts)).agg(F.sum("n_removed"), F.count("*")).first()
    assert tuple(got) == (0, 100) and most[0] < 0.8 * sum(map(len, texts))


AWKWARD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (4, "word " * 30_000, "en", "a", 150_000), (5, "same text for all of these rows here, again", "en", "a", 43), (5, "same text for all of these rows here, again", "en", "a", 43), (None, "same text for all of these rows here, again", None, "b", 43), (None, None, None, None, None), (6, "x" * 100_000, "fr", "b", 100_000)]
CLASH = ["n_tokens", "size", "target", "n_words", "n_lines", "_row", "component", "key", "places", "score"]


@pytest.mark.parametrize("rows", [AWKWARD, []], ids=["awkward", "empty"])
def test_stages_take_awkward_rows(spark, sf, rows):
    d = spark.createDataFrame(rows, COLUMNS)
    for c in CLASH:
        d = d.withColumn(c, F.lit("kept"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, sf)
        assert out.columns == d.columns, name
        got = out.collect()
        assert len(got) <= 3 * len(rows) and all(r["component"] == "kept" for r in got)
    assert corpus_pipeline.STAGES[-1][1](spark, d, sf).count() == len(rows)


def test_awkward_rows_of_near_dedup(spark):
    got = Counter(r.doc_id for r in minhash.deduplicated(spark.createDataFrame(AWKWARD, COLUMNS)).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, None: 2}


def test_quality_keeps_clean_documents_and_rejects_repeats(spark):
    clean = [" ".join(s) for s in (random.Random(k).sample([f"word{i}" for i in range(500)], 60) for k in range(30))]
    d = documents(spark, [*clean, "again and again the same five words " * 10, "too short", None])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in quality.kept(d, labels).collect()} == set(range(30))


def test_mix_meets_targets(spark):
    d = spark.createDataFrame([(i, "a b c d e", None, "big" if i % 10 else "small", 9) for i in range(5000)], COLUMNS)
    rows = mixing.mixed(d).collect()
    for source in ("big", "small"):
        own = [r for r in rows if r.source == source]
        assert sum(r.size * r.copies for r in own) == pytest.approx(own[0].target, rel=0.05)
        assert all(r.copies <= 3 for r in own)
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in mixing.mixed(d).collect())


def test_pipeline_against_brute_force(spark, sf):
    """Each stage on what the one before kept."""
    import public_tokenizers
    import tiktoken

    rnd = random.Random(5)
    texts = line_texts(11) + [" ".join(rnd.sample([f"word{i}" for i in range(900)], 80)) for _ in range(5)] + sentences(12, 30)
    d = documents(spark, texts)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, d, sf).orderBy("doc_id").collect()
    lined = {r.doc_id: r.text for r in stages["line dedup"](spark, spark.createDataFrame(kept, COLUMNS), sf).collect()}
    brute = {r.doc_id: t for r, t in zip(kept, brute_lines([r.text for r in kept]), strict=True)}
    assert lined == {i: t for i, t in brute.items() if t.strip() or t == texts[i]}
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in sorted(lined.items())], COLUMNS)
    sets = {i: shingles(t, 5) for i, t in lined.items()}
    links = [(i, j) for i in sets for j in sets if j < i and similar(sets[i], sets[j])]
    one_each = {i for i, head in groups(links, sets).items() if head == i}
    near = stages["near dedup"](spark, docs, sf)
    assert {r.doc_id for r in near.collect()} == one_each
    mixed = stages["source mix"](spark, near, sf).collect()
    assert {r.doc_id for r in mixed} <= one_each
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = Counter((r.doc_id, tuple(r.token_ids)) for r in stages["byte bpe"](spark, spark.createDataFrame(mixed, COLUMNS), sf).collect())
    assert got == Counter((r.doc_id, tuple(enc.encode_ordinary(r.text))) for r in mixed)


def test_language_rows_awkward(spark):
    d = spark.createDataFrame(AWKWARD, COLUMNS)
    assert langid.predicted(d, langid.fitted(d)).count() == len(AWKWARD)
