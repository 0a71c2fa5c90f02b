"""BPE against tiktoken, language ID on held-out rows, media round trips, HTML samples."""

import hashlib
import html as pyhtml
import random
import re
import struct
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from resistrum.llm import bpe, html, langid, media, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = "aaab  \n\n\tAé日本'st1 0$€—\x1c\x85  "


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_ids_equal_tiktokens(codec, reference):
    for t in [*texts(500), "ab" * 2000, "<|endoftext|>", ""]:
        assert codec.encode(t) == reference.encode_ordinary(t)
        assert codec.decode(codec.encode(t)) == t.encode()


def test_edits_and_appends_are_exact(codec, reference):
    rnd, p = random.Random(2), bpe.Prefixes(codec, "Some words, and more of them. " * 5)
    for x in texts(300, 3):
        a = rnd.randrange(len(p.text) + 1)
        p.edit(a, min(len(p.text), a + rnd.randrange(6)), x[:8])
        assert p.ids() == reference.encode_ordinary(p.text)
        p.append(x[8:11])
        assert p.ids() == reference.encode_ordinary(p.text)


def test_an_edit_splits_few_pieces(codec):
    p = bpe.Prefixes(codec, "word " * 1000)
    assert p.edit(2500, 2500, "x") < 5


def test_op1_matches_tiktoken(spark, sf, reference):
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_byte_bpe(spark, sf).collect()
    assert len(rows) == len(want)
    for r in rows:
        ids = reference.encode_ordinary(want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(want[r.doc_id].encode()).hexdigest())


def test_decoding_ids(spark):
    d = spark.createDataFrame([(1, "a\nb é"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: bytes(r.bytes) for r in bpe.decoded(bpe.encoded(d, PATH, public_tokenizers.PATTERN), PATH).collect()}
    assert got == {1: "a\nb é".encode(), 2: b""}


def test_language_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    d = queries.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    for r in d.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("right"), F.min("score").alias("low"), F.max("score").alias("high")).collect():
        assert r.right > 0.95 and 0 <= r.low <= r.high <= 1


def test_language_needs_letters_and_training(spark):
    d = spark.createDataFrame([(1, "alpha beta gamma", "x"), (2, "omega psi chi", "y"), (3, None, "x"), (4, "12 34 ...", None), (5, "", "y")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predicted(d, langid.fitted(d)).collect()}
    assert got == {1: "x", 2: "y", 3: "und", 4: "und", 5: "und"}
    none = langid.fitted(d.where("lang = 'z'"))
    assert {r.lang_pred for r in langid.predicted(d, none).collect()} == {"und"}


@pytest.mark.parametrize("n", [0, 1, 64, 1024, 1025, 70_000])
def test_media_round_trip(n):
    rnd = random.Random(n)
    p = bytes(rnd.randrange(256) for _ in range(n))
    frames, seconds, length = media.read_avi(media.samples_to_avi(p))
    assert media.payload_of(media.decoded_frames(frames), length) == p and seconds == 1 / media.FPS


def test_frames_are_ordinary_jpeg():
    import numpy as np

    samples = np.random.default_rng(1).integers(0, 256, media.FRAME).astype(np.uint8)
    pixels = media._general(media.jpeg_of_samples(samples))
    assert (pixels.reshape(media.SIDE, 8, media.SIDE, 8) == samples.reshape(media.SIDE, 1, media.SIDE, 1)).all()


def test_shots_and_clips(spark):
    dark, light = bytes([10]) * media.FRAME, bytes([200]) * media.FRAME
    d = spark.createDataFrame([(1, media.samples_to_avi(dark * 5 + light * 3)), (2, None), (3, b"RIFFbroken"), (4, media.samples_to_avi(b""))], "doc_id long, media binary")
    got = [(r.doc_id, r.clip, r.first_frame, r.n_frames, round(r.end_s, 6)) for r in media.clips(d, "doc_id").orderBy("doc_id", "clip").collect()]
    assert got == [(1, 0, 0, 5, 0.2), (1, 1, 5, 3, 0.32)]
    assert [r.payload_bytes for r in media.facts(d).orderBy("doc_id").collect()] == [8 * media.FRAME, None, None, 0]


def test_a_file_without_index_is_walked():
    avi = media.samples_to_avi(b"x" * 3000)
    at = avi.rindex(b"idx1")
    cut = avi[:4] + struct.pack("<I", at - 8) + avi[8:at]
    assert media.read_avi(cut)[0] == media.read_avi(avi)[0]


def test_op6_facts(spark, sf):
    want = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_media(spark, sf).collect():
        text = want[r.doc_id]
        payload = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


WRAPPED = "<h1>Title of it with some more words in one long line</h1><p>" + "many words of the main text " * 9 + "</p>"
WRAPPED_TEXT = "Title of it with some more words in one long line\n" + ("many words of the main text " * 9).strip()


@pytest.mark.parametrize("begin", ['<div class="content has-sidebar">', '<div id="page" class="no-sidebar">', '<div class="post comments-open">', '<div class="layout menu-left">', '<div class="right-sidebar">', '<form action="x"><div>', '<form><div class="overlay">'])
def test_wrappers_of_the_page_are_kept(begin):
    page = f'<body>{begin}<nav>{"menu words " * 200}</nav>{WRAPPED}<div class="site-footer">our footer</div><div class="comments">{"a comment " * 300}</div></div></form></body>'
    assert html.main_text(page, html.weights_of({})) == WRAPPED_TEXT


@pytest.mark.parametrize("out", ['<form>{}</form>', '<div class="ad">{}</div>', '<div class="cookie-banner">{}</div>', '<ul class="menu">{}</ul>'])
def test_small_parts_that_are_not_content_stay_out(out):
    assert html.main_text(f'<body>{WRAPPED}{out.format("some other words")}</body>', html.weights_of({})) == WRAPPED_TEXT


def test_op7_is_the_article(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op7_html(spark, sf).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
        want = "\n".join(b for b in (" ".join(pyhtml.unescape(x).split()) for x in blocks) if b)
        assert r.text == want and r.n_chars == len(want)


WEIGHTS = html.weights_of({})
BODY = "The article has a first paragraph with quite a few words in it."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("<p></p>", ""), ("just words", "just words"),
        (f"<nav><ul><li><a href=x>Home</a></ul></nav><p>{BODY}<p>Second &amp; last,  with\nmore words here.</p><footer>(c) 2024 the owners of this page</footer>", f"{BODY}\nSecond & last, with more words here."),
        (f"<div class='cookie-notice'>We use cookies for many things, click here to accept them</div><div><p>{BODY}</p></div><aside>related things</aside>", BODY),
        (f"<form><input name=q>Search this site for words</form><script>var a='<p>not text</p>';</script><p>{BODY}<!-- hidden --> <i>in</i>line</p>", f"{BODY} inline"),
        (f"<article><p>{BODY}</p><div class='ad'>Buy one get one free today only at the shop</div><p>{BODY}</p><div id='comments'><p>first comment of a reader</p></div></article>", f"{BODY}\n{BODY}"),
        (f"<p>{BODY} 1 < 2 and a &lt;b&gt; &#233;", f"{BODY} 1 < 2 and a <b> é"),
        (f"<p>{BODY}</p><p unclosed='", BODY),
    ],
)
def test_html_samples(page, want):
    assert html.main_text(page, WEIGHTS) == want


def test_html_region_is_the_best_of_all():
    rnd = random.Random(4)
    for _ in range(200):
        page = "".join(rnd.choice(["<div>", "</div>", "<hr>", "word ", "two words ", "<p>", "</p>"]) for _ in range(rnd.randrange(30)))
        parts = html.items(page)
        scores = [WEIGHTS.get(x[:2], html.TAG) * (len(x[2].split()) if x[0] == "text" else 1) for x in parts]
        best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        assert bool(html.main_text(page, WEIGHTS)) == (best > 0)


def test_deep_pages_take_linear_time():
    """Tags that are never closed, and lists and marked elements in each other."""
    import time

    from resistrum.llm import html

    weights = html.weights_of({})
    began = time.time()
    for page in ("<div>x " * 100_000, "<div class=ad>x " * 50_000, "<ul><li>x " * 50_000, "<form><p>x " * 50_000, "</b>" * 100_000 + "<p>y"):
        html.main_text(page, weights)
    assert time.time() - began < 60


def test_wrappers_keep_their_article():
    from resistrum.llm import html

    weights = html.weights_of({("tag", name): (900, 100) for name in ("h1", "p", "object", "div")})
    words = "one two three four five six seven eight nine ten " * 5
    for wrapper in ("<div id=page class=has-sidebar>", "<div class='no-sidebar layout'>", "<form>", "<div class='content sidebar'>"):
        page = f"<body><nav>menu</nav>{wrapper}<article><h1>Head</h1><p>{words}</p><p>See <object>{words}</object></p></article></body>"
        text = html.main_text(page, weights)
        assert text.startswith("Head\none two") and "menu" not in text and text.count("ten") == 10
