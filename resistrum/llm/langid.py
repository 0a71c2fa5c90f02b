"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of bit masks serves all languages: slot i holds a bit for each language whose filter has bit i set. The
AND of an n-gram's slots is the set of all languages whose n-grams hold it, in a few reads. A text's n-grams are
counted by language; from each count the share expected of false positives is taken off, and the largest corrected
count decides, the language first in code point order among equals.

A language's filter holds the n-grams that are found in at least LEAST_SHARE of its training documents and there
at least KEEP times as often as in any other language. Training takes about PER_LANG documents of each language,
chosen by a hash of the id; this bound is the only one, and predictions read whole texts.

Cases: a text that is null or has no letters is `und` with score 0; without training documents every text is; a
null language is never learned; repeated rows count as often as they occur; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resistrum.llm.common import lookup_join, written

SIZES = (1, 2, 3, 4)
PER_LANG = 2000
LEAST_SHARE, KEEP = 0.01, 0.5
#: Of each filter at most this share of bits is set, and an n-gram has so many bits.
FULL, HASHES = 0.1, 3
UNKNOWN = "und"
SLICE = 64
_TURNS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_SPACE = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(text: str | None) -> np.ndarray:
    """Hashes of all n-grams of the text's words, in lower case and with a space on either side; repeats stay."""
    text = (text or "").lower()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds, place = np.unique(points, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds.tolist()], dtype=bool)
    is_letter = letter[place] if len(kinds) else np.zeros(0, dtype=bool)
    if not is_letter.any():
        return np.zeros(0, dtype=np.uint64)
    spaced = np.concatenate([[_SPACE], np.where(is_letter, points, 32).astype(np.uint64), [_SPACE]])
    spaced = spaced[(spaced != _SPACE) | np.concatenate([[True], spaced[:-1] != _SPACE])]
    out, h = [], np.zeros(len(spaced), dtype=np.uint64)
    blank = spaced == _SPACE
    for n in range(1, max(SIZES) + 1):
        m = len(spaced) - n + 1
        if m <= 0:
            break
        h = _mix(h[:m] * _TURNS[0] + spaced[n - 1 : n - 1 + m] + _TURNS[1])
        if n in SIZES:
            inner = np.zeros(m, dtype=bool)
            for k in range(1, n - 1):
                inner |= blank[k : k + m]
            alone = blank[:m] if n == 1 else np.zeros(m, dtype=bool)
            out.append(h[~inner & ~alone])
    return np.concatenate(out)


class Filters:
    """Bit-sliced filters: `slots` has a row of 64-bit masks for each slot."""

    def __init__(self, langs: list[str], sizes: list[int]):
        self.langs = langs
        n = max([1, *sizes])
        self.slots_n = 1 << max(10, math.ceil(math.log2(n * HASHES / FULL)))
        self.slots = np.zeros((-(-len(langs) // 64), self.slots_n), dtype=np.uint64)

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        return [(_mix(h + t) & np.uint64(self.slots_n - 1)).astype(np.int64) for t in _TURNS[:HASHES]]

    def fill(self, h: np.ndarray, lang: np.ndarray) -> None:
        for at in self.places(h):
            np.bitwise_or.at(self.slots, (lang >> 6, at), np.uint64(1) << (lang.astype(np.uint64) & np.uint64(63)))

    def false_rates(self) -> np.ndarray:
        return np.array([float(((self.slots[k >> 6] >> np.uint64(k & 63)) & np.uint64(1)).mean()) ** HASHES for k in range(len(self.langs))])

    def counts(self, h: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language's filter has."""
        at = self.places(h)
        out = []
        for row in self.slots:
            masks = row[at[0]]
            for a in at[1:]:
                masks = masks & row[a]
            kinds, times = np.unique(masks, return_counts=True)
            bits = (kinds[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            out.append((bits * times[:, None].astype(np.uint64)).sum(axis=0))
        return np.concatenate(out)[: len(self.langs)].astype(float)


def training_rows(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """About per_lang rows (text, lang) of each language of docs, those whose id has a small hash."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = written(known.groupBy("lang").agg(F.count("*").alias("_n")), "langs")
    place = F.xxhash64(F.lit("langid"), F.col("doc_id"))
    some = lookup_join(known, sizes, "lang", place)
    return some.where(F.pmod(place, F.lit(1 << 32)) * F.col("_n") < F.lit(per_lang * (1 << 32))).select("text", "lang")


def fitted(docs: DataFrame, per_lang: int = PER_LANG) -> Filters:
    """Filters from docs (doc_id, text, lang). Counts of n-grams are summed in tasks; the driver gets those that stay."""
    rows = training_rows(docs, per_lang)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Counter] = {}
        documents: Counter = Counter()
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                documents[lang] += 1
                found.setdefault(lang, Counter()).update(np.unique(grams(text)).view(np.int64).tolist())
        for lang, c in found.items():
            yield pd.DataFrame({"lang": lang, "gram": pd.array([None, *c], dtype="Int64"), "n": [documents[lang], *c.values()]})

    sums = written(rows.mapInPandas(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    documents = {r["lang"]: r["n"] for r in sums.where("gram IS NULL").collect()}
    langs = sorted(documents)
    if not langs:
        return Filters([], [])
    totals = F.broadcast(sums.where("gram IS NULL").select("lang", F.col("n").alias("documents")))
    rates = sums.where("gram IS NOT NULL").join(totals, "lang").select("lang", "gram", (F.col("n") / F.col("documents")).alias("rate"))
    highest = rates.groupBy("gram").agg(F.max("rate").alias("highest"))
    kept = rates.where(F.col("rate") >= LEAST_SHARE).join(highest.where(F.col("highest") >= LEAST_SHARE), "gram").where(F.col("rate") >= KEEP * F.col("highest"))
    stay = kept.select("lang", "gram").toPandas()
    lang = stay["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(dtype=np.int64)
    out = Filters(langs, np.bincount(lang, minlength=len(langs)).tolist())
    out.fill(stay["gram"].to_numpy(dtype=np.int64).view(np.uint64), lang)
    return out


def predicted(docs: DataFrame, filters: Filters) -> DataFrame:
    """docs' doc_id, lang_pred and score: the corrected share of the text's n-grams that the language has. One narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        wrong = own.false_rates()
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                langs, scores = [], []
                for text in part.column(1).to_pylist():
                    h = grams(text)
                    if not len(h) or not own.langs:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    corrected = (own.counts(h) - len(h) * wrong) / (1 - wrong)
                    best = int(corrected.argmax())
                    langs.append(own.langs[best])
                    scores.append(float(min(1.0, max(0.0, corrected[best] / len(h)))))
                yield pa.record_batch([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
