"""Fill-in-middle: texts cut into units at zero-width boundaries, and prefix, middle and suffix set in another order.

A unit grammar is an alternation of character classes, `[...]` for units of one character and `[...]+` for longest
runs, of which each character is in exactly one. Two neighbours are of one unit only if both are in the same class of
runs. So the grammar becomes a regular expression of no width that looks at the class on either side (boundary), and
Spark's split at it keeps every character. Two hashes of the document's id pick the cuts among the gaps between units.

A text that holds a marker stays plain, so that the markers of an output tell its parts apart and the text can be
restored exactly.

Cases: a null text counts as empty; an empty text has no units and stays plain; a null id hashes like an empty one;
equal ids draw equal numbers, whatever their texts; other columns are ignored, whatever their names; an empty table gives an
empty result. Characters are code points, in units and counts; a split never parts a surrogate pair.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTER_RUNS = "[A-Za-z]+|[^A-Za-z]"
CHARACTERS = r"[\s\S]"
MARKERS = ("<P>", "<S>", "<M>")
_CLASS = re.compile(r"(\[\^?\]?(?:\\.|[^\]\\])*\])(\+?)")


@lru_cache
def boundary(grammar: str) -> str:
    """The regular expression of no width that matches between the units of grammar, and nowhere else."""
    parts, at = [], 0
    while at < len(grammar):
        found = _CLASS.match(grammar, at)
        if not found or grammar[found.end() : found.end() + 1] not in ("", "|"):
            raise ValueError(f"not an alternation of classes: {grammar}")
        parts.append(found.groups())
        at = found.end() + 1
    every = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)))
    if not parts or sum(len(re.findall(c, every)) for c, _ in parts) != len(every) or re.sub("|".join(c for c, _ in parts), "", every):
        raise ValueError(f"each character must be in one class: {grammar}")
    return "|".join(f"(?<={c})(?!{c})(?=[\\s\\S])" if run else f"(?<={c})(?=[\\s\\S])" for c, run in parts)


def units(text: Column, grammar: str = LETTER_RUNS) -> Column:
    """The units of text, in order; none of an empty or null text, of which a split would make one."""
    return F.when(F.length(text) > 0, F.split(text, boundary(grammar), -1)).otherwise(F.array().cast("array<string>"))


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2**32 from the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, grammar: str = LETTER_RUNS, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """doc_id, text, n_units, form (plain, psm or spm), prefix, middle, suffix (null if plain) and output of each row (doc_id, text)."""
    if len({m[:1] for m in markers}) != 1 or any(m.count(markers[0][:1]) != 1 for m in markers) or len(set(markers)) != 3:
        raise ValueError("markers must differ, and begin with a character that they hold nowhere else")
    first, second, third, fourth = draws(F.col("doc_id"), seed)
    kept = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), first.alias("_h1"), second.alias("_h2"), third.alias("_h3"), fourth.alias("_h4"))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains("text", F.lit(m))
    shaped = kept.withColumn("form", F.when((F.length("text") == 0) | marked | (F.col("_h3") % 100 >= 100 - plain_percent), "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm"))

    def cut(u: Column) -> Column:
        gap = F.size(u) + 1
        a, b = F.least(F.col("_h1") % gap, F.col("_h2") % gap).cast("int"), F.greatest(F.col("_h1") % gap, F.col("_h2") % gap).cast("int")
        piece = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice(u, start + 1, length), ""))
        return F.struct(F.size(u).cast("long").alias("n"), piece(F.lit(0), a).alias("prefix"), piece(a, b - a).alias("middle"), piece(b, F.size(u) - b).alias("suffix"))

    cuts = shaped.withColumn("_cut", F.transform(F.array(units(F.col("text"), grammar)), cut)[0])
    p, s, m = (F.lit(x) for x in markers)
    prefix, middle, suffix = (F.col("_cut")[x] for x in ("prefix", "middle", "suffix"))
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    return cuts.select("doc_id", "text", F.col("_cut")["n"].alias("n_units"), "form", prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"), output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that transformed() made this output of."""
    parts = F.split(output, "|".join(re.escape(m) for m in markers), -1)
    return F.when(form == "plain", output).otherwise(F.transform(F.array(parts), lambda x: F.concat(F.when(form == "psm", x[1]).otherwise(x[2]), x[3], F.when(form == "psm", x[2]).otherwise(x[1])))[0])
