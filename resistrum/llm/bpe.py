"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece (a match of the split pattern) there is one token that can end its encoding: of the
vocabulary's tokens that end there, the one that stands next to the last token of the prefix before it without
merging with it. Storing that token per prefix encodes a piece in one pass, lets bytes be appended without
looking back, and after an edit only prefixes behind it are looked at again, until a piece ends where one ended
before.

Ids are those of the public rank file alone, without special tokens. Nothing is trained.

Cases: a null text encodes as an empty one (no tokens); an empty table gives an empty result; texts of any
length are encoded whole; repeated rows give equal rows; other columns are kept by encoded(), but for those with
a name of the result.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: What a task remembers at most: pieces with their ids, steps of a byte, pairs of tokens; the longest piece.
REMEMBERED_PIECES, REMEMBERED_STEPS, REMEMBERED_PAIRS, LONGEST_REMEMBERED = 500_000, 500_000, 400_000, 64
#: Texts at a time within a task.
SLICE = 64
_NEVER = sys.maxsize


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


class Codec:
    """Encodes and decodes by ranks; `pattern` splits a text into pieces that are encoded one by one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces = ranks, regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.name_of = {rank: str(rank) for rank in self.bytes_of}
        self.longest = max(map(len, ranks), default=0)
        self._begins = {token[:k] for token in ranks for k in range(len(token) + 1)} | {b""}
        self._steps: dict[bytes, tuple[bytes, tuple[tuple[int, int], ...]]] = {}
        self._lives: dict[tuple[bytes, bool], list[tuple[bytes, float]]] = {}
        self._halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._stable: dict[int, bool] = {}
        self._known: dict[str, Sequence[int]] = {}
        self._made: dict[bytes, bool] = {}

    def made(self, token: bytes) -> bool:
        """Whether merging makes this token of the vocabulary."""
        if token not in self._made:
            self._made[token] = len(token) == 1 or self.halves(token) is not None
        return self._made[token]

    def halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two tokens whose merge makes this one; None for a single byte, or if merging never makes it."""
        if token not in self._halves:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
                if rank == _NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = tuple(parts) if len(parts) == 2 else None
        return self._halves[token]

    def lives(self, token: bytes, left: bool) -> list[tuple[bytes, float]]:
        """The tokens at the token's left or right edge while it is made, from the byte up, each with the rank of the merge that ends it."""
        key = (token, left)
        if key not in self._lives:
            chain = [token]
            while (two := self.halves(chain[-1])) is not None:
                chain.append(two[0] if left else two[1])
            chain.reverse()
            self._lives[key] = list(zip(chain, [*(self.ranks[x] for x in chain[1:]), _NEVER], strict=True))
        return self._lives[key]

    def stands(self, a: int, b: int) -> bool:
        """Whether a and b stay apart next to each other: no edge of a merges with an edge of b while both are there."""
        known = self._stable.get(a << 32 | b)
        if known is not None:
            return known
        left, right, i, j, out = self.lives(self.bytes_of[a], False), self.lives(self.bytes_of[b], True), 0, 0, True
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            # of equal ranks the leftmost merge comes first
            if (rank := self.ranks.get(x + y)) is not None and rank < x_ends and rank <= y_ends:
                out = False
                break
            if x_ends == y_ends == _NEVER:
                break
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
        if len(self._stable) >= REMEMBERED_PAIRS:
            self._stable.clear()
        self._stable[a << 32 | b] = out
        return out

    def _step(self, grown: bytes) -> tuple[bytes, tuple[tuple[int, int], ...]]:
        """Of bytes read: their longest end that begins a token, and the tokens (id, length) they end with, the longest first."""
        state = grown
        while state not in self._begins:
            state = state[1:]
        ends = [state[i:] for i in range(len(state))]
        if len(self._steps) >= REMEMBERED_STEPS:
            self._steps.clear()
        self._steps[grown] = step = state, tuple((self.ranks[x], len(x)) for x in ends if x in self.ranks and self.made(x))
        return step

    def extend(self, data: bytes, last: list[int]) -> None:
        """last[i] is the token that ends the encoding of data[:i + 1]; adds what is missing up to all of data."""
        steps, stable = self._steps, self._stable
        state = data[max(0, len(last) - self.longest) : len(last)]
        while state not in self._begins:
            state = state[1:]
        for end in range(len(last) + 1, len(data) + 1):
            grown = state + data[end - 1 : end]
            state, ends = steps.get(grown) or self._step(grown)
            for rank, length in ends:
                if length == end:
                    break
                before = last[end - length - 1]
                stands = stable.get(before << 32 | rank)
                if stands or stands is None and self.stands(before, rank):
                    break
            else:
                raise ValueError("the ranks lack a byte")
            last.append(rank)

    def walk(self, data: bytes, last: list[int]) -> list[int]:
        """The ids of data, read back from the tokens of its prefixes."""
        if data in self.ranks:
            return [self.ranks[data]]
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        out.reverse()
        return out

    def piece(self, piece: str) -> Sequence[int]:
        """The ids of a piece, remembered unless it is long."""
        data = piece.encode("utf-8")
        last: list[int] = []
        if data not in self.ranks:
            self.extend(data, last)
        known = tuple(self.walk(data, last))
        if len(data) <= LONGEST_REMEMBERED:
            if len(self._known) >= REMEMBERED_PIECES:
                self._known.clear()
            self._known[piece] = known
        return known

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, piece = self._known, self.piece
        for m in self.pieces.findall(text):
            out += known.get(m) or piece(m)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Prefixes:
    """A text with the last token of each prefix of each piece, for exact appends and edits."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text = codec, text
        self.spans: list[tuple[int, int]] = []
        self.last: list[list[int]] = []
        for start, end in self._split(0):
            self.spans.append((start, end))
            self.last.append(self._computed(start, end, []))

    def _split(self, start: int) -> Iterator[tuple[int, int]]:
        for m in self.codec.pieces.finditer(self.text, start):
            yield m.span()

    def _computed(self, start: int, end: int, kept: list[int]) -> list[int]:
        self.codec.extend(self.text[start:end].encode("utf-8"), kept)
        return kept

    def ids(self) -> list[int]:
        out: list[int] = []
        for (start, end), last in zip(self.spans, self.last, strict=True):
            out += self.codec.walk(self.text[start:end].encode("utf-8"), last)
        return out

    def append(self, text: str) -> None:
        self.edit(len(self.text), len(self.text), text)

    def edit(self, start: int, end: int, text: str) -> int:
        """Replaces text[start:end]; returns how many pieces were split anew.

        A piece depends on its own characters and the two behind it, so pieces that end well before the edit
        stay. Splitting stops where a new piece begins at an old one's beginning, past the edit.
        """
        old_spans, old_last = self.spans, self.last
        shift = len(text) - (end - start)
        self.text = self.text[:start] + text + self.text[end:]
        keep = bisect_right(old_spans, start - 2, key=lambda s: s[1])
        while keep and self._open(old_spans[keep - 1][1], start):
            keep -= 1
        spans, last, changed = old_spans[:keep], old_last[:keep], 0
        begins = {s + shift: k for k, (s, _) in enumerate(old_spans) if k >= keep and s >= end}
        for s, e in self._split(spans[-1][1] if spans else 0):
            if s >= start + len(text) and s in begins:
                k = begins[s]
                spans += [(a + shift, b + shift) for a, b in old_spans[k:]]
                last += old_last[k:]
                break
            spans.append((s, e))
            old = old_last[keep] if not changed and keep < len(old_spans) and old_spans[keep][0] == s else []
            whole = len(self.text[s : max(s, min(start, e))].encode("utf-8"))
            last.append(self._computed(s, e, old[:whole]))
            changed += 1
        self.spans, self.last = spans, last
        return changed

    def _open(self, end: int, start: int) -> bool:
        """Whether only white space lies between a piece's end and the edit, so that its end may depend on it."""
        return self.text[end - 1 : start].isspace() or end >= start - 1


def shipped(spark: SparkSession, path: str) -> str:
    """Sends the rank file to the executors; its name there."""
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with n_tokens, token_ids, ids_sha256 and decoded_sha256, by the ranks in the (driver's) file path.

    One narrow pass: no shuffle. A task holds SLICE texts, the vocabulary and bounded memories of pieces and pairs.
    """
    new = ["n_tokens", "token_ids", "ids_sha256", "decoded_sha256"]
    own = [c for c in docs.columns if c.lower() not in new]
    name = shipped(docs.sparkSession, path)
    at = own.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(SparkFiles.get(name)), pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                ids = [codec.encode(t or "") for t in part.column(at).to_pylist()]
                named = [hashlib.sha256(" ".join(map(codec.name_of.__getitem__, x)).encode()).hexdigest() for x in ids]
                back = [hashlib.sha256(codec.decode(x)).hexdigest() for x in ids]
                columns = [pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(named, pa.string()), pa.array(back, pa.string())]
                yield pa.record_batch([*part.columns, *columns], names=own + new)

    added = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    frame = docs.select(*own)
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *added]))


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """ids (token_ids, others kept) with bytes; null ids give empty bytes, an id outside the vocabulary fails."""
    name = shipped(ids.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(read_ranks(SparkFiles.get(name)), "")
        for batch in batches:
            column = batch.schema.get_field_index("token_ids")
            out = pa.array([codec.decode(x or []) for x in batch.column(column).to_pylist()], pa.binary())
            yield pa.record_batch([*batch.columns, out], names=[*batch.schema.names, "bytes"])

    return ids.mapInArrow(run, T.StructType([*ids.schema.fields, T.StructField("bytes", T.BinaryType())]))
