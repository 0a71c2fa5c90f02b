"""Media columns: AVI files of motion-JPEG frames, and clips found in them.

samples_to_avi() stores bytes losslessly: each byte is the mean of one flat 8 x 8 block of a grey baseline JPEG, so
the DC coefficients alone carry it (quantised by 8, the DCT's gain) and every decoder gives the same pixels. The
Huffman table gives category c the length 9 - c; with c bits of amplitude and one end-of-block bit each block takes
ten bits, and such frames are decoded as arrays. Frames of other baseline JPEG streams are decoded block by block.

Frames are found through the file's own index (idx1); a file without one is walked chunk by chunk. Shots begin where
the difference of two frames' histograms is far above that of the frames before it.

Cases: a null payload is stored as an empty one, without frames; a null or broken file gives no clips and null
facts; a frame that can't be decoded counts as equal to the one before; repeated rows give equal rows; other
columns are kept by stored() and facts(), but for those with a name of the result; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A frame has SIDE x SIDE blocks, one for each byte.
SIDE, FPS = 32, 25
FRAME = SIDE * SIDE
#: A shot begins where the difference exceeds FACTOR times the mean of the last HISTORY differences, and LEAST.
BINS, HISTORY, FACTOR, LEAST = 16, 8, 3.0, 0.1
SLICE = 16
_CATEGORY = np.array([0] + [int(v).bit_length() for v in range(1, 512)])
#: The zigzag order of a block's coefficients, by diagonals of alternating direction.
_ZIGZAG = np.array([y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[sum(p) % 2 == 0]))])
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.5) if not u else 1) / 2 for u in range(8)] for x in range(8)])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Codes of 1 to 9 bits for the categories 8 to 0, and the one-bit code of the end of a block.
_LENGTHS = bytes([1] * 9 + [0] * 7)
_HEAD = (
    b"\xff\xd8" + _segment(0xDB, b"\x00" + bytes([8] + [1] * 63)) + _segment(0xC0, struct.pack(">BHHB", 8, SIDE * 8, SIDE * 8, 1) + b"\x01\x11\x00")
    + _segment(0xC4, b"\x00" + _LENGTHS + bytes(range(8, -1, -1))) + _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\x00") + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)


def jpeg_of_samples(samples: np.ndarray) -> bytes:
    """A frame whose blocks' levels are the SIDE x SIDE samples."""
    levels = samples.astype(np.int64) - 128
    steps = np.diff(levels, prepend=0)
    category = _CATEGORY[np.abs(steps)]
    amplitude = np.where(steps < 0, steps + (1 << category) - 1, steps)
    code = ((1 << (8 - category)) - 1) << 1  # 8 - category ones, then a zero
    units = (((code << category) | amplitude) << 1).astype(np.uint16)
    bits = np.unpackbits(units.byteswap().view(np.uint8)).reshape(-1, 16)[:, 6:]
    data = np.packbits(np.concatenate([bits.ravel(), np.ones(-bits.size % 8, dtype=np.uint8)])).tobytes()
    return _HEAD + data.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


class _Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\x00", b"\xff"), dtype=np.uint8)).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        v = 0
        for b in self.bits[self.at : self.at + n]:
            v = v << 1 | b
        self.at += n
        return v

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        v = 0
        for n in range(1, 17):
            v = v << 1 | self.bits[self.at]
            self.at += 1
            if (n, v) in codes:
                return codes[n, v]
        raise ValueError("no such code")

    def value(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def frame_levels(jpeg: bytes) -> np.ndarray:
    """The luma pixels of a baseline frame, from 0 to 255; for frames of flat blocks one level for each block."""
    if jpeg.startswith(_HEAD):
        data = np.frombuffer(jpeg[len(_HEAD) : -2].replace(b"\xff\x00", b"\xff"), dtype=np.uint8)
        bits = np.unpackbits(data)[: FRAME * 10].reshape(FRAME, 10)
        units = (bits.astype(np.int64) << np.arange(9, -1, -1)).sum(axis=1) >> 1
        # the code's leading ones say the category; what follows its zero is the amplitude
        category = 8 - bits[:, :9].argmin(axis=1).astype(np.int64)
        amplitude = units & ((1 << category) - 1)
        low = (category > 0) & (amplitude < (1 << np.maximum(category - 1, 0)))
        steps = np.where(low, amplitude - (1 << category) + 1, amplitude)
        return (np.cumsum(steps) + 128).reshape(SIDE, SIDE)
    return _general(jpeg)


def _general(jpeg: bytes) -> np.ndarray:
    """Any baseline Huffman stream with one scan: its first component's pixels."""
    quant, dc, ac, at, parts, every = {}, {}, {}, 2, [], 0
    height = width = 0
    while at < len(jpeg):
        marker, size = jpeg[at + 1], struct.unpack(">H", jpeg[at + 2 : at + 4])[0]
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(float)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            height, width = struct.unpack(">HH", body[1:5])
            parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("not a baseline stream")
        elif marker == 0xDA:
            tables = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
            break
    wide, tall = (max(p[k] for p in parts) for k in (1, 2))
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
        wide = tall = 1
    across, down = -(-width // (8 * wide)), -(-height // (8 * tall))
    _, h, v, q = parts[0]
    out = np.zeros((down * v * 8, across * h * 8))
    ends = [i for i in range(at, len(jpeg) - 1) if jpeg[i] == 0xFF and 0xD0 <= jpeg[i + 1] <= 0xD9]
    pieces, begin = [], at
    for i in ends:
        pieces.append(jpeg[begin:i])
        begin = i + 2
    pieces = [_Bits(x) for x in pieces] or [_Bits(jpeg[at:])]
    last = dict.fromkeys(range(len(parts)), 0)
    for unit in range(across * down):
        bits = pieces[unit // every if every else 0]
        if every and unit % every == 0:
            last = dict.fromkeys(last, 0)
        for k, (c, ph, pv, pq) in enumerate(parts):
            for block in range(ph * pv):
                z = np.zeros(64)
                last[k] += bits.value(bits.symbol(dc[tables[c][0]]))
                z[0], i = last[k], 1
                while i < 64:
                    rs = bits.symbol(ac[tables[c][1]])
                    if not rs & 15 and rs != 0xF0:
                        break
                    i += rs >> 4
                    if rs & 15:
                        z[i] = bits.value(rs & 15)
                    i += 1
                if not k:
                    square = np.zeros(64)
                    square[_ZIGZAG] = z * quant[pq]
                    y, x = (unit // across * v + block // h) * 8, (unit % across * h + block % h) * 8
                    out[y : y + 8, x : x + 8] = _COS @ square.reshape(8, 8) @ _COS.T
    return np.clip(np.rint(out[:height, :width] + 128), 0, 255).astype(np.int64)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def samples_to_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold the payload, and whose `plen` chunk says its length."""
    data = np.zeros(-(-len(payload) // FRAME) * FRAME, dtype=np.uint8)
    data[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    frames = [jpeg_of_samples(x) for x in data.reshape(-1, FRAME)]
    edge, n = SIDE * 8, len(frames)
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, n, 0, 1, max(map(len, frames), default=0), edge, edge, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, FPS, 0, n, 0, -1, 0, 0, 0, edge, edge)
    form = struct.pack("<IiiHH4sIiiII", 40, edge, edge, 1, 24, b"MJPG", edge * edge * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    body, index = [], []
    at = 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(_chunk(b"00dc", f))
        at += len(body[-1])
    inner = b"AVI " + head + _chunk(b"plen", struct.pack("<Q", len(payload))) + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(inner)) + inner


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        yield data[at : at + 4], at + 8, min(size, end - at - 8)
        at += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[list[bytes], float, int | None]:
    """The video frames by the index, the seconds of a frame, and the length of a stored payload."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    seconds, length, movi, index = 1 / FPS, None, None, b""
    for name, at, size in _chunks(data, 12, len(data)):
        kind = data[at : at + 4] if name == b"LIST" else name
        if kind == b"hdrl":
            for inner, start, _ in _chunks(data, at + 4, at + size):
                if inner == b"avih":
                    seconds = struct.unpack("<I", data[start : start + 4])[0] / 1e6 or seconds
        elif kind == b"plen":
            length = struct.unpack("<Q", data[at : at + 8])[0]
        elif kind == b"movi":
            movi = (at, at + size)
        elif kind == b"idx1":
            index = data[at : at + size]
    if movi is None:
        return [], seconds, length
    if not index:
        return [data[a : a + n] for name, a, n in _chunks(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")], seconds, length
    entries = [e for e in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if e[0][2:] in (b"dc", b"db")]
    # offsets count from the list's name, or in some writers' files from the file's beginning
    base = movi[0] if entries and data[movi[0] + entries[0][2] :][:4] == entries[0][0] else 0
    return [data[base + at + 8 : base + at + 8 + size] for _, _, at, size in entries], seconds, length


def payload_of(levels: list[np.ndarray], length: int) -> bytes:
    return b"".join(x.astype(np.uint8).tobytes() for x in levels)[:length]


def shots(levels: list[np.ndarray]) -> list[int]:
    """The frames with which shots begin; 0 is always one, if there are frames."""
    if not levels:
        return []
    hists = [np.bincount(np.minimum(x.ravel() * BINS // 256, BINS - 1), minlength=BINS) / x.size for x in levels]
    starts, history = [0], []
    for k in range(1, len(hists)):
        d = float(np.abs(hists[k] - hists[k - 1]).sum()) / 2
        if d > LEAST and (not history or d > FACTOR * sum(history) / len(history)):
            starts.append(k)
            history = []
        else:
            history = [*history, d][-HISTORY:]
    return starts


def decoded_frames(frames: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for f in frames:
        try:
            out.append(frame_levels(f))
        except (ValueError, KeyError, IndexError, struct.error):
            out.append(out[-1] if out else np.zeros((1, 1), dtype=np.int64))
    return out


def _mapped(df: DataFrame, source: str, fields: list[T.StructField], row) -> DataFrame:  # noqa: ANN001
    """df with the fields that row(value of source) gives; a task holds SLICE values at a time."""
    names = [f.name for f in fields]
    own = [c for c in df.columns if c.lower() not in names]
    frame = df.select(*own, F.col(source).alias("_source"))
    schema = T.StructType([*frame.schema.fields[:-1], *fields])
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.typeName()] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                part = batch.slice(k, SLICE)
                made = [row(x) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.record_batch([*part.columns[:-1], *(pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds))], names=[*own, *names])

    return frame.mapInArrow(run, schema)


def stored(df: DataFrame, payload: str) -> DataFrame:
    """df with `media`: an AVI file for each value of the binary column payload."""
    return _mapped(df, payload, [T.StructField("media", T.BinaryType())], lambda x: (samples_to_avi(x or b""),))


def _facts(media: bytes | None) -> tuple:
    try:
        frames, _, length = read_avi(media or b"")
    except (ValueError, struct.error):
        return (None,) * 6
    levels = decoded_frames(frames)
    payload = payload_of(levels, length if length is not None else sum(x.size for x in levels))
    starts = shots(levels)
    mean = int(sum(int(x.sum()) for x in levels) * 1000 // max(1, sum(x.size for x in levels)))
    feature = f"frames={len(frames)};shots={','.join(map(str, starts))};mean={mean}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def facts(df: DataFrame, media: str = "media") -> DataFrame:
    """df with what its media hold, read back from the stored bytes: the payload's size and digests, the file's, a feature."""
    fields = [("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]
    return _mapped(df, media, [T.StructField(n, t) for n, t in fields], _facts)


def clips(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """A row for each shot of each file: the key, clip number, first frame, frames, begin and end in seconds."""
    frame = df.select(F.col(key).alias("_key"), F.col(media).alias("_media"))
    schema = T.StructType([T.StructField(key, frame.schema[0].dataType), *(T.StructField(n, T.LongType()) for n in ("clip", "first_frame", "n_frames")), T.StructField("begin_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                try:
                    frames, seconds, _ = read_avi(batch.column(1)[k].as_py() or b"")
                except (ValueError, struct.error):
                    continue
                starts = shots(decoded_frames(frames))
                ends = [*starts[1:], len(frames)]
                found = [(c, s, e - s, s * seconds, e * seconds) for c, (s, e) in enumerate(zip(starts, ends, strict=False))]
                if found:
                    own = batch.column(0).slice(k, 1).take(pa.array([0] * len(found)))
                    columns = [pa.array(x) for x in zip(*found, strict=True)]
                    yield pa.record_batch([own, *columns], names=schema.names)

    return frame.mapInArrow(run, schema)
