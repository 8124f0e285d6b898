"""Operator 3: media columns of AVI motion-JPEG: index parsing, intra-frame decoding, shots, clips.

Frames are lossless JPEG (ITU-T T.81 process 14, SOF3, one 8-bit component, predictor 1), so any payload
comes back byte for byte. The Huffman table gives category k a code of 9 - k bits (category 0
nine bits): code and extra bits are 9 bits for every sample, so eight samples
are nine bytes, which numpy packs and unpacks by columns for many frames at once.

A payload is rows of WIDTH samples, HEIGHT rows a frame; the last frame is filled up with zeros and the
stored length says where the payload ends. Shots: the histogram difference of consecutive frames
is a cut where it exceeds the mean of the SPAN differences around it by SPREAD standard deviations
and a floor.

Memory: a task holds one medium and BLOCK frames' samples. Defined results: a null or empty text is a
payload of 64 zero bytes; equal texts give equal media; repeated rows give repeated results; a null
medium gives no clips and null digests, as does one that can't be read (`faults` says why); frames of other writers are read by their own segments (`jpeg`),
and without a stored length the payload is all their samples; a null doc_id is carried; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from vacancia.llm import jpeg
from vacancia.llm.common import map_arrow, texts

WIDTH, HEIGHT = 64, 16
FRAME = WIDTH * HEIGHT
#: Frames that are coded together.
BLOCK = 256
FRAMES_A_SECOND = 25
BINS, SPAN, SPREAD, FLOOR = 32, 8, 2.0, 0.08

_CODE_BITS = 9
_CATEGORIES = 9  # of differences between 8-bit samples
_LENGTHS = [_CODE_BITS] + [_CODE_BITS - k for k in range(1, _CATEGORIES)]  # code bits of each category


def _codes() -> dict[int, int]:
    """Canonical code of each category: by length, then by the order in which the table lists them."""
    out, code, length = {}, 0, 1
    for category in sorted(range(_CATEGORIES), key=lambda k: (_LENGTHS[k], k)):
        code <<= _LENGTHS[category] - length
        length = _LENGTHS[category]
        out[category] = code
        code += 1
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The 9-bit word of each difference + 255, and the difference of each 9-bit word modulo 256."""
    words, back = np.zeros(511, np.uint16), np.zeros(1 << _CODE_BITS, np.uint8)
    codes = _codes()
    for d in range(-255, 256):
        k = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << k) - 1
        words[d + 255] = codes[k] << k | extra
        back[words[d + 255]] = d % 256
    return words, back


_WORDS, _BACK = _tables()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head() -> bytes:
    order = sorted(range(_CATEGORIES), key=lambda k: (_LENGTHS[k], k))
    huffman = bytes([0]) + bytes(sum(_LENGTHS[k] == n for k in order) for n in range(1, 17)) + bytes(order)
    frame = struct.pack(">BHHB", 8, HEIGHT, WIDTH, 1) + bytes([1, 0x11, 0])
    scan = bytes([1, 1, 0x00, 1, 0, 0])  # one component, predictor 1, no point transform
    return b"\xff\xd8" + _segment(0xC4, huffman) + _segment(0xC3, frame) + _segment(0xDA, scan)


_HEAD = _head()


def encode_frames(samples: bytes) -> list[bytes]:
    """A lossless JPEG of each FRAME of the samples."""
    image = np.frombuffer(samples, np.uint8).reshape(-1, HEIGHT, WIDTH).astype(np.int16)
    difference = np.empty_like(image)
    difference[:, :, 1:] = image[:, :, 1:] - image[:, :, :-1]
    difference[:, 1:, 0] = image[:, 1:, 0] - image[:, :-1, 0]  # a row begins from the one above
    difference[:, 0, 0] = image[:, 0, 0] - 128
    words = _WORDS[difference + 255].reshape(-1, 8)
    packed = np.zeros((len(words), _CODE_BITS), np.uint8)
    for k in range(8):
        packed[:, k] |= (words[:, k] >> (k + 1)).astype(np.uint8)
        packed[:, k + 1] |= (words[:, k] << (7 - k) & 0xFF).astype(np.uint8)
    return [_HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in packed.reshape(len(image), -1)]


def written_here(jpegs: list[bytes]) -> bool:
    return all(j.startswith(_HEAD) and j.endswith(b"\xff\xd9") for j in jpegs)


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """The samples, a row each, of frames that encode_frames() wrote."""
    data = b"".join([j[len(_HEAD) : -2].replace(b"\xff\x00", b"\xff") for j in jpegs])
    packed = np.frombuffer(data, np.uint8).reshape(-1, _CODE_BITS).astype(np.uint16)
    words = np.empty((len(packed), 8), np.uint16)
    for k in range(8):
        words[:, k] = (packed[:, k] << (k + 1) | packed[:, k + 1] >> (7 - k)) & 0x1FF
    image = _BACK[words].reshape(-1, HEIGHT, WIDTH)
    image[:, 0, 0] += np.uint8(128)
    image[:, :, 0] = np.cumsum(image[:, :, 0], axis=1, dtype=np.uint8)
    return np.cumsum(image, axis=2, dtype=np.uint8).reshape(len(jpegs), FRAME)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, *chunks: bytes) -> bytes:
    return _chunk(b"LIST", name + b"".join(chunks))


def write_avi(payload: bytes) -> bytes:
    """An AVI of the payload's frames, with the idx1 index and the payload's length in its INFO list."""
    frames = []
    for at in range(0, len(payload), BLOCK * FRAME):
        part = payload[at : at + BLOCK * FRAME]
        frames += encode_frames(part.ljust(-(-len(part) // FRAME) * FRAME, b"\0"))
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FRAMES_A_SECOND, most * FRAMES_A_SECOND, 0, 0x10, len(frames), 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4h", 0, 0, 0, 0, 1, FRAMES_A_SECOND, 0, len(frames), most, -1, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(c := _chunk(b"00dc", f))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(c)
    body = b"AVI " + _list(b"hdrl", _chunk(b"avih", avih), _list(b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf)))
    body += _list(b"INFO", _chunk(b"ISBJ", b"payload bytes %d\0" % len(payload))) + _list(b"movi", *movi) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _chunks(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, stop) of the chunks in a part of a RIFF file."""
    while at + 8 <= end:
        name, size = bytes(data[at : at + 4]), struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError("a chunk goes beyond its list")
        yield name, at + 8, at + 8 + size
        at += 8 + size + size % 2


def read_avi(media: bytes) -> tuple[int | None, float, list[bytes]]:
    """(payload bytes if stored, frames a second, JPEG frames), the frames found through the index, whose offsets count from the list or the file."""
    data = memoryview(media)
    if bytes(data[:4]) != b"RIFF" or bytes(data[8:12]) != b"AVI ":
        raise ValueError("no AVI file")
    length, rate, movi, index = None, float(FRAMES_A_SECOND), 0, b""
    for name, a, b in _chunks(data, 12, 8 + struct.unpack_from("<I", data, 4)[0]):
        kind = bytes(data[a : a + 4]) if name == b"LIST" else name
        if kind == b"movi":
            movi = a
        elif kind == b"idx1":
            index = bytes(data[a:b])
        elif kind == b"hdrl":
            rate = next((1e6 / struct.unpack_from("<I", data, x)[0] for n, x, _ in _chunks(data, a + 4, b) if n == b"avih"), rate)
        elif kind == b"INFO":
            length = next((int(bytes(data[x:y]).rstrip(b"\0").split()[-1]) for n, x, y in _chunks(data, a + 4, b) if n == b"ISBJ"), length)
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        if name in (b"00dc", b"00db"):
            at = (movi if data[movi + offset : movi + offset + 4] == name else 0) + offset + 8
            if data[at - 8 : at - 4] != name or at + size > len(data):
                raise ValueError("the index leads elsewhere")
            frames.append(bytes(data[at : at + size]))
    return length, rate, frames


def histograms(frames: np.ndarray) -> np.ndarray:
    """Shares of BINS levels of each row of samples."""
    level = (frames >> (8 - (BINS - 1).bit_length())).astype(np.int64) + BINS * np.arange(len(frames))[:, None]
    return np.bincount(level.ravel(), minlength=BINS * len(frames)).reshape(len(frames), BINS) / FRAME


def cuts(h: np.ndarray) -> list[int]:
    """The frames at which a new shot begins, 0 not among them."""
    if len(h) < 2:
        return []
    d = np.abs(np.diff(h, axis=0)).sum(1) / 2
    at = np.arange(len(d))
    low, high = np.maximum(at - SPAN, 0), np.minimum(at + SPAN + 1, len(d))
    first, second = np.append(0, np.cumsum(d)), np.append(0, np.cumsum(d * d))
    others = np.maximum(high - low - 1, 1)
    mean = (first[high] - first[low] - d) / others
    deviation = np.sqrt(np.maximum((second[high] - second[low] - d * d) / others - mean * mean, 0))
    return (np.flatnonzero(d > np.maximum(FLOOR, mean + SPREAD * deviation)) + 1).tolist()


def clips(media: bytes) -> tuple[bytes, list[tuple[int, int, float, float]]]:
    """The payload, and (first frame, frames, start and end seconds) of each shot."""
    length, rate, jpegs = read_avi(media)
    parts, seen = [], [np.zeros((0, BINS))]
    if not written_here(jpegs):
        for frame in map(jpeg.decode, jpegs):
            parts.append(frame.tobytes())
            seen.append(np.bincount(frame.ravel() >> (8 - (BINS - 1).bit_length()), minlength=BINS)[None] / frame.size)
        return _shots(parts, length, rate, seen, len(jpegs))
    for at in range(0, len(jpegs), BLOCK):
        samples = decode_frames(jpegs[at : at + BLOCK])
        parts.append(samples.tobytes())
        seen.append(histograms(samples))
        if length is not None and (filled := length - (len(jpegs) - 1) * FRAME) < FRAME and at + BLOCK >= len(jpegs):  # what fills the last frame up is no picture
            seen[-1][-1] = np.bincount(samples[-1, :filled] >> (8 - (BINS - 1).bit_length()), minlength=BINS) / filled
    return _shots(parts, length, rate, seen, len(jpegs))


def _shots(parts: list[bytes], length: int | None, rate: float, seen: list[np.ndarray], frames: int) -> tuple[bytes, list[tuple[int, int, float, float]]]:
    payload = b"".join(parts)[:length]
    if length is not None and len(payload) != length:
        raise ValueError("frames are missing")
    bounds = [0, *cuts(np.concatenate(seen)), frames]
    return payload, [(a, b - a, a / rate, b / rate) for a, b in zip(bounds, bounds[1:])] if frames else []


def clips_or_reason(media: bytes | None) -> tuple[bytes | None, list[tuple[int, int, float, float]], str | None]:
    """The payload and clips of a medium; or none, and why it can't be read."""
    if media is None:
        return None, [], None
    try:
        return *clips(media), None
    except (ValueError, ZeroDivisionError, struct.error) as e:
        return None, [], str(e) or type(e).__name__


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 of a text filled up with zeros to a positive multiple of 64, and its own length."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw.ljust(max(-(-len(raw) // 64), 1) * 64, b"\0"), len(raw)


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_bytes, media) of each row: its text as an AVI column."""

    def make():
        def step(batch: pa.RecordBatch):
            sizes, media = [], []
            for text in texts(batch.column(1)):
                payload, n = payload_of(text)
                sizes.append(n)
                media.append(write_avi(payload))
            return [batch.column(0), sizes, media]

        return step

    return map_arrow(docs.select(id_column, text_column), make, f"{id_column} long, n_bytes long, media binary")


def clip_rows(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """A row per clip: id, clip, first_frame, frames, start_s, end_s."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, k, *c) for i, m in zip(f[id_column], f["media"]) for k, c in enumerate(clips_or_reason(m)[1])]
            yield pd.DataFrame(rows, columns=[id_column, "clip", "first_frame", "frames", "start_s", "end_s"])

    return media.select(id_column, "media").mapInPandas(run, f"{id_column} long, clip int, first_frame int, frames int, start_s double, end_s double")


def faults(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, reason) of each medium that can't be read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = f[[id_column]].assign(reason=[clips_or_reason(m)[2] for m in f["media"]])
            yield found[found["reason"].notna()]

    return media.select(id_column, "media").mapInPandas(run, f"{id_column} long, reason string")


def digest(media: DataFrame) -> DataFrame:
    """Of each stored medium: doc_id, n_bytes, digests of the payload that is read back and of the medium, and its clips as a string; nulls where it can't be read."""

    def make():
        def step(batch: pa.RecordBatch):
            out: list[tuple] = []
            for n, value in zip(batch.column(1).to_pylist(), batch.column(2)):
                medium = value.as_py()
                payload, found, _ = clips_or_reason(medium)
                if payload is None:
                    out.append((None,) * 6)
                    continue
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(medium), hashlib.sha256(medium).hexdigest(), " ".join(f"{a}+{n}@{s:.2f}" for a, n, s, _ in found)))
            return [batch.column(0), batch.column(1), *map(list, zip(*out))] if out else None

        return step

    return map_arrow(media.select("doc_id", "n_bytes", "media"), make, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
