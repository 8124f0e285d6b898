"""Frames by their own segments: every predictor, restarts, baseline blocks with subsampled colour; media that can't be read."""

import struct

import numpy as np
import pytest

from vacancia.llm import avi, jpeg

CODES = {s: format(k, "08b") for k, s in enumerate([*range(12), 0xF0, *(r << 4 | k for r in range(4) for k in range(1, 8) if r)])}  # 8 bits a symbol


def segment(mark, body):
    return struct.pack(">HH", mark, len(body) + 2) + body


def tables(kinds=(0,)):
    return b"".join(segment(0xFFC4, bytes([k]) + bytes([0] * 7 + [len(CODES)] + [0] * 8) + bytes(CODES)) for k in kinds)


def coded(value):
    k = abs(value).bit_length()
    return CODES[k] + (format(value if value > 0 else value + (1 << k) - 1, f"0{k}b") if k else "")


def packed(bits):
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\x00")


def lossless(image, predictor, rows):
    """A frame whose prediction is told sample by sample, with a restart every so many rows."""
    height, width = image.shape
    p, parts = image.astype(int), []
    for top in range(0, height, rows):
        bits = ""
        for y in range(top, min(top + rows, height)):
            for x in range(width):
                if y == top:
                    guess = p[y, x - 1] if x else 128
                elif x == 0:
                    guess = p[y - 1, 0]
                else:
                    a, b, c = p[y, x - 1], p[y - 1, x], p[y - 1, x - 1]
                    guess = {1: a, 2: b, 3: c, 4: a + b - c, 5: a + (b - c) // 2, 6: b + (a - c) // 2, 7: (a + b) // 2}[predictor]
                bits += coded(int(p[y, x] - guess))
        parts.append(packed(bits))
    scan = b"".join((b"\xff" + bytes([0xD0 + (k - 1) % 8]) if k else b"") + x for k, x in enumerate(parts))
    head = b"\xff\xd8" + segment(0xFFE0, b"any") + tables() + segment(0xFFDD, struct.pack(">H", rows * width if rows < height else 0))
    return head + segment(0xFFC3, struct.pack(">BHHB", 8, height, width, 1) + bytes([7, 0x11, 0])) + segment(0xFFDA, bytes([1, 7, 0, predictor, 0, 0])) + scan + b"\xff\xd9"


@pytest.mark.parametrize("predictor", range(1, 8))
@pytest.mark.parametrize(("shape", "rows"), [((5, 7), 5), ((9, 3), 2), ((1, 1), 1)])
def test_lossless_frames_of_any_predictor(predictor, shape, rows):
    image = np.random.default_rng(predictor).integers(0, 256, shape).astype(np.uint8)
    assert (jpeg.decode(lossless(image, predictor, rows)) == image).all()


def test_frames_written_here_agree_with_their_segments():
    samples = np.random.default_rng(1).integers(0, 256, 3 * avi.FRAME).astype(np.uint8).tobytes()
    assert b"".join(jpeg.decode(j).tobytes() for j in avi.encode_frames(samples)) == samples


def baseline(blocks, height, width, parts, order, restart=0):
    """A frame of stated coefficients: blocks are {place in the scan: value} in the order of the scan, with their component."""
    bits, last, out = "", {}, []
    for k, (component, block) in enumerate(blocks):
        if restart and k and k % restart == 0:
            out, bits, last = [*out, packed(bits)], "", {}
        bits += coded(block.get(0, 0) - last.get(component, 0))
        last[component] = block.get(0, 0)
        at = 1
        for place in sorted(p for p in block if p):
            while place - at > 15:
                bits, at = bits + CODES[0xF0], at + 16
            v = block[place]
            k2 = abs(v).bit_length()
            bits += CODES[(place - at) << 4 | k2] + coded(v)[8:]
            at = place + 1
        if at < 64:
            bits += CODES[0]
    out.append(packed(bits))
    scan = b"".join((b"\xff" + bytes([0xD0 + (k - 1) % 8]) if k else b"") + x for k, x in enumerate(out))
    quant = segment(0xFFDB, bytes([0]) + bytes(range(1, 65)))
    frame = segment(0xFFC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes([c, f, 0]) for c, f in parts))
    return b"\xff\xd8" + quant + tables((0x00, 0x10)) + segment(0xFFDD, struct.pack(">H", restart)) + frame + segment(0xFFDA, bytes([len(parts)]) + b"".join(bytes([c, 0]) for c, _ in parts) + bytes([0, 63, 0])) + scan + b"\xff\xd9"


# The first places of the scan as (row, column).
PLACES = [(0, 0), (0, 1), (1, 0), (2, 0), (1, 1), (0, 2), (0, 3), (1, 2), (2, 1), (3, 0), (4, 0), (3, 1), (2, 2), (1, 3), (0, 4), (0, 5), (1, 4), (2, 3), (3, 2), (4, 1), (5, 0)]


def samples(block):
    """The inverse transform by its definition."""
    out = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            for place, value in block.items():
                v, u = PLACES[place]
                scale = (2**-0.5 if u == 0 else 1) * (2**-0.5 if v == 0 else 1) / 4
                out[y, x] += scale * value * (place + 1) * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    return np.clip(np.rint(out + 128), 0, 255)


BLOCKS = [{0: 300, 1: -20, 20: 3}, {0: -500, 4: 9}, {0: 0, 2: 30, 3: -5}, {0: 700, 18: -3}, {}, {0: 5, 17: 2}]


@pytest.mark.parametrize("restart", [0, 1, 2])
def test_baseline_frames_of_one_component(restart):
    found = jpeg.decode(baseline([(1, b) for b in BLOCKS], 14, 20, [(1, 0x21)], None, restart))
    want = np.block([[samples(b) for b in BLOCKS[:3]], [samples(b) for b in BLOCKS[3:]]])
    assert found.shape == (14, 20) and (found == want[:14, :20]).all()


def test_baseline_frames_with_subsampled_colour():
    scan = [(1, b) for b in BLOCKS[:4]] + [(2, {0: 9, 1: 7}), (3, {0: -3})]
    found = jpeg.decode(baseline(scan, 16, 15, [(1, 0x22), (2, 0x11), (3, 0x11)], None))
    want = np.block([[samples(BLOCKS[0]), samples(BLOCKS[1])], [samples(BLOCKS[2]), samples(BLOCKS[3])]])
    assert (found == want[:, :15]).all()


def film(frames, absolute=False):
    body, index, at = b"movi", b"", 4
    for f in frames:
        index += b"00db" + struct.pack("<III", 16, at + (20 if absolute else 0), len(f))
        c = b"00db" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) % 2)
        body, at = body + c, at + len(c)
    whole = b"AVI " + b"LIST" + struct.pack("<I", len(body)) + body + b"idx1" + struct.pack("<I", len(index)) + index
    return b"RIFF" + struct.pack("<I", len(whole)) + whole


@pytest.mark.parametrize("absolute", [False, True])
def test_films_of_other_writers(absolute):
    dark, light = baseline([(1, {0: -900})], 8, 8, [(1, 0x11)], None), baseline([(1, {0: 900})], 8, 8, [(1, 0x11)], None)
    payload, found, reason = avi.clips_or_reason(film([dark] * 12 + [light] * 9, absolute))
    assert len(payload) == 21 * 64 and [(a, n) for a, n, _, _ in found] == [(0, 12), (12, 9)] and reason is None


def test_media_that_cannot_be_read(spark):
    good = avi.write_avi(b"x" * 100)
    odd = lossless(np.zeros((4, 4), np.uint8), 1, 4)
    media = {1: b"", 2: good[:-9], 3: film([odd.replace(b"\xff\xc3", b"\xff\xc2")]), 4: film([odd[:-4]]), 5: film([b"\xff\xd8\xff\xd9"]), 6: None, 7: good, 8: film([odd.replace(tables(), b"")]), 9: film([])}
    df = spark.createDataFrame(list(media.items()), "doc_id long, media binary").selectExpr("doc_id", "5L AS n_bytes", "media")
    found = {r["doc_id"]: r["payload_bytes"] for r in avi.digest(df).collect()}
    assert len(found) == 9 and {k: n for k, n in found.items() if n is not None} == {7: 100, 9: 0}
    reasons = {r["doc_id"]: r["reason"] for r in avi.faults(df).collect()}
    assert set(reasons) == {1, 2, 3, 4, 5, 8} and all(reasons.values()) and "SOF2" in reasons[3]
    assert {r["doc_id"] for r in avi.clip_rows(df).collect()} == {7}
