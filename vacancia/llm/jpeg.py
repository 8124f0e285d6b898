"""Intra frames of motion JPEG of any writer, read by their own segments (ITU-T T.81): tables, frame and scan headers, restarts.

Read are sequential Huffman frames: lossless ones of one 8-bit component (SOF3, predictors 1 to 7) and baseline or extended
ones of 8 bits (SOF0, SOF1) with up to four components in one scan, of which the first (the luminance) is returned. Frames of other
codings, without their own tables, or cut short are Unreadable, with a reason.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np


class Unreadable(ValueError):
    """A medium or a frame that can't be read, and why."""


@lru_cache(64)
def _lookup(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits the code that they begin with, as length << 8 | symbol; 0 where there is none."""
    table, code, k = np.zeros(1 << 16, np.int64), 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            if code >= 1 << n:
                raise Unreadable("a Huffman table of too many codes")
            table[code << 16 - n : code + 1 << 16 - n] = n << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table.tolist()


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(4), 0, 8 * len(data)

    def _peek(self) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 4]) << (self.at & 7) & 0xFFFFFFFF) >> 16

    def symbol(self, table: list[int]) -> int:
        found = table[self._peek()]
        self.at += found >> 8
        if not found or self.at > self.end:
            raise Unreadable("a scan is cut short or holds no code of its table")
        return found & 255

    def extra(self, k: int) -> int:
        """A signed value of a category."""
        if k == 0:
            return 0
        v = self._peek() >> 16 - k
        self.at += k
        if self.at > self.end:
            raise Unreadable("a scan is cut short")
        return v if v >> k - 1 else v - (1 << k) + 1


def _intervals(data: bytes) -> list[bytes]:
    """A scan's bytes between restart markers, without stuffed zeros."""
    out, begin, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        mark = data[at + 1] if 0 <= at < len(data) - 1 else -1
        if mark == 0:
            at += 2
            continue
        if mark == 0xFF:
            at += 1
            continue
        out.append(data[begin : at if at >= 0 else len(data)].replace(b"\xff\x00", b"\xff"))
        if not 0xD0 <= mark <= 0xD7:
            return out
        begin = at = at + 2


def decode(jpeg: bytes) -> np.ndarray:
    """The samples of a frame's first component, a row each."""
    try:
        return _decode(jpeg)
    except (struct.error, IndexError, KeyError) as e:
        raise Unreadable(f"a frame is cut short or lacks a table ({type(e).__name__})") from None


def _decode(jpeg: bytes) -> np.ndarray:
    if jpeg[:2] != b"\xff\xd8":
        raise Unreadable("no JPEG frame")
    at, huffman, steps, frame, restart = 2, {}, {}, None, 0
    while True:
        mark, size = struct.unpack_from(">HH", jpeg, at)
        if mark < 0xFF01:
            raise Unreadable("no marker where one should be")
        if mark == 0xFFFF:
            at += 1
            continue
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xFFC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark == 0xFFDB:
            while body:
                wide = body[0] >> 4
                steps[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else ">u1").astype(np.float64)
                body = body[65 + 64 * wide :]
        elif mark == 0xFFDD:
            restart = struct.unpack(">H", body)[0]
        elif mark in (0xFFC0, 0xFFC1, 0xFFC3):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            frame = (mark == 0xFFC3, height, width, {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)})
            if bits != 8 or not height or not width or not 1 <= n <= 4:
                raise Unreadable("a frame of a geometry that isn't read")
        elif 0xFFC0 < mark <= 0xFFCF and mark not in (0xFFC8, 0xFFCC):
            raise Unreadable(f"a frame of a coding that isn't read (SOF{mark & 15})")
        elif mark == 0xFFDA:
            break
    if frame is None:
        raise Unreadable("a scan without a frame")
    lossless, height, width, parts = frame
    scan = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
    first, approximation = body[-3], body[-1]
    tables = lambda s, kind: _lookup(*huffman[kind << 4 | (s[1] & 15 if kind else s[1] >> 4)])
    if [s[0] for s in scan] != list(parts) or approximation:
        raise Unreadable("components in several scans, or a point transform")
    streams = [_Bits(x) for x in _intervals(jpeg[at:])]
    if lossless:
        if len(scan) > 1 or not 1 <= first <= 7:
            raise Unreadable("a lossless frame of several components")
        return _lossless(streams, tables(scan[0], 0), height, width, first, restart)
    return _blocks(streams, [(*parts[s[0]], tables(s, 0), tables(s, 1)) for s in scan], steps, height, width, restart)


def _lossless(streams: list[_Bits], table: list[int], height: int, width: int, predictor: int, restart: int) -> np.ndarray:
    if restart % width:
        raise Unreadable("a restart within a row")
    out, rows, bits = [], restart // width or height, None
    for y in range(height):
        if y % rows == 0:
            bits, above = streams[y // rows], None
        row: list[int] = []
        for x in range(width):
            if above is None:
                guess = row[-1] if x else 128
            elif not x:
                guess = above[0]
            else:
                a, b, c = row[-1], above[x], above[x - 1]
                guess = (a, b, c, a + b - c, a + (b - c >> 1), b + (a - c >> 1), a + b >> 1)[predictor - 1]
            row.append(guess + bits.extra(bits.symbol(table)) & 255)
        out.append(row)
        above = row
    return np.array(out, np.uint8)


def _order() -> np.ndarray:
    """The place, in rows of eight, of each coefficient in the order of a scan: along diagonals, turn about."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


_ZIGZAG = _order()
_COSINES = np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16) / 2
_COSINES[0] /= np.sqrt(2)


def _blocks(streams: list[_Bits], parts: list[tuple], steps: dict, height: int, width: int, restart: int) -> np.ndarray:
    across, down = max(p[0] for p in parts), max(p[1] for p in parts)
    h, v = parts[0][:2]
    tall, wide = -(-height * v // down), -(-width * h // across)  # of the first component
    if len(parts) == 1:
        h = v = 1
        units_wide, units = -(-wide // 8), -(-wide // 8) * -(-tall // 8)
        parts = [(1, 1, *parts[0][2:])]
    else:
        units_wide, units = -(-width // (8 * across)), -(-width // (8 * across)) * -(-height // (8 * down))
    held = np.zeros((units // units_wide * v, units_wide * h, 64))
    for unit in range(units):
        if unit % (restart or units) == 0:
            bits, last = streams[unit // (restart or units)], [0] * len(parts)
        for k, (n, m, _, direct, others) in enumerate(parts):
            for block in range(n * m):
                last[k] += bits.extra(bits.symbol(direct))
                place, found = 1, {0: last[k]}
                while place < 64:
                    s = bits.symbol(others)
                    if s & 15:
                        place += s >> 4
                        found[place] = bits.extra(s & 15)
                    elif s != 0xF0:
                        break
                    else:
                        place += 15
                    place += 1
                if k == 0:
                    held[unit // units_wide * v + block // h, unit % units_wide * h + block % h, list(found)] = list(found.values())
    coefficients = np.zeros_like(held)
    coefficients[:, :, _ZIGZAG] = held * steps[parts[0][2]]
    samples = _COSINES.T @ coefficients.reshape(*held.shape[:2], 8, 8) @ _COSINES + 128
    image = np.clip(np.rint(samples), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(held.shape[0] * 8, held.shape[1] * 8)
    return image[:tall, :wide]
