"""Luma of sequential JPEG files (baseline and extended, Huffman-coded).

Every coefficient of the scan is read, so a file that is cut off or whose codes
do not fit its tables raises ``ValueError``; only the luma is transformed back.
Progressive, arithmetic-coded and four-colour files give None.
"""

from __future__ import annotations

import re
import struct

import numpy as np

# Fixed value: the order in which coefficients are stored.
_ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
     35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
_SEQUENTIAL, _OTHER_FRAMES = (0xC0, 0xC1), (0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF)
_K = np.arange(8)
_BASIS = np.cos(np.pi * (2 * _K[:, None] + 1) * _K[None, :] / 16) * np.where(_K == 0, np.sqrt(0.125), 0.5)[None, :]
_MARK = re.compile(rb"\xff+[^\x00\xff]")


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits ahead: length * 256 + symbol of the code they begin
    with, or 0."""
    out, code, at = [0] * 65536, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            low = code << (16 - length)
            out[low : low + (1 << (16 - length))] = [length << 8 | symbols[at]] * (1 << (16 - length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Part:
    """One colour of the frame and its coefficients."""

    def __init__(self, name: int, across: int, down: int, table: int):
        self.name, self.across, self.down, self.table = name, across, down, table
        self.dc = self.ac = None
        self.last = 0


def _interval(data: bytes, blocks: list[tuple[_Part, int]], values: dict[int, list]) -> None:
    """Read the blocks (part, first coefficient) of one restart interval."""
    bits = 0
    held = 0
    at, size = 0, len(data)
    for part, place in blocks:
        out, k, table = values[part.name], 0, part.dc
        while k < 64:
            while held < 32:
                bits = bits << 8 | (data[at] if at < size else 0xFF)
                at += 1
                held += 8
            found = table[bits >> (held - 16) & 0xFFFF]
            if not found:
                raise ValueError("bad code")
            length, symbol = found >> 8, found & 255
            held -= length
            if k == 0:
                run, extra = 0, symbol
            else:
                run, extra = symbol >> 4, symbol & 15
                if not extra:
                    if run != 15:
                        break
                    k += 16
                    continue
            if extra > 16:
                raise ValueError("bad code")
            k += run
            if k > 63:
                raise ValueError("bad run")
            value = 0
            if extra:
                held -= extra
                value = bits >> held & ((1 << extra) - 1)
                if not value >> (extra - 1):
                    value -= (1 << extra) - 1
            bits &= (1 << held) - 1
            if k == 0:
                part.last += value
                value, table = part.last, part.ac
            out[place + k] = value
            k += 1
        if at - (held >> 3) > size:
            raise ValueError("short scan")


def luma(data: bytes) -> np.ndarray | None:
    at, quant, huff = 2, {}, {}
    frame: list[_Part] = []
    wide = high = restart = 0
    adobe = None
    values: dict[int, list] = {}
    shape: dict[int, tuple[int, int]] = {}
    read: set[int] = set()
    while at + 2 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark in (0xFF, 0x00, 0x01) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if mark == 0xD9:
            break
        if at + 4 > len(data):
            raise ValueError("short segment")
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) < size - 2:
            raise ValueError("short segment")
        at += 2 + size
        if mark == 0xDB:
            k = 0
            while k < len(body):
                wide_table, name = body[k] >> 4, body[k] & 15
                step = 128 if wide_table else 64
                quant[name] = np.frombuffer(body, ">u2" if wide_table else "u1", 64, k + 1).astype(float)
                k += 1 + step
        elif mark == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                huff[body[k]] = _codes(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif mark == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif mark == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif mark in _OTHER_FRAMES:
            if data.rfind(b"\xff\xd9", at) < 0:
                raise ValueError("no end of image")  # cut off: all that can be told without reading its scans
            return None
        elif mark in _SEQUENTIAL:
            depth, high, wide, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or n not in (1, 3) or not wide or not high:
                return None
            frame = [_Part(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            if n == 1:
                frame[0].across = frame[0].down = 1
            widest, tallest = max(p.across for p in frame), max(p.down for p in frame)
            if not min(min(p.across, p.down) for p in frame):
                raise ValueError("bad sampling")
            groups = (-(-wide // (8 * widest)), -(-high // (8 * tallest)))
            for p in frame:
                shape[p.name] = (groups[1] * p.down, groups[0] * p.across)
                values[p.name] = [0] * (64 * shape[p.name][0] * shape[p.name][1])
        elif mark == 0xDA:
            if not frame:
                raise ValueError("scan without a frame")
            n = body[0]
            parts = []
            for k in range(n):
                p = next((q for q in frame if q.name == body[1 + 2 * k]), None)
                tables = body[2 + 2 * k]
                if p is None or tables >> 4 not in huff or 16 | tables & 15 not in huff:
                    raise ValueError("bad scan")
                p.dc, p.ac = huff[tables >> 4], huff[16 | tables & 15]
                parts.append(p)
                read.add(p.name)
            if n == 1 and len(frame) > 1:
                p = parts[0]
                rows = -(-(-(-high * p.down // tallest)) // 8)
                columns = -(-(-(-wide * p.across // widest)) // 8)
                units = [[(p, 64 * (y * shape[p.name][1] + x))] for y in range(rows) for x in range(columns)]
            else:
                units = [
                    [(p, 64 * ((y * p.down + v) * shape[p.name][1] + x * p.across + h)) for p in parts for v in range(p.down) for h in range(p.across)]
                    for y in range(groups[1])
                    for x in range(groups[0])
                ]
            done = 0
            while done < len(units):
                end = _MARK.search(data, at)
                stop = end.start() if end else len(data)
                some = units[done : done + restart] if restart else units[done:]
                for p in parts:
                    p.last = 0
                _interval(data[at:stop].replace(b"\xff\x00", b"\xff"), [b for u in some for b in u], values)
                done += len(some)
                at = stop
                if done < len(units):
                    if end is None or not 0xD0 <= data[end.end() - 1] <= 0xD7:
                        raise ValueError("short scan")
                    at = end.end()
    # pictures whose end mark alone is missing are whole
    if not frame or read != {p.name for p in frame}:
        raise ValueError("short image data")

    def plane(p: _Part) -> np.ndarray:
        rows, columns = shape[p.name]
        stored = np.array(values[p.name], np.float64).reshape(-1, 64) * quant[p.table]
        block = np.empty_like(stored)
        block[:, _ZIGZAG] = stored
        pixels = _BASIS @ block.reshape(-1, 8, 8) @ _BASIS.T + 128.0
        pixels = np.clip(pixels, 0, 255).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        return pixels[: -(-high * p.down // tallest), : -(-wide * p.across // widest)]

    if len(frame) == 3 and adobe == 0:  # three colours instead of luma and two differences
        if len({(p.across, p.down) for p in frame}) > 1:
            return None
        return np.tensordot(np.array([0.299, 0.587, 0.114]), np.array([plane(p) for p in frame]), 1)
    return plane(frame[0])
