"""Image headers and perceptual hashes without an imaging library.

Headers of PNG, JPEG, GIF, BMP, WebP, TIFF, PSD and ICO are read from their
bytes. Pixels are decoded for PNG, sequential JPEG, the first picture of a GIF,
uncompressed BMP and 8-bit TIFF (plain, deflated or packed). A file with a
sound header and no decoder here is ``unsupported``; whether it is whole is
then judged by its own marks only, where it has any.

Defined results: null, empty and very small content is corrupt; a path that
comes twice gets two equal rows; no files give no rows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfloom.catalog import HEIF, RAW
from shelfloom.functions.jpeg import luma
from shelfloom.runtime import ship

#: Extensions whose content this module cannot read at all.
NO_DECODER = frozenset([*RAW, *HEIF, ".svg", ".psd", ".ico"])


def codecs() -> dict[str, bool]:
    """The optional decoders, and whether they are there: neither is."""
    return {"raw": False, "heif": False}


def can_decode(ext: str) -> bool:
    """Whether files of an extension are judged by their pixels here."""
    return ext.lower() not in NO_DECODER and ext.lower() != ".webp"


SMALLEST = 50
# The sizes that the second header of a bitmap can have, and its bits a pixel.
BMP_HEADERS, BMP_BITS = frozenset([12, 40, 52, 56, 64, 108, 124]), frozenset([0, 1, 2, 4, 8, 16, 24, 32])
#: Pixels a side at most; more do not fit the columns of ``MEDIA``.
SIDE_LIMIT = (1 << 31) - 1


def header(data: bytes) -> tuple[int, int, str, str] | None:
    """(width, height, format, mode), or None if no header is understood. Two
    bytes at the start make no picture: one of 65,536 files of noise has them,
    so what follows must fit too."""
    found = _header(data)
    return None if found is None or max(found[:2]) > SIDE_LIMIT else found


def _header(data: bytes) -> tuple[int, int, str, str] | None:
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            w, h, _, kind = struct.unpack(">IIBB", data[16:26])
            return w, h, "PNG", {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(kind, "?")
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return *struct.unpack("<HH", data[6:10]), "GIF", "P"
        if data[:2] == b"BM":
            (size,) = struct.unpack("<I", data[14:18])
            w, h, planes, bits = struct.unpack("<HHHH", data[18:26]) if size == 12 else struct.unpack("<iiHH", data[18:30])
            if size in BMP_HEADERS and planes == 1 and bits in BMP_BITS:
                return w, abs(h), "BMP", "RGB" if bits >= 24 else "P"
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp(data)
        if data[:3] == b"\xff\xd8\xff":
            return _jpeg(data)
        if data[:4] in (b"II*\0", b"MM\0*"):
            tags = _tiff_tags(data)
            colours = {0: "L", 1: "L", 2: "RGB", 3: "P", 5: "CMYK"}.get(tags.get(262, [1])[0], "?")
            return tags[256][0], tags[257][0], "TIFF", colours
        if data[:4] == b"8BPS":
            h, w, _, kind = struct.unpack(">IIHH", data[14:26])
            return w, h, "PSD", {1: "L", 2: "P", 3: "RGB", 4: "CMYK"}.get(kind, "?")
        if data[:4] == b"\0\0\1\0" and struct.unpack("<H", data[4:6])[0]:
            return data[6] or 256, data[7] or 256, "ICO", "RGBA"
    except KeyError:
        pass
    except (struct.error, IndexError):
        pass
    return None


def _webp(data: bytes) -> tuple[int, int, str, str] | None:
    kind = data[12:16]
    if kind == b"VP8X":
        w, h = (int.from_bytes(data[k : k + 3], "little") + 1 for k in (24, 27))
        return w, h, "WEBP", "RGBA" if data[20] & 0x10 else "RGB"
    if kind == b"VP8 ":
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF, "WEBP", "RGB"
    if kind == b"VP8L":
        bits = int.from_bytes(data[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "WEBP", "RGBA"
    return None


def _jpeg(data: bytes) -> tuple[int, int, str, str] | None:
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark == 0xFF or 0xD0 <= mark <= 0xD9 or mark == 0x01:
            at += 1 if mark == 0xFF else 2
            continue
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w, n = struct.unpack(">HHB", data[at + 5 : at + 10])
            return w, h, "JPEG", {1: "L", 3: "RGB", 4: "CMYK"}.get(n, "?")
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


# The tags that hold text, by number.
TEXT_TAGS = {
    0x010D: "DocumentName", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x011D: "PageName", 0x0131: "Software", 0x0132: "DateTime",
    0x013B: "Artist", 0x013C: "HostComputer", 0x8298: "Copyright", 0x8824: "SpectralSensitivity", 0x9003: "DateTimeOriginal",
    0x9004: "DateTimeDigitized", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized", 0x9290: "SubsecTime",
    0x9291: "SubsecTimeOriginal", 0x9292: "SubsecTimeDigitized", 0xA004: "RelatedSoundFile", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName",
    0xA431: "BodySerialNumber", 0xA433: "LensMake", 0xA434: "LensModel", 0xA435: "LensSerialNumber",
}


def exif_tags(data: bytes) -> dict[str, str]:
    """Text tags of the main and Exif directories of a JPEG, PNG, WebP or TIFF
    file; tags without a known name go by their number."""
    body = _exif_body(data)
    order = {b"II": "<", b"MM": ">"}.get(body[:2])
    out: dict[str, str] = {}
    if order is None:
        return out

    def directory(at: int, depth: int) -> None:
        (n,) = struct.unpack_from(order + "H", body, at)
        for k in range(n):
            tag, kind, count, value = struct.unpack_from(order + "HHII", body, at + 2 + 12 * k)
            if tag == 0x8769 and not depth:
                directory(value, 1)
            elif kind == 2:
                place = value if count > 4 else at + 10 + 12 * k
                text = body[place : place + count].split(b"\0")[0].decode("latin-1").strip()
                if text:
                    out[TEXT_TAGS.get(tag, str(tag))] = text

    try:
        directory(struct.unpack_from(order + "I", body, 4)[0], 0)
    except struct.error:
        pass
    return out


def _exif_body(data: bytes) -> bytes:
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = data.find(b"Exif\0\0")
        return data[at + 6 :] if at >= 0 else b""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = data.find(b"eXIf")
        return data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]] if at >= 12 else b""
    if data[8:12] == b"WEBP":
        at = data.find(b"EXIF", 12)
        found = data[at + 8 :] if at >= 0 else b""
        return found[6:] if found[:6] == b"Exif\0\0" else found
    return b""


def _tiff_tags(data: bytes) -> dict[int, list[int]]:
    """Whole numbers of the first directory."""
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    (n,) = struct.unpack_from(order + "H", data, at)
    out = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        letter = {1: "B", 3: "H", 4: "I"}.get(kind)
        if letter and count <= 1 << 20:
            size = struct.calcsize(letter) * count
            place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            out[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, place))
    return out


def _unpacked(data: bytes) -> bytes:
    """Runs of bytes: a count and what follows, or one byte many times."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 1 if n == 128 else 2
    return bytes(out)


def _tiff(data: bytes) -> np.ndarray | None:
    tags = _tiff_tags(data)
    w, h, n = tags[256][0], tags[257][0], tags.get(277, [1])[0]
    packed, colours = tags.get(259, [1])[0], tags.get(262, [1])[0]
    read = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked}.get(packed)
    if set(tags.get(258, [1])) != {8} or read is None or tags.get(317, [1])[0] != 1 or tags.get(284, [1])[0] != 1 or 273 not in tags or colours not in (0, 1, 2) or n < (3 if colours == 2 else 1):
        return None
    parts = []
    for start, size in zip(tags[273], tags[279], strict=True):
        if start + size > len(data):
            raise ValueError("short strip")
        parts.append(read(data[start : start + size]))
    raw = b"".join(parts)
    if len(raw) < w * h * n:
        raise ValueError("short image data")
    pixels = np.frombuffer(raw, np.uint8, w * h * n).reshape(h, w, n).astype(float)
    if colours == 2:
        return pixels[:, :, :3]
    return np.repeat(255.0 - pixels[:, :, :1] if colours == 0 else pixels[:, :, :1], 3, axis=2)


def _gif(data: bytes) -> np.ndarray | None:
    """The first picture, on the colour that the file names as its ground."""
    w, h, flags, ground = struct.unpack_from("<HHBB", data, 6)
    at, table = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        table = np.frombuffer(data, np.uint8, 3 * n, 13).reshape(-1, 3)
        at += 3 * n
    while True:
        kind = data[at]
        if kind == 0x21:
            at += 2
            while data[at]:
                at += 1 + data[at]
            at += 1
        elif kind == 0x2C:
            break
        else:
            raise ValueError("no picture")
    left, top, wide, high, local = struct.unpack_from("<HHHHB", data, at + 1)
    at += 10
    if local & 0x80:
        n = 2 << (local & 7)
        table = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
        at += 3 * n
    if table is None:
        return None
    least, parts = data[at], []
    at += 1
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    found = _lzw(b"".join(parts), least)
    if len(found) < wide * high:
        raise ValueError("short image data")
    lines = np.frombuffer(found, np.uint8, wide * high).reshape(high, wide)
    if local & 0x40:
        order = np.concatenate([np.arange(a, high, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
        plain = np.empty_like(lines)
        plain[order] = lines
        lines = plain
    if lines.size and lines.max() >= len(table):
        raise ValueError("no such colour")
    out = np.tile(table[ground if ground < len(table) else 0].astype(float), (max(h, top + high), max(w, left + wide), 1))
    out[top : top + high, left : left + wide] = table[lines]
    return out[:h, :w]


def _lzw(data: bytes, least: int) -> bytes:
    clear, out = 1 << least, bytearray()
    words: list[bytes] = []
    width, last, bits, held = least + 1, None, 0, 0
    for byte in data:
        bits |= byte << held
        held += 8
        while held >= width:
            code = bits & ((1 << width) - 1)
            bits >>= width
            held -= width
            if code == clear:
                words, width, last = [bytes([k]) for k in range(clear)] + [b"", b""], least + 1, None
                continue
            if code == clear + 1:
                return bytes(out)
            if last is None:
                if code >= len(words):
                    raise ValueError("bad code")
                last = words[code]
                out += last
                continue
            if code < len(words):
                word = words[code]
            elif code == len(words):
                word = last + last[:1]
            else:
                raise ValueError("bad code")
            out += word
            if len(words) < 4096:
                words.append(last + word[:1])
                if len(words) == 1 << width and width < 12:
                    width += 1
            last = word
    return bytes(out)


def grey(data: bytes) -> np.ndarray | None:
    """Luma of the pixels as floats; None where this module has no decoder.
    Broken data raises ValueError."""
    found = header(data)
    if found is None:
        return None
    if found[2] == "JPEG":
        return luma(data)
    if found[2] == "WEBP" and len(data) < 8 + struct.unpack_from("<I", data, 4)[0]:
        raise ValueError("short file")
    read = {"PNG": _png, "BMP": _bmp, "GIF": _gif, "TIFF": _tiff}.get(found[2])
    rgb = read(data) if read else None
    return None if rgb is None else rgb @ np.array([0.299, 0.587, 0.114])


def _bmp(data: bytes) -> np.ndarray | None:
    offset, size = struct.unpack_from("<II", data, 10)
    w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
    if size == 12 or bits not in (24, 32) or packed not in (0, 3):
        return None
    step = (w * bits // 8 + 3) // 4 * 4
    if len(data) < offset + step * abs(h):
        raise ValueError("short bitmap")
    rows = np.frombuffer(data, np.uint8, step * abs(h), offset).reshape(abs(h), step)
    pixels = rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1].astype(float)
    return pixels[::-1] if h > 0 else pixels


def _png(data: bytes) -> np.ndarray | None:
    w, h, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", data[16:29])
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if n is None or depth not in (1, 2, 4, 8, 16) or laced > 1 or depth < 8 and n > 1:
        return None
    at, packed, palette, ended = 8, [], None, False
    while at + 12 <= len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise ValueError("short chunk")
        if name == b"IDAT":
            packed.append(body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(float)
        elif name == b"IEND":
            ended = True
            break
        at += 12 + size
    if not ended:
        raise ValueError("no end of image")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise ValueError(str(e)) from e
    out, at = np.zeros((h, w, n), np.uint8), 0
    # The seven passes of an interlaced picture.
    passes = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)) if laced else ((0, 0, 1, 1),)
    for top, left, down, across in passes:
        rows, columns = len(range(top, h, down)), len(range(left, w, across))
        if rows and columns:
            found, at = _lines(raw, at, rows, columns, n, depth)
            out[top::down, left::across] = found
    if kind == 3:
        if palette is None or out.size and out.max() >= len(palette):
            raise ValueError("no such colour")
        return palette[out[:, :, 0]]
    if depth < 8:
        out = (out * (255 // ((1 << depth) - 1))).astype(np.uint8)
    pixels = out.astype(float)
    return pixels[:, :, :3] if n >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)


def _lines(raw: bytes, at: int, rows: int, columns: int, n: int, depth: int) -> tuple[np.ndarray, int]:
    """Samples of one pass as bytes (the high one of two), and where it ends."""
    step = (columns * n * depth + 7) // 8
    if len(raw) < at + rows * (step + 1):
        raise ValueError("short image data")
    lines = np.frombuffer(raw, np.uint8, rows * (step + 1), at).reshape(rows, step + 1)
    whole = max(1, n * depth // 8)
    out, above = np.zeros((rows, step), np.uint8), np.zeros(step, np.int32)
    for y in range(rows):
        if lines[y, 0] > 4:
            raise ValueError("no such filter")
        above = _unfiltered(int(lines[y, 0]), lines[y, 1:].astype(np.int32), above, whole)
        out[y] = above
    if depth == 16:
        out = out[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(out, axis=1).reshape(rows, -1, depth)
        out = bits @ (1 << np.arange(depth - 1, -1, -1)).astype(np.uint8)
    return out[:, : columns * n].reshape(rows, columns, n), at + rows * (step + 1)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 2:
        return (line + above) & 255
    if kind == 1:
        padded = np.concatenate([line, np.zeros(-len(line) % n, np.int32)])
        return (np.cumsum(padded.reshape(-1, n), axis=0).reshape(-1) & 255)[: len(line)]
    out = line.copy()
    for i in range(len(line)):
        a = int(out[i - n]) if i >= n else 0
        b, c = int(above[i]), int(above[i - n]) if i >= n else 0
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return out


def resized(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target pixel."""

    def weights(size: int, target: int) -> np.ndarray:
        edges = np.linspace(0, size, target + 1)
        place = np.arange(size)
        w = np.clip(np.minimum(edges[1:, None], place + 1) - np.maximum(edges[:-1, None], place), 0, None)
        return w / w.sum(axis=1, keepdims=True)

    return weights(pixels.shape[0], height) @ pixels @ weights(pixels.shape[1], width).T


def _words(bits: np.ndarray) -> list[int]:
    flat = bits.reshape(-1)
    padded = np.concatenate([np.zeros(-len(flat) % 64, bool), flat])
    return [int(w) for w in np.packbits(padded).view(">i8")]


def phash(pixels: np.ndarray, side: int = 8) -> list[int]:
    """DCT hash: low frequencies of a four times larger thumbnail, by median."""
    size = 4 * side
    small = resized(pixels, size, size)
    k = np.arange(size)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * size))
    low = (basis @ small @ basis.T)[:side, :side]
    return _words(low > np.median(low))


def dhash(pixels: np.ndarray, side: int = 8) -> list[int]:
    """Whether each pixel of a thumbnail is darker than its right neighbour."""
    small = resized(pixels, side, side + 1)
    return _words(small[:, 1:] > small[:, :-1])


BROKEN = (ValueError, struct.error, IndexError, TypeError, KeyError, zlib.error)


def judged(data: bytes | None, ext: str) -> tuple[str, np.ndarray | None]:
    """ok, corrupt or unsupported, and the luma where it is ok."""
    if data is None or len(data) < SMALLEST:
        return "corrupt", None
    found = header(data)
    if found is None:
        return "unsupported" if ext in NO_DECODER else "corrupt", None
    if found[0] <= 0 or found[1] <= 0:
        return "corrupt", None
    try:
        pixels = grey(data)
    except BROKEN:
        return "corrupt", None
    return ("unsupported", None) if pixels is None else ("ok", pixels)


def verdict(data: bytes | None, ext: str) -> str:
    return judged(data, ext)[0]


MEDIA = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("format", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("exif", T.MapType(T.StringType(), T.StringType())),
        T.StructField("verdict", T.StringType()),
        T.StructField("phash", T.ArrayType(T.LongType())),
        T.StructField("dhash", T.ArrayType(T.LongType())),
    ]
)


def media(files: DataFrame, side: int = 8, pixels: bool = True) -> DataFrame:
    """(path, *MEDIA) of every row of ``files`` (path, ext, content[, size]).
    Hashes are null where the pixels cannot be decoded here; ``side`` is that of
    the scan mode (``config.HASH_SIDE``). A file whose ``size`` is more than a row
    holds has its header read by its path, and is ``unsupported`` whatever that
    says: it was not read, so nothing is known against it. Without ``pixels`` only
    headers and tags are read, and verdict and hashes are null."""
    import pandas as pd

    from shelfloom.sources.files import BIG, head

    ship(files.sparkSession)
    names = ["path", *MEDIA.fieldNames()]

    def run(frames):
        for frame in frames:
            rows = []
            for path, ext, data, size in frame.itertuples(index=False):
                big = data is None and size == size and size is not None and size > BIG
                data = head(path) if big else data
                found = header(data) if data else None
                state, luma_ = (None, None) if not pixels else ("unsupported", None) if big else judged(data, (ext or "").lower())
                w, h, fmt, mode = found or (None, None, None, None)
                two = (phash(luma_, side), dhash(luma_, side)) if luma_ is not None else (None, None)
                rows.append((path, w, h, fmt, mode, exif_tags(data) if data else {}, state, *two))
            yield pd.DataFrame(rows, columns=names).astype({"width": "Int32", "height": "Int32"})

    schema = T.StructType([T.StructField("path", T.StringType()), *MEDIA.fields])
    size = F.col("size") if "size" in files.columns else F.lit(None)
    return files.select("path", "ext", "content", size.cast("long").alias("size")).mapInPandas(run, schema)
