"""Image files: PNG, BMP and TIFF by hand (zlib and struct), as functions of bytes, as columns, and as a sink.

Rasters are uint8, height x width x channels (1, 3 as B G R, 4 as B G R A); files hold R G B. Decoders raise ValueError
on what they do not know; as columns they give a row with ``error`` instead, so one bad file ends no batch.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.sources import page_files

DECODED = "path string, width int, height int, channels int, dpi int, pixels binary, error string"


def turned(v: np.ndarray) -> np.ndarray:
    """B G R[A] to R G B[A], and back."""
    return v if v.shape[2] == 1 else np.concatenate([v[:, :, 2::-1], v[:, :, 3:]], 2)


# ---- PNG
def png(v: np.ndarray, dpi: int = 300) -> bytes:
    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    h, w, c = v.shape
    rows = turned(v).reshape(h, w * c)
    body = np.concatenate([np.zeros((h, 1), np.uint8), rows], 1).tobytes()
    per_metre = round(dpi / 0.0254)
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1)) + chunk(b"IDAT", zlib.compress(body, 6)) + chunk(b"IEND", b"")


def unfilter(data: bytes, h: int, stride: int, bpp: int) -> np.ndarray:
    """Rows after the five filters of PNG."""
    raw = np.frombuffer(data, np.uint8)
    if len(raw) < h * (stride + 1):
        raise ValueError("short image data")
    raw = raw[: h * (stride + 1)].reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 0:
            row = line.copy()
        elif kind == 2:
            row = line + above
        elif kind == 1:
            row = np.empty(stride, np.uint8)
            for i in range(bpp):
                row[i::bpp] = np.cumsum(line[i::bpp], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            row = np.zeros(stride, np.int64)
            up = above.astype(np.int64)
            for x in range(stride):
                a = row[x - bpp] if x >= bpp else 0
                if kind == 3:
                    guess = (a + up[x]) >> 1
                else:
                    c = up[x - bpp] if x >= bpp else 0
                    p = a + up[x] - c
                    da, db, dc = abs(p - a), abs(p - up[x]), abs(p - c)
                    guess = a if da <= db and da <= dc else up[x] if db <= dc else c
                row[x] = (int(line[x]) + guess) & 255
            row = row.astype(np.uint8)
        else:
            raise ValueError("unknown row filter")
        out[y] = above = row
    return out


def from_png(data: bytes) -> tuple[np.ndarray, int]:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, dpi, head = 8, b"", 300, None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part, sum_ = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(sum_) < 4 or struct.unpack(">I", sum_)[0] != zlib.crc32(kind + part):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"pHYs" and part[8] == 1:
            dpi = round(struct.unpack(">I", part[:4])[0] * 0.0254)
        elif kind == b"IDAT":
            body += part
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("only 8-bit gray, RGB and RGBA without interlace")
    w, h, c = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    return turned(unfilter(zlib.decompress(body), h, w * c, c).reshape(h, w, c)), dpi


# ---- BMP
def bmp(v: np.ndarray, dpi: int = 300) -> bytes:
    """Rows bottom-up, padded to four bytes; gray with a palette of 256 levels."""
    h, w, c = v.shape
    stride = (w * c + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * c] = v.reshape(h, w * c)[::-1]
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if c == 1 else b""
    start, per_metre = 54 + len(palette), round(dpi / 0.0254)
    return struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 * c, 0, rows.size, per_metre, per_metre, 256 if c == 1 else 0, 0) + palette + rows.tobytes()


def from_bmp(data: bytes) -> tuple[np.ndarray, int]:
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("no BMP")
    start = struct.unpack("<I", data[10:14])[0]
    _, w, h, _, bits, packing, _, per_metre = struct.unpack("<IiiHHIIi", data[14:42])
    if packing or bits not in (8, 24, 32):
        raise ValueError("only plain BMP of 8, 24 or 32 bits")
    c = bits // 8
    stride, upward, h = (w * c + 3) // 4 * 4, h > 0, abs(h)
    if len(data) < start + stride * h:
        raise ValueError("short image data")
    rows = np.frombuffer(data, np.uint8, stride * h, start).reshape(h, stride)[:, : w * c].reshape(h, w, c)
    return np.ascontiguousarray(rows[::-1] if upward else rows), round(per_metre * 0.0254)


# ---- TIFF
#: Numbers of compressions and of the tags that are read or written.
PACKINGS = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, XRES, YRES, PLANAR, UNIT, PREDICTOR = 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 282, 283, 284, 296, 317
TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325


def packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        run = 1
        while run < 128 and i + run < len(data) and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i
        while j < len(data) and j - i < 128 and not (j + 1 < len(data) and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def from_packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n, i = data[i], i + 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, the highest first, widened one code early."""
    value, bits, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal value, bits
        value, bits = value << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(value >> bits & 255)
        value &= (1 << bits) - 1

    table, width = {bytes((i,)): i for i in range(256)}, 9
    put(256, width)
    following, held = 258, b""
    for i in range(len(data)):
        grown = held + data[i : i + 1]
        if grown in table:
            held = grown
            continue
        put(table[held], width)
        table[grown] = following
        following += 1
        width = max(width, (following).bit_length())
        if following == 4094:
            put(256, 12)
            table, width, following = {bytes((k,)): k for k in range(256)}, 9, 258
        held = data[i : i + 1]
    if held:
        put(table[held], width)
        width = max(width, (following + 1).bit_length())
    put(257, min(width, 12))
    if bits:
        out.append(value << 8 - bits & 255)
    return bytes(out)


def from_lzw(data: bytes) -> bytes:
    out, at, width, table, last = bytearray(), 0, 9, [], b""
    held, bits = 0, 0  # bits that are read and not yet used
    while True:
        while bits < width and at < len(data):
            held, bits, at = held << 8 | data[at], bits + 8, at + 1
        if bits < width:
            break
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table:
            raise ValueError("LZW data without a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise ValueError("broken LZW data")
        out += entry
        if last:
            table.append(last + entry[:1])
        width = min(12, max(9, (len(table) + 1).bit_length()))
        last = entry
    return bytes(out)


def squeeze(data: bytes, packing: str, w_bytes: int) -> bytes:
    if packing == "packbits":  # rows are packed one by one
        return b"".join(packbits(data[i : i + w_bytes]) for i in range(0, len(data), w_bytes))
    return {"none": lambda d: d, "lzw": lzw, "deflate": zlib.compress}[packing](data)


def tiff(v: np.ndarray, dpi: int = 300, packing: str = "deflate", description: str = "", rows: int = 128) -> bytes:
    """One little-endian page in strips of at most 128 rows; lzw and deflate with the horizontal predictor."""
    h, w, c = v.shape
    v = turned(v)
    predicted = packing in ("lzw", "deflate")
    if predicted:
        v = np.concatenate([v[:, :1], v[:, 1:] - v[:, :-1]], 1)
    rows = min(rows, 128)
    strips = [squeeze(v[y : y + rows].tobytes(), packing, w * c) for y in range(0, h, rows)]
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    tail, base = bytearray(), at + (at & 1)

    def far(body: bytes) -> int:
        where = base + len(tail)
        tail.extend(body + b"\0" * (len(body) & 1))
        return where

    entries = []

    def add(tag: int, kind: int, values: list[int]) -> None:
        form = {3: "H", 4: "I"}[kind]
        body = struct.pack(f"<{len(values)}{form}", *values)
        entries.append((tag, kind, len(values), body.ljust(4, b"\0") if len(body) <= 4 else struct.pack("<I", far(body))))

    add(WIDTH, 4, [w])
    add(HEIGHT, 4, [h])
    add(BITS, 3, [8] * c)
    add(COMPRESSION, 3, [PACKINGS[packing]])
    add(PHOTOMETRIC, 3, [1 if c == 1 else 2])
    if description:
        text = description.encode() + b"\0"
        entries.append((DESCRIPTION, 2, len(text), text.ljust(4, b"\0") if len(text) <= 4 else struct.pack("<I", far(text))))
    add(OFFSETS, 4, offsets)
    add(SAMPLES, 3, [c])
    add(ROWS, 4, [rows])
    add(COUNTS, 4, [len(s) for s in strips])
    for tag in (XRES, YRES):
        entries.append((tag, 5, 1, struct.pack("<I", far(struct.pack("<II", dpi, 1)))))
    add(PLANAR, 3, [1])
    add(UNIT, 3, [2])
    if predicted:
        add(PREDICTOR, 3, [2])
    if c == 4:
        add(338, 3, [2])
    head = struct.pack("<2sHI", b"II", 42, base + len(tail))
    body = b"".join(struct.pack("<HHI", t, k, n) + value for t, k, n, value in entries)
    return head + b"".join(strips) + b"\0" * (base - at) + bytes(tail) + struct.pack("<H", len(entries)) + body + b"\0\0\0\0"


def from_tiff(data: bytes) -> tuple[np.ndarray, int]:
    """The first page: strips or tiles, 8-bit samples side by side, or one-bit gray."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("no TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, list] = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
        size, form = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II")}.get(kind, (0, ""))
        if not size:
            continue
        here = at + 10 + 12 * i
        if size * n > 4:
            here = struct.unpack(order + "I", data[here : here + 4])[0]
        tags[tag] = list(struct.unpack(order + form * n, data[here : here + size * n]))
    w, h = tags[WIDTH][0], tags[HEIGHT][0]
    c, bits, packing = tags.get(SAMPLES, [1])[0], tags.get(BITS, [1])[0], tags.get(COMPRESSION, [1])[0]
    if tags.get(PLANAR, [1])[0] != 1 or bits not in (1, 8) or (bits == 1 and c != 1) or c not in (1, 3, 4):
        raise ValueError("planes or samples that are not read")
    open_ = {1: lambda d: d, 5: from_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: from_packbits}.get(packing)
    if open_ is None:
        raise ValueError(f"compression {packing} is not read")
    tw, th = (tags[TILE_W][0], tags[TILE_H][0]) if TILE_W in tags else (w, min(tags.get(ROWS, [h])[0], h))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if TILE_W in tags else (tags[OFFSETS], tags[COUNTS])
    across = -(-w // tw)
    page = np.zeros((h, w, c), np.uint8)
    for k, (o, n) in enumerate(zip(offsets, counts)):
        y, x = k // across * th, k % across * tw
        # the last strip ends with the page, a tile never does
        tall = th if TILE_W in tags else min(th, h - y)
        raw = np.frombuffer(open_(data[o : o + n]), np.uint8)
        wide = (tw + 7) // 8 if bits == 1 else tw * c
        if len(raw) < tall * wide:
            raise ValueError("short image data")
        part = raw[: tall * wide].reshape(tall, wide)
        part = np.unpackbits(part, axis=1)[:, :tw, None] * np.uint8(255) if bits == 1 else part.reshape(tall, tw, c)
        if tags.get(PREDICTOR, [1])[0] == 2:
            part = np.cumsum(part, 1, dtype=np.uint64).astype(np.uint8)
        page[y : y + tall, x : x + tw] = part[: h - y, : w - x]
    if tags.get(PHOTOMETRIC, [1])[0] == 0:
        page = 255 - page
    res = tags.get(XRES, [300, 1])
    dpi = res[0] / max(1, res[1]) * (2.54 if tags.get(UNIT, [2])[0] == 3 else 1)
    return turned(page), round(dpi)


DECODERS = ((b"\x89PNG", from_png), (b"BM", from_bmp), (b"II*\0", from_tiff), (b"MM\0*", from_tiff))
ENCODERS = {"png": png, "bmp": bmp, "tif": tiff}


def decode(data: bytes | None) -> tuple[np.ndarray, int]:
    for mark, f in DECODERS:
        if data and data.startswith(mark):
            return f(data)
    raise ValueError("unknown image format")


def decoded(files: DataFrame) -> DataFrame:
    """Rasters of files (path, content): a row each, with ``error`` and without pixels where one can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b.path, b.content):
                try:
                    v, dpi = decode(content)
                    rows.append((path, v.shape[1], v.shape[0], v.shape[2], dpi, v.tobytes(), None))
                except Exception as e:  # a damaged file is a row of its own, as bytes from outside may fail anywhere
                    rows.append((path, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "channels", "dpi", "pixels", "error"]).astype({c: "Int32" for c in ("width", "height", "channels", "dpi")})

    return files.select("path", "content").mapInPandas(run, DECODED)


def encoded(pages: DataFrame, form: str = "tif", dpi: int = 300, packing: str = "deflate", description: str = "") -> DataFrame:
    """page_id and the bytes of a file for each packed page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, w, h, c, pixels in zip(b.page_id, b.width, b.height, b.channels, b.pixels):
                v = np.frombuffer(pixels, np.uint8).reshape(h, w, c)
                rows.append((page, tiff(v, dpi, packing, description) if form == "tif" else ENCODERS[form](v, dpi)))
            yield pd.DataFrame(rows, columns=["page_id", "content"])

    return pages.select("page_id", "width", "height", "channels", "pixels").mapInPandas(run, "page_id bigint, content binary")


def save(files: DataFrame, folder: str) -> DataFrame:
    """Writes (name, content) into a folder by the sink of page files: all of them once all tasks have succeeded, or none. Returns the names."""
    page_files.write(files.select(F.lit(None).cast("string").alias("folder"), "name", "content", F.lit(None).cast("string").alias("error")), folder)
    return files.select("name")
