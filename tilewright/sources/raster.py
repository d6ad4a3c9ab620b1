"""Raster tiles: kind and size from their first bytes, and the pixels of PNG images."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFO = T.StructType([T.StructField("kind", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])


def image_info(data: bytes | None) -> tuple[str, int, int] | None:
    """Kind, width and height of a PNG, JPEG or WebP image; None for anything else or a cut file."""
    try:
        if not data:
            return None
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return ("png", *struct.unpack(">II", data[16:24]))
        if data[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(data) and data[at] == 0xFF:
                kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                    return "jpeg", w, h
                at += 2 + size
            return None
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return "webp", 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
            if data[12:16] == b"VP8L":
                n = int.from_bytes(data[21:25], "little")
                return "webp", 1 + (n & 0x3FFF), 1 + (n >> 14 & 0x3FFF)
            if data[12:16] == b"VP8 ":
                w, h = struct.unpack("<HH", data[26:30])
                return "webp", w & 0x3FFF, h & 0x3FFF
    except struct.error:
        pass
    return None


def _info(payload: pd.Series) -> pd.DataFrame:
    rows = [image_info(None if p is None else bytes(p)) or (None, None, None) for p in payload]
    return pd.DataFrame({"kind": [r[0] for r in rows], "width": pd.array([r[1] for r in rows], "Int32"), "height": pd.array([r[2] for r in rows], "Int32")})


#: Struct kind, width, height of a column of images.
image_of = F.pandas_udf(_info, INFO)


def checked(payload):
    """The image's struct; an error where the bytes are no image."""
    info = image_of(payload)
    return F.when(info["kind"].isNotNull(), info).otherwise(F.raise_error(F.lit("no image that can be read")).cast(INFO))


#: Pixels row by row from the top, each with its channels: grey, grey and alpha, RGB or RGBA.
PIXELS = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("data", T.BinaryType())])


def unfiltered(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    """The bytes of all rows; each is stored as its difference from neighbours, by the method that its first byte names."""
    lines = np.frombuffer(raw[: rows * (stride + 1)], np.uint8).reshape(rows, stride + 1)
    out = np.zeros((rows + 1, stride + step), np.uint8)  # a row of zeros above, a pixel of zeros to the left
    for y in range(rows):
        how, line, above = lines[y, 0], lines[y, 1:], out[y]
        own = out[y + 1]
        if how in (0, 2):
            own[step:] = line + (above[step:] if how else 0)
        elif how == 1:
            own[step:] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel() if stride % step == 0 else line
        elif how in (3, 4):
            for x in range(step, stride + step):
                left, up, corner = int(own[x - step]), int(above[x]), int(above[x - step])
                guess = (left + up) // 2
                if how == 4:
                    d = (abs(up - corner), abs(left - corner), abs(left + up - 2 * corner))
                    guess = left if d[0] <= d[1] and d[0] <= d[2] else up if d[1] <= d[2] else corner
                own[x] = (int(line[x - step]) + guess) & 0xFF
        else:
            raise ValueError(f"filter {how}")
    return out[1:, step:]


def decode_png(data: bytes | None) -> tuple[int, int, int, bytes] | None:
    """Width, height, channels and pixels of a PNG of 8 bits a channel that isn't interlaced, palettes resolved; None for
    null, an error for anything else."""
    if data is None:
        return None
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG image")
    at, body, palette, alpha, head = 8, [], b"", b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if len(chunk) < size:
            raise ValueError("the image is cut short")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = chunk
        elif kind == b"tRNS":
            alpha = chunk
        elif kind == b"IDAT":
            body.append(chunk)
        elif kind == b"IEND":
            break
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("images of other than 8 bits a channel, and interlaced ones, can't be read")
    width, height, _, color = head[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as e:
        raise ValueError("the image is cut short or broken") from e
    if len(raw) < height * (width * channels + 1):
        raise ValueError("the image is cut short")
    pixels = unfiltered(raw, height, width * channels, channels)
    if color == 3:
        colors = np.frombuffer(palette, np.uint8).reshape(-1, 3)
        if alpha:
            own = np.full(len(colors), 255, np.uint8)
            own[: len(alpha)] = np.frombuffer(alpha, np.uint8)
            colors = np.column_stack([colors, own])
        pixels, channels = colors[pixels], colors.shape[1]
    return width, height, channels, pixels.tobytes()


def encode_png(width: int, height: int, channels: int, data: bytes, how: int = 0) -> bytes:
    """A PNG of pixels as PIXELS has them; ``how`` is the filter of all rows (0 none, 1 left, 2 above)."""
    rows = np.frombuffer(data, np.uint8).reshape(height, width * channels)
    before = np.zeros_like(rows)
    if how == 1:
        before[:, channels:] = rows[:, :-channels]
    elif how == 2:
        before[1:] = rows[:-1]
    raw = np.column_stack([np.full(height, how, np.uint8), rows - before]).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@F.arrow_udf(PIXELS)
def pixels_of(payload: pa.Array) -> pa.Array:
    """Pixels of a column of PNG images; null for null."""
    rows = [decode_png(None if p is None else bytes(p)) for p in payload.to_pylist()]
    cols = [pa.array([None if r is None else r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))]
    return pa.StructArray.from_arrays(cols, names=PIXELS.names, mask=pa.array([r is None for r in rows], pa.bool_()))
