"""What a picture says of itself: size, white and edge shares, difference hash. Python is needed for decoding only."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PROBE = "struct<width:int,height:int,white:double,edges:double,dhash:bigint>"


class MissingDecoder(RuntimeError):
    """A picture of a known kind that nothing here can read; unlike broken bytes, this is no property of the picture."""


# How the kinds of pictures begin that need Pillow.
BEGINNINGS = {b"\xff\xd8\xff": "JPEG", b"BM": "BMP", b"II*\0": "TIFF", b"MM\0*": "TIFF", b"GIF8": "GIF"}


def decode_color(content: bytes | None) -> np.ndarray | None:
    """Height x width x 3 values of a picture (red, green, blue), or null if it is broken.

    Binary PGM and PPM, plain PNG and plain BMP are read here, all else by Pillow; a kind that
    only Pillow reads is an error where it isn't installed, not a broken picture.
    """
    if not content:
        return None
    kind = next((k for start, k in BEGINNINGS.items() if content.startswith(start)), "WebP" if content[:4] == b"RIFF" and content[8:12] == b"WEBP" else None)
    try:
        if content[:2] in (b"P5", b"P6"):
            return _netpbm(content)
        if content[:8] == PNG:
            return _png(content)
        if kind == "BMP" and (plain := _bmp(content)) is not None:
            return plain
    except NotImplementedError:
        kind = "PNG"
    except (ValueError, KeyError, IndexError, struct.error, zlib.error):
        return None
    if kind is None:
        return None
    try:
        from PIL import Image
    except ImportError as e:
        raise MissingDecoder(f"a {kind} picture of this kind needs Pillow, which isn't installed on this executor") from e
    try:
        return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"), np.float64)
    except (OSError, ValueError, SyntaxError):
        return None


def decode(content: bytes | None) -> np.ndarray | None:
    """Grey values of a picture, or null if it is broken."""
    c = decode_color(content)
    if c is None:
        return None
    return c[:, :, 0] if (c[:, :, 0] == c[:, :, 1]).all() and (c[:, :, 0] == c[:, :, 2]).all() else c @ GREY


def _netpbm(content: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while content[at : at + 1].isspace():
            at += 1
        end = at
        while end < len(content) and not content[end : end + 1].isspace():
            end += 1
        fields.append(int(content[at:end]))
        at = end
    w, h, _ = fields
    planes = 3 if content[1:2] == b"6" else 1
    a = np.frombuffer(content, np.uint8, w * h * planes, at + 1).reshape(h, w, planes).astype(np.float64)
    return np.repeat(a, 3, axis=2) if planes == 1 else a


def _bmp(content: bytes) -> np.ndarray | None:
    """An uncompressed BMP of 8 (palette), 24 or 32 bits a pixel; null for other kinds."""
    start, head, w, h, _, bits, packed = struct.unpack_from("<I I i i H H I", content, 10)
    if packed or bits not in (8, 24, 32):
        return None
    line = (w * bits // 8 + 3) // 4 * 4
    raw = np.frombuffer(content, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * bits // 8]
    raw = raw if h < 0 else raw[::-1]  # rows go up unless the height is negative
    if bits == 8:
        colors = np.frombuffer(content[14 + head : start], np.uint8).reshape(-1, 4)[:, 2::-1]
        return colors[raw].astype(np.float64)
    return raw.reshape(abs(h), w, bits // 8)[:, :, 2::-1].astype(np.float64)


PNG = b"\x89PNG\r\n\x1a\n"
GREY = np.array([0.299, 0.587, 0.114])


def _png(content: bytes) -> np.ndarray:
    """Colours of a PNG of 8 bits a sample that isn't interlaced: grey, colour or palette, with or without alpha."""
    at, data, head, palette = 8, [], b"", b""
    while at < len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        head, palette = body if kind == b"IHDR" else head, body if kind == b"PLTE" else palette
        data += [body] if kind == b"IDAT" else []
        at += 12 + n
    w, h, bits, kind, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    if bits != 8 or interlaced:
        raise NotImplementedError("an interlaced PNG or one of other than 8 bits a sample")
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * planes)
    out = np.zeros((h + 1, (w + 1) * planes), np.int64)  # a row above and a pixel to the left of zeros
    for y in range(h):
        how, line, up = raw[y, 0], raw[y, 1:].astype(np.int64), out[y]
        if how == 0:
            out[y + 1, planes:] = line
        elif how == 1:
            out[y + 1, planes:] = np.cumsum(line.reshape(w, planes), axis=0).ravel() & 255
        elif how == 2:
            out[y + 1, planes:] = (line + up[planes:]) & 255
        else:
            row = out[y + 1]
            for i in range(w * planes):
                a, b, c = int(row[i]), int(up[i + planes]), int(up[i])
                if how == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                row[i + planes] = (int(line[i]) + guess) & 255
    pixels = out[1:, planes:].reshape(h, w, planes).astype(np.float64)
    if kind == 3:
        return np.frombuffer(palette, np.uint8).reshape(-1, 3).astype(np.float64)[pixels[:, :, 0].astype(int)]
    return np.repeat(pixels[:, :, :1], 3, axis=2) if planes < 3 else pixels[:, :, :3]


def encode_color(pixels: np.ndarray) -> bytes:
    """A colour picture as a binary PPM."""
    h, w, _ = pixels.shape
    return b"P6 %d %d 255\n" % (w, h) + np.clip(np.rint(pixels), 0, 255).astype(np.uint8).tobytes()


def encode(grey: np.ndarray, suffix: str = ".png") -> bytes:
    """A grey picture as a file of this suffix: .pgm, .png, and what else Pillow writes where it is installed; an unknown suffix is a JPEG there."""
    pixels = np.clip(np.rint(grey), 0, 255).astype(np.uint8)
    h, w = pixels.shape
    if suffix == ".pgm":
        return b"P5 %d %d 255\n" % (w, h) + pixels.tobytes()
    if suffix == ".png":
        lines = np.hstack([np.zeros((h, 1), np.uint8), pixels]).tobytes()
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    from PIL import Image

    out = io.BytesIO()
    known = {".bmp": "BMP", ".webp": "WEBP", ".tif": "TIFF", ".tiff": "TIFF"}
    Image.fromarray(pixels).save(out, known.get(suffix, "JPEG"))
    return out.getvalue()


def area_resized(grey: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean over the area that each target cell covers, parts of pixels by their share."""

    def shares(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        at = np.arange(n)
        cover = np.clip(np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at), 0, None)
        return cover / cover.sum(1, keepdims=True)

    return shares(grey.shape[0], rows) @ grey @ shares(grey.shape[1], columns).T


def difference_hash(grey: np.ndarray) -> int:
    """64 bits, set where a cell is brighter than its left neighbour, as a signed number."""
    small = np.rint(area_resized(grey, 8, 9))
    x = int("".join("1" if b else "0" for b in (small[:, 1:] > small[:, :-1]).ravel()), 2)
    return x - (1 << 64) if x >> 63 else x


#: Gradients (of the Sobel masks, as the sum of both sides) from which an edge is followed, and from which it starts.
WEAK_EDGE, STRONG_EDGE = 80.0, 160.0


def edge_pixels(grey: np.ndarray, weak: float = WEAK_EDGE, strong: float = STRONG_EDGE) -> np.ndarray:
    """Edges by Sobel gradients, thinned across their direction, followed from strong pixels through weak ones."""
    h, w = grey.shape
    p = np.pad(np.rint(grey).astype(np.int64), 1, mode="edge")
    column = lambda k: p[:-2, k : k + w] + 2 * p[1:-1, k : k + w] + p[2:, k : k + w]
    row = lambda k: p[k : k + h, :-2] + 2 * p[k : k + h, 1:-1] + p[k : k + h, 2:]
    gx, gy = column(2) - column(0), row(2) - row(0)
    size = np.abs(gx) + np.abs(gy)
    around = np.pad(size, 1)
    at = lambda dy, dx: around[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
    flat, steep = np.abs(gy) < np.abs(gx) * np.tan(np.pi / 8), np.abs(gy) > np.abs(gx) * np.tan(3 * np.pi / 8)
    falling = (gx < 0) != (gy < 0)
    before = np.select([flat, steep, falling], [at(0, -1), at(-1, 0), at(-1, 1)], at(-1, -1))
    after = np.select([flat, steep, falling], [at(0, 1), at(1, 0), at(1, -1)], at(1, 1))
    ridge = (size > before) & np.where(flat | steep, size >= after, size > after) & (size > weak)
    out, edge = np.zeros((h, w), bool), ridge & (size > strong)
    while edge.any():  # grow into weak ridges next to edges found
        out |= edge
        near = np.pad(edge, 1)
        grown = np.zeros((h, w), bool)
        for dy in range(3):
            for dx in range(3):
                grown |= near[dy : dy + h, dx : dx + w]
        edge = grown & ridge & ~out
    return out


def edge_share(grey: np.ndarray) -> float:
    """Share of edge pixels."""
    return float(edge_pixels(grey).mean())


def probe(content: Column, decoder: Callable[[bytes | None], np.ndarray | None] = decode) -> Column:
    """struct(width, height, white, edges, dhash) of encoded pictures; null where they can't be decoded."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content in batch:
                g = decoder(bytes(content) if content is not None else None)
                rows.append((None,) * 5 if g is None else (g.shape[1], g.shape[0], float((g > 245).mean()), edge_share(g), difference_hash(g)))
            out = pd.DataFrame(rows, columns=["width", "height", "white", "edges", "dhash"])
            yield out.astype({"width": "Int32", "height": "Int32", "dhash": "Int64"})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, PROBE)(content)
