"""Scoring of pictures by a detector: decoded, letterboxed and scored in batches by the executors.

A detector is loaded once a worker by a function that takes no arguments, so a model of any
size is read where it is used and never sent with the tasks. It gets batches of pictures of
one size and gives their boxes in the pixels of that size; boxes come back in the pixels of
the picture itself, cut to it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from time import perf_counter
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..functions.raster import GREY, decode_color
from ..schemas import CLASS_NAMES

#: Side of the square that a detector sees, the grey around a picture in it, and the pictures of a batch.
SIDE, PADDING, BATCH = 640, 114, 16
#: Encoded bytes of the pictures that are decoded together at most, but for a single larger one.
BATCH_BYTES = 32 << 20

PRED = "array<struct<class:string,confidence:double,bbox:array<double>>>"


class Detector(Protocol):
    """side: of the square it wants; version: named in the log; called with pictures (n, side, side, 3) of bytes, it gives n arrays of rows x1, y1, x2, y2, confidence, class id."""

    side: int
    version: str

    def __call__(self, pictures: np.ndarray) -> list[np.ndarray]: ...


def letterbox(picture: np.ndarray, side: int) -> tuple[np.ndarray, float, int, int]:
    """The picture scaled to fit a square, in the middle of grey; the scale and the place of its corner."""
    h, w = picture.shape[:2]
    scale = min(side / h, side / w)
    rows, columns = max(1, round(h * scale)), max(1, round(w * scale))
    top, left = (side - rows) // 2, (side - columns) // 2

    def between(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = between(h, rows), between(w, columns)
    lines = picture[y0] * (1 - fy)[:, None, None] + picture[y1] * fy[:, None, None]
    scaled = lines[:, x0] * (1 - fx)[:, None] + lines[:, x1] * fx[:, None]
    out = np.full((side, side, 3), PADDING, np.uint8)
    out[top : top + rows, left : left + columns] = np.clip(np.rint(scaled), 0, 255)
    return out, scale, left, top


def restored(boxes: np.ndarray, scale: float, left: int, top: int, width: int, height: int) -> np.ndarray:
    """Boxes of a letterboxed picture in the picture's own pixels, cut to it; those that lie outside go."""
    out = boxes.astype(np.float64).copy()
    out[:, [0, 2]] = np.clip((out[:, [0, 2]] - left) / scale, 0, width)
    out[:, [1, 3]] = np.clip((out[:, [1, 3]] - top) / scale, 0, height)
    return out[(out[:, 2] > out[:, 0]) & (out[:, 3] > out[:, 1])]


class DarkSpots:
    """A detector without weights: one box around each connected dark region, sure in proportion to its darkness.

    The class follows from the region's shape: wide ones are scratches, tall ones weld cracks,
    all others weld pores. For tests and for trying out the jobs.
    """

    def __init__(self, side: int = SIDE, level: int = 60, least_pixels: int = 12) -> None:
        self.side, self.level, self.least_pixels = side, level, least_pixels
        self.version = f"dark-spots:{level}"

    def __call__(self, pictures: np.ndarray) -> list[np.ndarray]:
        return [self._one(p.astype(np.float64) @ GREY) for p in pictures]

    def _one(self, grey: np.ndarray) -> np.ndarray:
        label = regions(grey < self.level)
        ys, xs = np.nonzero(label)
        of = label[ys, xs]
        n = int(label.max(initial=0)) + 1
        count = np.bincount(of, minlength=n)
        low, high = np.full((n, 2), self.side), np.zeros((n, 2), int)
        for k, v in enumerate((xs, ys)):
            np.minimum.at(low[:, k], of, v)
            np.maximum.at(high[:, k], of, v + 1)
        sure = 1 - np.bincount(of, grey[ys, xs], minlength=n) / np.maximum(count, 1) / self.level
        wide, tall = (high - low)[:, 0], (high - low)[:, 1]
        kind = np.where(wide >= 3 * tall, 0, np.where(tall >= 3 * wide, 3, 2))
        found = np.column_stack([low, high, 0.5 + 0.5 * sure, kind]).astype(np.float64)
        return found[(np.arange(n) > 0) & (count >= self.least_pixels)]


def regions(mask: np.ndarray) -> np.ndarray:
    """A number from 1 for each connected region of a mask (pixels that touch by a side), 0 elsewhere.

    Runs of set pixels in each line are joined with those that they overlap in the line above.
    """
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded, axis=1)
    ys, starts = np.nonzero(step == 1)
    ends = np.nonzero(step == -1)[1]
    root = np.arange(len(ys))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(ys, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] < ends[j] and starts[j] < ends[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    names = np.array([find(i) for i in range(len(root))], int)
    number = np.searchsorted(np.unique(names), names) + 1
    out = np.zeros((h, w), np.int64)
    for y, a, b, n in zip(ys, starts, ends, number, strict=True):
        out[y, a:b] = n
    return out


_loaded: dict[str, Detector] = {}


def _model(token: str, load: Callable[[], Detector]) -> Detector:
    """The detector of a job, loaded by the first of its tasks in a worker."""
    if token not in _loaded:
        _loaded.clear()
        _loaded[token] = load()
    return _loaded[token]


def scored(images: DataFrame, load: Callable[[], Detector], floor: float = 0.001, names: list[str] = CLASS_NAMES, batch: int = BATCH) -> DataFrame:
    """The table with width, height, pred (in falling confidence, none under the floor), model_version and inference_ms instead of its column content.

    A picture that can't be decoded has no size and no pred. inference_ms is its share of
    its batch's time. The other columns pass.
    """
    schema = images.drop("content").schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    added = f"width int, height int, pred {PRED}, model_version string, inference_ms double"
    token = uuid.uuid4().hex
    kind = pa.list_(pa.struct([("class", pa.string()), ("confidence", pa.float64()), ("bbox", pa.list_(pa.float64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(token, load)
        for b in batches:
            for part in _parts(b, batch):
                found = [decode_color(x) for x in part.column("content").to_pylist()]
                seen = [i for i, x in enumerate(found) if x is not None]
                rows: list = [(None, None, None, None, None)] * len(found)
                if seen:
                    boxed = [letterbox(found[i], model.side) for i in seen]
                    began = perf_counter()
                    boxes = model(np.stack([x[0] for x in boxed]))
                    took = round((perf_counter() - began) * 1000 / len(seen), 3)
                    for i, (_, *how), each in zip(seen, boxed, boxes, strict=True):
                        h, w = found[i].shape[:2]
                        each = restored(np.asarray(each, np.float64).reshape(-1, 6), *how, w, h)
                        each = each[each[:, 4] >= floor]
                        each = each[np.argsort(-each[:, 4], kind="stable")]
                        name = lambda c: names[int(c)] if 0 <= c < len(names) else str(int(c))
                        rows[i] = (w, h, [{"class": name(r[5]), "confidence": float(r[4]), "bbox": r[:4].tolist()} for r in each], model.version, took)
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), kind, pa.string(), pa.float64()), strict=True)]
                kept = part.drop_columns(["content"])
                yield pa.RecordBatch.from_arrays([*kept.columns, *cols], names=[*kept.schema.names, "width", "height", "pred", "model_version", "inference_ms"])

    return images.mapInArrow(run, f"{out}, {added}" if out else added)


def _parts(b: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, at most so many and of BATCH_BYTES together."""
    start, held = 0, 0
    sizes = pc.binary_length(b.column("content")).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and (i - start >= most or held + n > BATCH_BYTES):
            yield b.slice(start, i - start)
            start, held = i, 0
        held += n
    if b.num_rows:
        yield b.slice(start)
