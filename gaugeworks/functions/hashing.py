"""Digests, perceptual hashes and their distance as Column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import md5 as md5_of
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grid of a difference hash: 8 rows of 9 cells, each cell compared with its right neighbour.
ROWS, COLUMNS = 8, 9
#: Bytes of text whose words are held at a time.
TEXT_HELD = 32 << 20


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def md5(content: Column) -> Column:
    return F.md5(content)


def hex16(h: Column) -> Column:
    """The 64-bit pattern as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def from_hex16(s: Column) -> Column:
    """Back to the signed 64-bit pattern; null for what is no hexadecimal number."""
    return F.when(s.rlike("^[0-9A-Fa-f]{1,16}$"), F.conv(s, 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _cells(words: list[bytes]) -> np.ndarray:
    """The cell of each word, by the first eight hexadecimal digits of its md5."""
    digests = b"".join([md5_of(w, usedforsecurity=False).digest() for w in words])
    return np.frombuffer(digests, ">u4").reshape(-1, 4)[:, 0].astype(np.int64) % (ROWS * COLUMNS)


def _grids(texts: pa.Array) -> np.ndarray:
    """How many words of each text fall into each cell; each different word of the texts is hashed once."""
    words = pc.ascii_split_whitespace(texts.view(pa.string()))
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    known = words.flatten().dictionary_encode()
    # where a text begins or ends with white space, there is an empty word; it has a column of its own
    distinct = known.dictionary.cast(pa.binary()).to_pylist()
    cell = np.where([bool(w) for w in distinct], _cells(distinct), ROWS * COLUMNS).astype(np.int64)
    at = np.repeat(np.arange(len(texts)) * (ROWS * COLUMNS + 1), sizes) + cell[known.indices.to_numpy()]
    counts = np.bincount(at, minlength=len(texts) * (ROWS * COLUMNS + 1)).reshape(-1, ROWS * COLUMNS + 1)
    return counts[:, :-1].reshape(-1, ROWS, COLUMNS)


def _lots(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, size) of lots of texts, of TEXT_HELD bytes or a single text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + TEXT_HELD, "right")))
        yield start, stop - start
        start = stop


def text_hashes(texts: DataFrame, key: str, text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns also and dhash of each text: its words are counted in 72 cells that serve as the grid.

    A text is counted where it is read, and nothing is shuffled; white space is that of Java's \\s.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
        for batch in batches:
            for start, size in _lots(batch.column(0)):
                lot = batch.slice(start, size)
                grid = _grids(lot.column(0))
                bits = (grid[:, :, 1:] > grid[:, :, :-1]).reshape(-1, 64)
                dhash = np.where(bits, weights, np.uint64(0)).sum(1, dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*lot.columns[1:], pa.array(dhash)], names=[key, *also, "dhash"])

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in (key, *also))
    return texts.select(F.col(text).cast("binary").alias("_t"), key, *also).mapInArrow(run, f"{kinds}, dhash long")


def _edges(distance: int, clean: int, bits: int) -> list[int]:
    n = distance + clean
    return [bits * i // n for i in range(n + 1)]


def segments(h: Column, distance: int, clean: int = 3, bits: int = 64) -> list[Column]:
    """distance + clean segments of the lowest bits: two hashes within the distance agree on `clean` of them at least."""
    edges = _edges(distance, clean, bits)
    return [F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("bigint")) for low, high in zip(edges, edges[1:], strict=False)]


def segment_keys(h: Column, distance: int, clean: int = 3, bits: int = 64) -> Column:
    """Every choice of `clean` segments as struct(mask, key): the segments chosen and their bits in one number."""
    parts, n = segments(h, distance, clean, bits), distance + clean
    width = -(-bits // n)
    chosen = combinations(range(n), clean)
    return F.array(
        *(
            F.struct(F.lit(sum(1 << i for i in c)).alias("mask"), reduce(lambda a, b: F.call_function("shiftleft", a, F.lit(width)).bitwiseOR(b), (parts[i] for i in c)).alias("key"))
            for c in chosen
        )
    )


def rest_of(h: Column, mask: Column, distance: int, clean: int = 3) -> Column:
    """The bits of the segments that a mask leaves out, in one number of rest_bits() bits at most."""
    edges = _edges(distance, clean, 64)
    parts = F.array(*(F.struct(F.lit(1 << i).alias("bit"), F.lit(high - low).alias("width"), s.alias("part")) for i, (s, low, high) in enumerate(zip(segments(h, distance, clean), edges, edges[1:], strict=False))))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda r, p: F.when(mask.bitwiseAND(p["bit"]) != 0, r).otherwise(F.call_function("shiftleft", r, p["width"]).bitwiseOR(p["part"])))


def rest_bits(distance: int, clean: int = 3) -> int:
    """The most bits that rest_of() leaves."""
    edges = _edges(distance, clean, 64)
    widths = sorted(high - low for low, high in zip(edges, edges[1:], strict=False))
    return sum(widths[clean:])


def first_masks(x: np.ndarray, distance: int, clean: int = 3, bits: int = 64) -> np.ndarray:
    """The mask of the first key that two hashes with these differing bits share."""
    edges = _edges(distance, clean, bits)
    out, found = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        same = ((x >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1) == 0) & (found < clean)
        out |= same.astype(np.int64) << i
        found += same
    return out


def rests(x: np.ndarray, mask: np.ndarray, distance: int, clean: int = 3) -> np.ndarray:
    """rest_of() of differing bits."""
    edges, out = _edges(distance, clean, 64), np.zeros(len(x), np.uint64)
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        part = (x >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        out = np.where(mask >> i & 1, out, out << np.uint64(high - low) | part)
    return out


def tops(mask: np.ndarray, distance: int, clean: int = 3, bits: int = 64) -> np.ndarray:
    """The highest bit of each segment that a mask chooses."""
    out = np.zeros(len(mask), np.uint64)
    for i, high in enumerate(_edges(distance, clean, bits)[1:]):
        out |= (mask.astype(np.uint64) >> np.uint64(i) & np.uint64(1)) << np.uint64(high - 1)
    return out


def differing(x: np.ndarray, distance: int, clean: int = 3, bits: int = 64) -> np.ndarray:
    """The highest bit of each segment where it has any differing bit: the sum carries into it from the bits below, and no farther."""
    low = np.uint64(sum(((1 << (high - at - 1)) - 1) << at for at, high in zip(_edges(distance, clean, bits), _edges(distance, clean, bits)[1:], strict=False)))
    return ((x & low) + low | x) & ~low
