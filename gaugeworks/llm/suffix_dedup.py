"""Exact substring deduplication over a Burrows-Wheeler transform.

A byte is removed if a string of LENGTH bytes that covers it starts anywhere else, too.

1. Routing. The start of every LENGTH-byte window is assigned to its anchor, the
   position with the least hash in the first half of the window, so equal windows have
   equal anchors. The starts of one anchor form a stretch of text; a stretch is known by the
   hash of the GRAM bytes at its anchor and by a hash of all its bytes. Only numbers are
   shuffled here. Stretches whose anchor is unique cannot hold a repeat; equal stretches
   are counted and one of them stands for all, so copies are never gathered.
2. Stretches that share their anchor's gram and differ elsewhere go to the same bucket of
   text. There a suffix array gives the Burrows-Wheeler transform, and a breadth-first
   backward extension of its intervals derives the common prefixes of neighbouring
   suffixes by increasing value: all intervals of one length are extended together, an
   interval lives on only if it sets a new value, and the search stops at LENGTH. Values
   still open then are LENGTH or more: those windows repeat.
   A gram that very many different stretches share is cut into ranges of window offsets,
   which are dealt out by the bytes that all windows of a range have in common.
3. The repeated windows are carried back to every stretch and united per document.

Defined results: null is the empty text; a text shorter than LENGTH keeps all its bytes;
matches never cross documents; rows with equal id and text are rows of their own and
repeat each other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Written
from .common import slices, table

LENGTH = 400
#: Bytes at an anchor; an anchor is chosen among the first LENGTH - GRAM + 1 positions of a window.
GRAM = 200
#: Bytes of one bucket of stretches, about (its arrays stay in a core's cache), and of one task.
BUCKET_BYTES, TASK_BYTES = 400_000, 8_000_000
#: A gram with more different stretches than this is cut into ranges of RANGE offsets.
HOT, RANGE = 2_000, 25
#: Up to so many pieces of a route are compared in pairs before they are sorted.
FEW = 6

_MIX = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- 1. routing


def stretches(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text, with the first and last start of the windows assigned to each."""
    n = len(data)
    if n < LENGTH:
        return (np.empty(0, np.int64),) * 3
    grams = np.empty(n - 7, np.uint64)
    for k in range(8):
        part = np.frombuffer(data, "<u8", count=(n - k) // 8, offset=k)
        grams[k::8] = part[: len(grams[k::8])]
    span = LENGTH - GRAM + 1
    # the hash above, the position below: the least is the leftmost of the least hashes
    least = ((grams * _MIX) >> np.uint64(32)) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64)
    reach = 1
    while reach < span:
        step = min(reach, span - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    anchor = (least[: n - LENGTH + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.nonzero(np.diff(anchor, prepend=-1))[0]
    return anchor[first], first, np.append(first[1:] - 1, len(anchor) - 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _routes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for s in slices(batches):
        keys, grams, wholes, places = [], [], [], []
        for key, text in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "replace")
            for p, a, b in zip(*(x.tolist() for x in stretches(data)), strict=True):
                keys.append(key)
                grams.append(_signed(digest(data[p : p + GRAM])))
                wholes.append(_signed(digest(data[a : b + LENGTH], p - a + 1)))
                places.append(a << 16 | (p - a) << 8 | (b - a))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, grams, wholes, places)], names=["key", "gram", "whole", "place"])


# ---------------------------------------------------------------- 2. the transform


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t (symbols under 512, the last one the least) in the order of their first depth symbols."""
    n = len(t)
    key = np.zeros(n, np.int64)
    padded = np.append(t.astype(np.int64), np.zeros(8, np.int64))
    for k in range(7):
        key = key << 9 | padded[k : k + n]
    order = np.argsort(key).astype(np.int32)
    head = np.empty(n, bool)
    head[0] = True
    key = key[order]
    head[1:] = key[1:] != key[:-1]
    at = np.arange(n, dtype=np.int32)
    rank = np.zeros(n + 1, np.int32)  # from 1; beyond the end: 0
    rank[order] = np.maximum.accumulate(np.where(head, at, 0)) + 1
    h = 7
    while h < depth:
        tail = np.append(head[1:], True)
        open_ = at[~(head & tail)]  # only what shares its rank is sorted again
        if not len(open_):
            break
        pos = order[open_]
        key = rank[pos].astype(np.int64) << 32 | rank[np.minimum(pos + h, n)]
        inner = np.argsort(key)
        order[open_] = pos = pos[inner]
        key = key[inner]
        fresh = np.empty(len(open_), bool)
        fresh[0] = True
        fresh[1:] = key[1:] != key[:-1]
        head[open_] = fresh
        rank[pos] = np.maximum.accumulate(np.where(fresh, open_, 0)) + 1
        h *= 2
    return order


def long_prefixes(t: np.ndarray, order: np.ndarray, threshold: int) -> np.ndarray:
    """Whether suffix order[i] shares threshold symbols or more with order[i-1], for each i (the first: no).

    Backward extension over the runs of the Burrows-Wheeler transform; symbol 0 separates
    texts, and strings that begin with it are not followed.
    """
    n = len(t)
    bwt = t[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    lf = np.empty(n, np.int32)
    lf[by_symbol] = np.arange(n, dtype=np.int32)
    changed = np.append(True, bwt[1:] != bwt[:-1])
    change = np.nonzero(changed)[0]
    run_of = np.cumsum(changed, dtype=np.int32) - 1
    run_end = np.append(change[1:], n)
    symbol = bwt[change].astype(np.int64)
    open_ = np.ones(n + 1, bool)  # the value at the right end of an interval isn't known yet
    open_[0] = open_[n] = False
    lb, rb = np.array([0]), np.array([n])
    for length in range(threshold):
        if not len(lb):
            break
        r0 = run_of[lb]
        count = run_of[rb - 1] - r0 + 1
        owner = np.repeat(np.arange(len(lb)), count)
        run = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + r0[owner]
        c = symbol[run]
        first = np.maximum(change[run], lb[owner])
        last = np.minimum(run_end[run], rb[owner])
        if length:
            keep = c > 0
            owner, c, first, last = owner[keep], c[keep], first[keep], last[keep]
        code = owner * 512 + c
        if len(code) > 1:
            sort = np.argsort(code, kind="stable")
            code, first, last = code[sort], first[sort], last[sort]
            begin = np.nonzero(np.diff(code, prepend=-1))[0]
            end = np.append(begin[1:], len(code)) - 1
            first, last = first[begin], last[end]
        lb, rb = lf[first], lf[last - 1] + 1
        fresh = open_[rb]
        lb, rb = lb[fresh], rb[fresh]
        open_[rb] = False
    return open_[:n]


def repeated_starts(texts: list[bytes], threshold: int = LENGTH) -> list[np.ndarray]:
    """For each text which of its windows of threshold bytes start elsewhere in any of the texts, too."""
    lengths = [len(x) for x in texts]
    n = sum(lengths) + len(texts)
    t = np.zeros(n, np.int16)
    at, starts = 0, []
    for x in texts:
        t[at : at + len(x)] = np.frombuffer(x, np.uint8)
        t[at : at + len(x)] += 1
        starts.append(at)
        at += len(x) + 1
    order = suffix_array(t, threshold)
    same = long_prefixes(t, order, threshold)
    hit = np.zeros(n, bool)
    at = np.nonzero(same)[0]
    hit[order[at]] = hit[order[at - 1]] = True
    return [hit[s : s + max(0, m - threshold + 1)] for s, m in zip(starts, lengths, strict=True)]


def _ranges(mask: np.ndarray) -> list[int]:
    """Runs of True as first, end, first, end ..."""
    return np.nonzero(np.diff(mask.view(np.int8), prepend=0, append=0))[0].tolist()


# ---------------------------------------------------------------- the plan


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, stretches to read) to rows of text for the buckets."""
    names = ["route", "gram", "whole", "shift", "piece", "anchor"]
    for s in slices(batches):
        out: list[list] = [[] for _ in names]
        for text, reads in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "replace")
            for r in reads:
                a, offset, more = r["place"] >> 16, r["place"] >> 8 & 255, r["place"] & 255
                if r["hot"]:
                    p = a + offset
                    # windows with offsets low..high all hold the bytes from p - low to p - high + LENGTH
                    for low in range((offset - more) // RANGE * RANGE, offset + 1, RANGE):
                        high = low + RANGE - 1
                        first, last = max(a, p - high), min(a + more, p - low)
                        shared = xxhash.xxh3_64_intdigest(data[p - low : p - high + LENGTH], low)
                        for x, v in zip(out, (_signed(shared ^ (r["gram"] & (1 << 64) - 1)), r["gram"], r["whole"], first - a, data[first : last + LENGTH], p - first), strict=True):
                            x.append(v)
                else:
                    for x, v in zip(out, (r["gram"], r["gram"], r["whole"], 0, data[a : a + more + LENGTH], offset), strict=True):
                        x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "piece" else pa.int64()) for n, x in zip(names, out, strict=True)], names=names)


def _common(a: tuple, b: tuple) -> int:
    """Bytes that two pieces share around their anchors without a break."""
    x, y = a[5], b[5]
    left = min(x, y)
    right = min(len(a[4]) - x, len(b[4]) - y)
    differ = int.from_bytes(a[4][x - left : x], "little") ^ int.from_bytes(b[4][y - left : y], "little")
    after = int.from_bytes(a[4][x : x + right], "big") ^ int.from_bytes(b[4][y : y + right], "big")
    return left - (differ.bit_length() + 7) // 8 + right - (after.bit_length() + 7) // 8


def _possible(group: list[tuple]) -> list[tuple]:
    """The pieces of a route that can hold a repeat; a lone one can't, and few are compared around their anchors first."""
    if len(group) > FEW:
        return group
    keep: set[int] = set()
    for i in range(len(group)):
        for j in range(i):
            if not (i in keep and j in keep) and _common(group[i], group[j]) >= LENGTH:
                keep |= {i, j}
    return [group[i] for i in sorted(keep)]


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats within the buckets of a partition; rows come sorted by route."""
    held: list[tuple] = []
    size = 0

    def solved() -> pa.RecordBatch:
        rows = [(r, [x + r[3] for x in _ranges(m)]) for r, m in zip(held, repeated_starts([r[4] for r in held]), strict=True)]
        rows = [x for x in rows if x[1]]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[1] for r, _ in rows], pa.int64()), pa.array([r[2] for r, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.list_(pa.int32()))], names=["gram", "whole", "ranges"]
        )

    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for _, group in groupby(rows, key=lambda row: row[0]):
        # a bucket may be split between routes, never within one
        more = _possible(list(group))
        held += more
        size += sum(len(r[4]) + 1 for r in more)
        if size > BUCKET_BYTES:
            yield solved()
            held, size = [], 0
    if held:
        yield solved()


def _joined(documents: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Documents with what belongs to them; the other side, which is numbers only, is the hashed one, so no text is sorted."""
    return documents.join(other.hint("shuffle_hash"), "key", how)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s in slices(batches):
        ids, out = s.column(0), []
        for text, found in zip(s.column(1).to_pylist(), s.column(2).to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "replace")
            n = len(data)
            if not found:
                out.append((n, 0, 0, hashlib.sha256(data).hexdigest(), text or ""))
                continue
            edges = np.zeros(n + 1, np.int64)
            pairs = np.array([(a + x, a + y - 1 + LENGTH) for f in found for a in [f["start"]] for x, y in zip(f["ranges"][::2], f["ranges"][1::2], strict=True)])
            np.add.at(edges, pairs[:, 0], 1)
            np.add.at(edges, pairs[:, 1], -1)
            gone = np.cumsum(edges[:-1]) > 0
            runs = _ranges(~gone)
            kept = [data[a:b] for a, b in zip(runs[::2], runs[1::2], strict=True)]
            whole = b"".join(kept)
            out.append((n, n - len(whole), len(_ranges(gone)) // 2, hashlib.sha256(whole).hexdigest(), "".join(x.decode("utf-8", "ignore") for x in kept)))
        cols = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])


def deduplicated(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the remaining text for each row.

    A code point of which a byte was removed isn't in the text; the digest is that of all remaining bytes.
    """
    spark = documents.sparkSession
    keyed = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    routes = Written(keyed.where(F.octet_length("text") >= LENGTH).select("key", "text").mapInArrow(_routes, "key long, gram long, whole long, place long"), "routes")
    # copies of a row have the same key, so a stretch is known by gram and whole, and counted by rows
    # written, so that the join has two plain sides and a gram with very many stretches can be split
    shared = Written(routes.df.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "shared-grams")
    stretch = Written(routes.df.join(shared.df, "gram"), "stretches")
    routes.drop()
    shared.drop()
    kinds = stretch.df.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("at"))
    per_gram = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).hint("rebalance")  # so that the join can split a gram of very many kinds
    classes = Written(kinds.join(per_gram, "gram").select("gram", "whole", "n", "kinds", "at.key", "at.place"), "classes")
    more = F.col("place").bitwiseAND(F.lit(255)).cast("int")
    # equal stretches repeat in whole
    copies = classes.df.where("n > 1").select("gram", "whole", F.array(F.lit(0), more + 1).alias("ranges"))
    unclear = classes.df.where("kinds > 1")
    total = unclear.agg(F.sum(more + LENGTH)).first()[0]
    found = copies
    if total:
        reads = unclear.groupBy("key").agg(F.collect_list(F.struct("gram", "whole", "place", (F.col("kinds") > HOT).alias("hot"))).alias("reads"))
        pieces = _joined(keyed, reads, "inner")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total // TASK_BYTES) + 1)
        rows = pieces.select("text", "reads").mapInArrow(_pieces, "route long, gram long, whole long, shift long, piece binary, anchor long")
        dealt = rows.repartition(parts, "route").sortWithinPartitions("route")
        found = found.union(dealt.mapInArrow(_expanded, "gram long, whole long, ranges array<int>"))
    found = Written(found, "repeats")
    start = F.shiftright("place", 16)
    per_doc = Written(
        stretch.df.join(found.df, ["gram", "whole"]).groupBy("key").agg(F.collect_set(F.struct(start.alias("start"), "ranges")).alias("found")),
        "removals",
    )
    return _joined(keyed, per_doc.df, "left").select("doc_id", "text", "found").mapInArrow(
        _cut, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


#: Every window is hashed here, which is affordable on small tables only.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, (2 * i + 1)::BIGINT, 800)) AS k FROM d, LATERAL (SELECT unnest(range(greatest(n - 399, 0))) AS i)),
rep AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
st AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 400 AS fresh FROM w SEMI JOIN rep USING (k)),
sp AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM st) GROUP BY doc_id, g),
cut AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS removed, count(*) AS spans FROM sp GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(array_to_string(list_transform(range(spans + 1), lambda j: substr(h, (2 * coalesce(b[j], 0) + 1)::BIGINT, (2 * (coalesce(a[j + 1], n) - coalesce(b[j], 0)))::BIGINT)), ''), h))) AS kept_sha256,
  decode(unhex(coalesce(array_to_string(list_transform(range(spans + 1), lambda j: regexp_replace(regexp_replace(
    substr(h, (2 * coalesce(b[j], 0) + 1)::BIGINT, (2 * (coalesce(a[j + 1], n) - coalesce(b[j], 0)))::BIGINT),
    '^([89AB][0-9A-F])+', ''), '([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-9A-F]([89AB][0-9A-F]){0,2})$', '')), ''), h))) AS text
FROM d LEFT JOIN cut USING (doc_id)
"""
