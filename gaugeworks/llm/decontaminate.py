"""Benchmark decontamination by latent semantic retrieval.

1. Terms are the words of the benchmark items: no other word adds to a cosine with an
   item. Texts are cut into words once: the term numbers of all documents are written, and
   everything below reads these (clean() its texts once more). Document frequencies are
   counted over all documents.
2. A randomised SVD of TF-IDF passages gives the latent space, one for all items: two passes
   over all documents and all items. The sums of the tasks are added up by the executors, in
   PIECES of the terms; the driver sees terms x (RANK + OVERSAMPLE) numbers in all.
3. Every window of WINDOW words of every document is projected into that space, its axes
   scaled to equal variance, and compared by cosine, in blocks, with every item and, of an
   item that is longer, with its own passages of WINDOW words. Items of less than half a
   window are compared with windows of half the size too. Words of an item in a row are also
   found by equality, so a verbatim copy does not depend on the item's length.
4. Each candidate is verified on the words themselves: the longest common subsequence
   of the item and the region around the window, and for a paraphrase the presence of
   the item's answer (the rarer words of its last sentence).

Words are runs of letters, digits and bytes over 127, with A-Z lower-cased.

Defined results: a null or empty text, and an item without words, match nothing; an item
of fewer than SHORT words must occur word for word; equal items and repeated rows each
give their own rows; ids keep their types; the further columns of documents pass through
clean(); empty tables give empty results. Items whose texts exceed BLOCK_BYTES are handled
in blocks of so many bytes, each with a space and a pass over the documents of its own.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, pairwise, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from ..storage import Written
from .common import SLICE_BYTES, slices, table

RANK, OVERSAMPLE = 128, 16
WINDOW, STEP = 32, 16
#: There is no bound: the space is fitted to all documents whatever stands here (an older test sets it).
SAMPLE_DOCS = None
#: Pieces of a matrix by its rows that are added up apart.
PIECES = 16
#: Bytes of benchmark texts that are handled and broadcast together, and queries compared with at once.
BLOCK_BYTES, TILE = 16 << 20, 4096
#: Rows of a matrix that are gathered at once to be added up, and windows compared at once: few enough to stay in a core's cache.
GATHERED, CHUNK = 2048, 1024
#: Least cosine of a candidate with queries of LONG words or more and with shorter ones, and least share of the query's own length that a window must reach; measured recall is in the tests.
COSINE, COSINE_SHORT, LONG, REACH = 0.45, 0.28, 24, 0.25
#: Share of the item's words, in order, that shows a copy; with the answer present, a paraphrase.
COPY, PARAPHRASE, ANSWER = 0.65, 0.55, 0.6
#: A stretch without this share of the item's rarer words (half a word less, one at least) isn't looked at word by word.
RARE = 0.4
SHORT = 8

_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_BYTES).split()


def term_ids(texts: list[str | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Term number of every word of all texts (-1: no term), and where each text starts (one more offset at the end)."""
    get = vocabulary.get
    each = [list(map(get, words(t), repeat(-1))) for t in texts]
    starts = np.zeros(len(each) + 1, np.int64)
    np.cumsum([len(e) for e in each], out=starts[1:])
    return np.fromiter(chain.from_iterable(each), np.int32, int(starts[-1])), starts


def _kind(terms: int) -> str:
    return "<u2" if terms < 1 << 16 else "<u4"


def numbered(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The rows with ids in place of text: a number for each word, 0 for no term, else one more than the term's."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = _kind(len(sent.value))
        for s in slices(batches):
            ids, starts = term_ids(s.column("text").to_pylist(), sent.value)
            data, at = (ids + 1).astype(kind).tobytes(), (starts * np.dtype(kind).itemsize).tolist()
            yield pa.RecordBatch.from_arrays([*s.drop_columns("text").columns, pa.array([data[a:b] for a, b in pairwise(at)], pa.binary())], names=[*kept, "ids"])

    fields = [f for f in documents.schema.fields if f.name != "text"]
    kept = [f.name for f in fields]
    return documents.select(*kept, "text").mapInArrow(run, StructType([*fields, StructField("ids", BinaryType())]))


def _numbers(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of numbered rows, each with what term_ids() gives for its texts."""
    kind = np.dtype(_kind(terms))
    for s in slices(batches, "ids", SLICE_BYTES // 3):
        each = s.column("ids").to_pylist()
        starts = np.zeros(len(each) + 1, np.int64)
        np.cumsum([len(e) // kind.itemsize for e in each], out=starts[1:])
        yield s, np.frombuffer(b"".join(each), kind).astype(np.int32) - 1, starts


def document_frequencies(rows: DataFrame, terms: int) -> tuple[np.ndarray, int]:
    """In how many numbered documents each term occurs, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(terms, np.int64), 0
        for _, ids, starts in _numbers(batches, terms):
            whose = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            at = np.nonzero(ids >= 0)[0]
            total += np.bincount(np.unique(whose[at] * terms + ids[at]) % terms, minlength=terms)
            n += len(starts) - 1
        if n:
            found = np.nonzero(total)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1), pa.int32()), pa.array(np.append(total[found], n), pa.int64())], names=["term", "n"])

    sums = rows.select("ids").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df, n = np.zeros(terms, np.int64), 0
    for term, c in zip(sums["term"], sums["n"], strict=True):
        if term < 0:
            n = int(c)
        else:
            df[term] = c
    return df, n


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """Squared inverse document frequencies; terms of most documents weigh nothing."""
    idf = np.log((1 + n) / (1 + df))
    return np.where(idf < 0.5, 0.0, idf * idf).astype(np.float32)


def _summed(v: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at cuts; runs are short, so each step adds one row to every run left."""
    lengths = np.diff(cuts, append=len(v))
    out = v[cuts]
    for k in range(1, int(lengths.max(initial=1))):
        left = np.nonzero(lengths > k)[0]
        if len(left) < 8:  # a few long runs
            for i in left:
                out[i] += v[cuts[i] + k : cuts[i] + lengths[i]].sum(0)
            break
        out[left] += v[cuts[left] + k]
    return out


def _weighted(v: np.ndarray, rows: np.ndarray, value: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of the given rows of v, each times its value, over the runs that begin at cuts; runs of one length go together, a few at a time."""
    lengths = np.diff(cuts, append=len(rows))
    out = np.empty((len(cuts), v.shape[1]), np.float32)
    order = np.argsort(lengths, kind="stable")
    bounds = np.nonzero(np.diff(lengths[order], prepend=-1))[0]
    for low, high in pairwise([*bounds.tolist(), len(order)]):
        n = int(lengths[order[low]])
        few = max(1, GATHERED // n)
        for k in range(low, high, few):
            runs = order[k : min(k + few, high)]
            if len(runs) == 1:
                a = int(cuts[runs[0]])
                out[runs[0]] = value[a : a + n] @ v[rows[a : a + n]]
            else:
                at = cuts[runs][:, None] + np.arange(n)
                out[runs] = np.matmul(value[at][:, None], v[rows[at]])[:, 0]
    return out


class Sums(NamedTuple):
    """Projections of the blocks with weight, of STEP or STEP / 2 words each."""

    size: int  # words of a block
    sums: np.ndarray
    number: np.ndarray  # of each block, ascending
    owner: np.ndarray  # number of its text
    base: np.ndarray  # number of each text's first block
    starts: np.ndarray  # first word of each text


def block_sums(ids: np.ndarray, starts: np.ndarray, space: np.ndarray) -> tuple[Sums, Sums]:
    """The blocks of STEP / 2 words of all texts, and those of STEP words made of them."""
    half = STEP // 2
    per = -(-np.diff(starts) // STEP) * 2
    base = np.cumsum(per) - per
    heavy = np.zeros(len(space) + 1, bool)  # the last is for -1
    heavy[:-1] = space.any(axis=1)
    at = np.nonzero(heavy[ids])[0]
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[at]
    block = base[text] + (at - starts[text]) // half
    cuts = np.nonzero(np.diff(block, prepend=-1))[0]
    small = Sums(half, _weighted(space, ids[at], np.ones(len(at), np.float32), cuts), block[cuts], text[cuts], base, starts)
    pairs = np.nonzero(np.diff(small.number // 2, prepend=-1))[0]
    return small, Sums(STEP, _summed(small.sums, pairs), small.number[pairs] // 2, small.owner[pairs], base // 2, starts)


def windows(b: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Projections of the windows of two blocks with weight, with the number of the text and the first word of each."""
    # a window from each block that has weight, and from the one just before it
    whose, n = b.owner, len(b.number)
    follows = np.zeros(n + 1, bool)  # whether a block's next one, of the same text, has weight, too; by the latter
    follows[1:n] = (np.diff(b.number) == 1) & (whose[1:] == whose[:-1])
    total = b.sums.copy()
    total[:-1] += b.sums[1:]
    ends = np.nonzero(~follows[1:])[0]
    total[ends] = b.sums[ends]
    lone = np.nonzero(~follows[:n] & (b.number > b.base[whose]))[0]
    whose, first = np.concatenate([whose, whose[lone]]), np.concatenate([b.number, b.number[lone] - 1])
    return np.concatenate([total, b.sums[lone]]), whose, b.starts[whose] + (first - b.base[whose]) * b.size


def _passages(ids: np.ndarray, starts: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Passages of WINDOW words as rows of a sparse matrix: term, weight and row of each entry, rows of unit length."""
    at = np.nonzero(np.append(w, 0)[ids])[0]
    if not len(at):
        return None
    n = np.diff(starts)
    base = np.cumsum(-(-n // WINDOW)) - -(-n // WINDOW)
    text = np.repeat(np.arange(len(n)), n)[at]
    row = np.cumsum(np.diff(base[text] + (at - starts[text]) // WINDOW, prepend=-1) != 0) - 1
    value = w[ids[at]]
    return ids[at], (value / np.sqrt(np.bincount(row, value * value))[row]).astype(np.float32), row


def _added(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """The sum of the tasks' matrices, each in rows (piece, values) of some of its rows."""

    def run(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py()) for x in t.column("m"))
        return pa.table({"piece": t.column("piece").slice(0, 1), "m": pa.array([total.tobytes()], pa.binary())})

    out = [np.zeros((len(r), columns)) for r in np.array_split(np.arange(rows), PIECES)]
    for r in parts.groupBy("piece").applyInArrow(run, "piece int, m binary").collect():  # terms x width numbers in all
        out[r["piece"]] = np.frombuffer(bytes(r["m"])).reshape(-1, columns)
    return np.concatenate(out)


def _pieces(m: np.ndarray) -> pa.RecordBatch:
    parts = [(k, p.astype(np.float64).tobytes()) for k, p in enumerate(np.array_split(m, PIECES)) if p.any()]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["piece", "m"])


def latent_space(documents: DataFrame, items: list[str], vocabulary: dict[bytes, int], w: np.ndarray, seed: int = 7) -> np.ndarray:
    """Terms x RANK: weight times the right singular vectors of all TF-IDF passages over their singular values."""
    return fitted(numbered(documents.select("text"), vocabulary), items, vocabulary, w, seed)


def fitted(rows: DataFrame, items: list[str], vocabulary: dict[bytes, int], w: np.ndarray, seed: int = 7) -> np.ndarray:
    """As latent_space() of numbered documents."""
    spark = rows.sparkSession
    texts = rows.select("ids").union(numbered(spark.createDataFrame([(t,) for t in items], "text string").coalesce(1), vocabulary))
    width = min(RANK + OVERSAMPLE, len(w))
    omega = np.random.default_rng(seed).standard_normal((len(w), width)).astype(np.float32)
    sent = spark.sparkContext.broadcast((w, omega))

    def times(v: np.ndarray, term: np.ndarray, value: np.ndarray, row: np.ndarray) -> np.ndarray:
        return _weighted(v, term, value, np.nonzero(np.diff(row, prepend=-1))[0])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, omega = sent.value
        z = np.zeros(omega.shape, np.float32)
        for _, ids, starts in _numbers(batches, len(w)):
            got = _passages(ids, starts, w)
            if got:
                term, value, row = got
                y = times(omega, term, value, row)
                order = np.argsort(term, kind="stable")
                cuts = np.nonzero(np.diff(term[order], prepend=-1))[0]
                z[term[order][cuts]] += _weighted(y, row[order], value[order], cuts)
        yield _pieces(z)

    z = _added(texts.mapInArrow(first, "piece int, m binary"), *omega.shape)
    q = np.linalg.qr(z)[0].astype(np.float32)
    basis = spark.sparkContext.broadcast(q)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, _ = sent.value
        gram = np.zeros((basis.value.shape[1],) * 2)
        for _, ids, starts in _numbers(batches, len(w)):
            got = _passages(ids, starts, w)
            if got:
                t = times(basis.value, *got)
                gram += t.T @ t
        yield _pieces(gram)

    gram = _added(texts.mapInArrow(second, "piece int, m binary"), q.shape[1], q.shape[1])
    value, vector = np.linalg.eigh(gram)
    top = np.argsort(-value)[:RANK]
    scale = 1 / np.sqrt(np.maximum(value[top], value.max() * 1e-6))
    return ((q @ vector[:, top].astype(np.float32)) * scale.astype(np.float32) * w[:, None]).astype(np.float32)


class Item(NamedTuple):
    item_id: object
    words: tuple[int, ...]
    masks: dict[int, int]  # of each term, the places where the item has it
    rare: frozenset[int]
    answer: frozenset[int]


def _rarer(terms: set[int], w: np.ndarray) -> frozenset[int]:
    return frozenset(sorted(terms, key=lambda t: (-w[t], t))[: (len(terms) + 1) // 2])


def as_item(item_id: object, text: str | None, vocabulary: dict[bytes, int], w: np.ndarray) -> Item | None:
    own = [vocabulary[x] for x in words(text)]
    if not own:
        return None
    masks: dict[int, int] = defaultdict(int)
    for i, t in enumerate(own):
        masks[t] |= 1 << i
    ends = text.replace("?", ".").replace("!", ".").replace("\n", ".").split(".")
    last = [x for x in map(words, ends) if x][-1:] or [words(text)]
    return Item(item_id, tuple(own), dict(masks), _rarer(set(own), w), _rarer({vocabulary[x] for x in last[0] if x in vocabulary} or set(own), w))


def common_subsequence(item: Item, region: list[int]) -> int:
    """Length of the longest common subsequence, one bit for each word of the item."""
    n = len(item.words)
    full = (1 << n) - 1
    v = full
    for m in filter(None, map(item.masks.get, region)):
        u = v & m
        v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def verified(item: Item, region: list[int]) -> tuple[float, float] | None:
    """Share of the item in the region, and of its answer; None if the region doesn't hold it."""
    n = len(item.words)
    if n < SHORT:
        first = item.words[0]
        exact = any(w == first and tuple(region[i : i + n]) == item.words for i, w in enumerate(region))
        return (1.0, 1.0) if exact else None
    share = common_subsequence(item, region) / n
    if share < PARAPHRASE:
        return None
    answer = len(item.answer.intersection(region)) / len(item.answer)
    return (share, answer) if share >= COPY or answer >= ANSWER else None


def best_place(item: Item, region: list[int]) -> tuple[float, float] | None:
    """The best verified stretch of one and a half times the item's length within the region."""
    need, hits = max(1, int(RARE * len(item.rare) - 0.5)), item.rare.intersection
    if len(hits(region)) < need:
        return None
    n = len(item.words)
    span, step = n + n // 2, max(1, n // 4)
    best = None
    for j in range(0, max(1, len(region) - span + step), step):
        part = region[j : j + span]
        if len(hits(part)) >= need and (got := verified(item, part)):
            best = max(best or got, got)
    return best


def regions(at: list[int], n: int, low: int, high: int) -> list[tuple[int, int]]:
    """Where an item of n words may stand, given the windows that resemble it: it may begin before a window or end after it."""
    out: list[tuple[int, int]] = []
    for a in sorted(at):
        first, last = max(low, a - n), min(high, a + WINDOW + n)
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], last
        else:
            out.append((first, last))
    return out


class Queries(NamedTuple):
    """What windows of one size are compared with."""

    window: int
    item: np.ndarray  # number of the item of each
    vectors: np.ndarray  # unit
    lengths: np.ndarray
    least: np.ndarray  # cosine of a candidate


class Prepared(NamedTuple):
    vocabulary: dict[bytes, int]
    space: np.ndarray
    items: list[Item]
    queries: list[Queries]
    starts: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: sorted hashes of the items' first words, and whose they are


def queries(items: list[Item], space: np.ndarray) -> list[Queries]:
    """Whole items, and the passages of those longer than a window; short items also for windows of half the size."""
    out = []
    for window in (WINDOW, WINDOW // 2):
        rows, whose, least = [], [], []
        for k, x in enumerate(items):
            n = len(x.words)
            if n < SHORT or window < WINDOW and n >= window:
                continue
            parts = [x.words]
            if n > window:
                parts += [x.words[j : j + window] for j in [*range(0, n - window, STEP), n - window]]
            rows += [space[list(p)].sum(0) for p in parts]
            whose += [k] * len(parts)
            least += [COSINE if len(p) >= LONG else COSINE_SHORT for p in parts]
        if rows:
            vectors = np.array(rows, np.float32)
            lengths = np.maximum(np.linalg.norm(vectors, axis=1), 1e-9)
            out.append(Queries(window, np.array(whose), vectors / lengths[:, None], lengths, np.array(least, np.float32)))
    return out


def _row_hashes(ids: np.ndarray, m: int) -> np.ndarray:
    """A hash of the m terms from each place on."""
    h = np.zeros(max(0, len(ids) - m + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(m):
            h = (h ^ ids[j : j + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def first_words(items: list[Item]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, SHORT at most: sorted hashes of the first words of the items, and the number of the item of each."""
    by: dict[int, list[int]] = defaultdict(list)
    for k, x in enumerate(items):
        by[min(SHORT, len(x.words))].append(k)
    out = {}
    for m, whose in by.items():
        h = np.array([_row_hashes(np.array(items[k].words[:m], np.int32), m)[0] for k in whose], np.uint64)
        order = np.argsort(h, kind="stable")
        out[m] = h[order], np.array(whose)[order]
    return out


def verbatim(ids: np.ndarray, starts: np.ndarray, p: Prepared) -> set[tuple[int, int]]:
    """(number of the text, number of the item) wherever a text has all words of an item in a row."""
    out = set()
    for m, (hashes, whose) in p.starts.items():
        h = _row_hashes(ids, m)
        low = np.searchsorted(hashes, h)
        for at in np.nonzero(hashes[np.minimum(low, len(hashes) - 1)] == h)[0].tolist():
            t = int(np.searchsorted(starts, at, side="right")) - 1
            k = int(low[at])
            while k < len(hashes) and hashes[k] == h[at]:
                item = p.items[whose[k]]
                end = at + len(item.words)
                if end <= starts[t + 1] and tuple(ids[at:end].tolist()) == item.words:
                    out.add((t, int(whose[k])))
                k += 1
    return out


def matches(texts: list[str | None], p: Prepared) -> list[tuple[int, object, float, float, float]]:
    """(number of the text, item_id, cosine, share, answer) of every verified pair; a copy that only equality finds has the cosine 1 of its own words."""
    return matches_of(*term_ids(texts, p.vocabulary), p)


def matches_of(ids: np.ndarray, starts: np.ndarray, p: Prepared) -> list[tuple[int, object, float, float, float]]:
    """As matches() of texts in term numbers."""
    found: dict[tuple[int, int], list[tuple[float, int]]] = defaultdict(list)
    by_size = {2 * b.size: b for b in block_sums(ids, starts, p.space)} if p.queries else {}
    for q in p.queries:
        v, owner, first = windows(by_size[q.window])
        norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-9)
        for k in range(0, len(v), CHUNK):
            part = v[k : k + CHUNK] / norm[k : k + CHUNK, None]
            for j in range(0, len(q.item), TILE):
                cosine = part @ q.vectors[j : j + TILE].T
                at = np.flatnonzero(cosine >= q.least[j : j + TILE])
                c, (w, i) = cosine.ravel()[at], np.divmod(at, cosine.shape[1])
                w, i = w + k, i + j
                far = c * norm[w] >= REACH * q.lengths[i]
                for a, b, x in zip(w[far].tolist(), q.item[i[far]].tolist(), c[far].tolist(), strict=True):
                    found[int(owner[a]), b].append((x, int(first[a])))
    exact = verbatim(ids, starts, p)
    out = []
    for t, i in sorted(found.keys() | exact):
        item, low, high = p.items[i], int(starts[t]), int(starts[t + 1])
        hits = found.get((t, i), [])
        places = [got for a, b in regions([at for _, at in hits], len(item.words), low, high) if (got := best_place(item, ids[a:b].tolist()))]
        if places:
            out.append((t, item.item_id, max(c for c, _ in hits), *max(places)))
        elif (t, i) in exact:
            out.append((t, item.item_id, 1.0, 1.0, 1.0))
    return out


def prepared(documents: DataFrame, block: list[tuple[object, str]]) -> tuple[Prepared, Written | None]:
    """Terms, latent space and vectors of a block of items, and the documents in term numbers, unless there are no terms."""
    texts = [t for _, t in block if words(t)]
    vocabulary = {x: i for i, x in enumerate(sorted({x for t in texts for x in words(t)}))}
    if not vocabulary:
        return Prepared({}, np.zeros((0, 1), np.float32), [], [], {}), None
    rows = Written(numbered(documents.select("doc_id", "text"), vocabulary), "numbered")
    df, n = document_frequencies(rows.df, len(vocabulary))
    w = weights(df, n)
    if not w.any():  # too few documents to tell common terms from rare ones
        w = np.ones(len(vocabulary), np.float32)
    space = fitted(rows.df, texts, vocabulary, w)
    items = [x for i, t in block if (x := as_item(i, t, vocabulary, w)) is not None]
    return Prepared(vocabulary, space, items, queries(items, space), first_words(items)), rows


def blocks_of_items(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The query set, streamed to the driver in blocks of BLOCK_BYTES of text."""
    held: list[tuple[object, str]] = []
    size = 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len((r["text"] or "").encode("utf-8", "replace"))
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer) for every document that holds a benchmark item."""
    spark = documents.sparkSession
    score = [StructField(n, DoubleType()) for n in ("cosine", "lcs", "answer")]
    schema = StructType([StructField("doc_id", documents.schema["doc_id"].dataType), StructField("item_id", benchmark.schema["item_id"].dataType), *score])
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = spark.createDataFrame([], schema)
    for block in blocks_of_items(benchmark):
        ready, numbers = prepared(documents, block)
        if numbers is None:
            continue
        sent = spark.sparkContext.broadcast(ready)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for s, ids, starts in _numbers(batches, len(sent.value.vocabulary)):
                rows = matches_of(ids, starts, sent.value)
                cols = [s.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], kind), *(pa.array([float(r[k]) for r in rows], pa.float64()) for k in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

        out = out.union(numbers.df.mapInArrow(run, schema))
    return out


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns kept."""
    spark, whole = documents.sparkSession, documents
    for block in blocks_of_items(benchmark):
        ready, numbers = prepared(whole, block)
        if numbers is not None:
            numbers.drop()
        sent = spark.sparkContext.broadcast(ready)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for s in slices(batches):
                hit = {r[0] for r in matches(s.column("text").to_pylist(), sent.value)} if sent.value.items else set()
                yield s.filter(pa.array([i not in hit for i in range(s.num_rows)], pa.bool_())) if hit else s

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
