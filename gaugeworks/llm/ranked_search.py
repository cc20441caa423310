"""Ranked lexical search with dual-sorted wavelet trees.

Documents are dealt to shards. A shard's postings are one sequence of its documents'
numbers: the lists of its terms follow each other, and each list is ordered by falling
impact. A wavelet tree over that sequence keeps both orders: a list's range, mapped to a
node, is still ordered by impact, and a node holds one range of document numbers, so a
descent walks the lists by document. The first posting of a mapped range has the largest
impact of that term under the node; their weighted sum bounds the score of every document
below.

A search descends best-first: of the open nodes those with the largest bounds are split,
the ranges of all terms at once, down to single documents, whose bound is their score. It
ends when no open node reaches the k-th best score so far, so the result is exact. Scores
are whole numbers. Shards of a task hand on their k-th best scores, tasks send k rows a
query at most, and queries come in blocks of QUERY_BYTES.

The tree is laid out by levels, zeros before ones, as bits; a shard's impacts are kept in
the order of its lists and follow the bits down when it is opened.

Defined results: a null or empty text holds no term and is never found, and counts
neither as a document nor for the mean length; a document without an id is ranked behind
all others of its score; rows that share an id are documents of their own; a query that
is null, empty or has no known term has no results; repeated queries are answered each;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..session import spread
from ..storage import Written
from .common import slices, table

TOP = 10
#: A shard has at most so many documents and, but for its last document, postings.
SHARD_DOCS, SHARD_POSTINGS = 4096, 1_000_000
#: Nodes that are split at once.
BATCH = 256
#: Text of the queries that one task is given at a time.
QUERY_BYTES = 8 << 20

# Fixed values of the query's contract: letters, digits and all beyond ASCII make terms, A-Z are lower-cased; the constants of an impact.
_CELLS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
SCALE, LENGTH_PERCENT, SATURATION = 1_000_000_000, 75, 8

_POSTINGS = "lengths binary, terms binary, starts binary, docs binary, counts binary"


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_CELLS).split()


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """What a term adds to a score before its weight: tf occurrences in a document of n terms, among docs documents of length terms together."""
    m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n.astype(np.int64) * docs) // max(length, 1)
    return (SCALE * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + SATURATION * m)


def term_weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def _packed(ids: pa.Array, found: list[Counter]) -> pa.RecordBatch:
    """One shard: its documents by rising id, and the postings of each term."""
    order = pc.sort_indices(ids, null_placement="at_end").to_pylist()
    known: dict[bytes, int] = {}
    number = known.setdefault
    of = [np.fromiter((number(t, len(known)) for t in found[i]), np.int64, len(found[i])) for i in order]
    held = [np.fromiter(found[i].values(), np.int32, len(found[i])) for i in order]
    sizes = [len(x) for x in of]
    term, tf = np.concatenate(of), np.concatenate(held)
    doc = np.repeat(np.arange(len(order), dtype=np.uint32), sizes)
    by = np.argsort(term, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(known)))]).astype(np.int64)
    lengths = np.array([int(x.sum()) for x in held], np.int64)
    blobs = [lengths.tobytes(), b" ".join(known), starts.tobytes(), doc[by].tobytes(), tf[by].tobytes()]
    offsets = pa.array([0, len(order)], pa.int32())
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, ids.take(pa.array(order))), *(pa.array([b], pa.binary()) for b in blobs)], names=["ids", *_names(_POSTINGS)])


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def postings(documents: DataFrame) -> DataFrame:
    """Shards with all terms of their documents; documents without any are left out."""
    kind = documents.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, held = [], [], 0
        for s in slices(batches):
            for key, text in zip(s.column("doc_id"), s.column("text").to_pylist(), strict=True):
                if not (c := Counter(terms(text))):
                    continue
                ids.append(key.as_py())
                found.append(c)
                held += len(c)
                if len(found) >= SHARD_DOCS or held >= SHARD_POSTINGS:
                    yield _packed(pa.array(ids, to_arrow_type(kind)), found)
                    ids, found, held = [], [], 0
        if found:
            yield _packed(pa.array(ids, to_arrow_type(kind)), found)

    return documents.select("doc_id", "text").mapInArrow(run, f"ids array<{kind.simpleString()}>, {_POSTINGS}")


def totals(shards: DataFrame) -> tuple[int, int]:
    """How many documents hold a term, and the number of their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [np.frombuffer(x, np.int64) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"n": [len(x) for x in n], "l": [int(x.sum()) for x in n]})

    row = shards.select("lengths").mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return row[0] or 0, row[1] or 0


def _levels(docs: int) -> int:
    return max(1, (docs - 1).bit_length())


def with_trees(shards: DataFrame, docs: int, length: int) -> DataFrame:
    """The index: each shard's lists ordered by impact, and the bits of its wavelet tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n, starts, doc, tf = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in (("lengths", np.int64), ("starts", np.int64), ("docs", np.uint32), ("counts", np.int32)))
                impact = impacts(tf, n[doc], docs, length)
                term = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                order = np.lexsort((doc, -impact, term))
                at, bits = doc[order], []
                for level in reversed(range(_levels(len(n)))):
                    one = (at >> level) & 1 == 1
                    bits.append(np.packbits(one))
                    at = np.concatenate([at[~one], at[one]])
                made = [b"".join(x.tobytes() for x in bits), impact[order].astype(np.int32).tobytes()]
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1), b.column("terms").slice(i, 1), b.column("starts").slice(i, 1), *(pa.array([x], pa.binary()) for x in made)], names=["ids", "terms", "starts", "bits", "impacts"])

    return shards.mapInArrow(run, f"ids {shards.schema['ids'].dataType.simpleString()}, terms binary, starts binary, bits binary, impacts binary")


class Tree:
    """An opened shard."""

    def __init__(self, docs: int, vocabulary: bytes, starts: bytes, bits: bytes, impact: bytes) -> None:
        self.docs, self.levels = docs, _levels(docs)
        self.starts, top = np.frombuffer(starts, np.int64), np.frombuffer(impact, np.int32)
        self.number = {t: i for i, t in enumerate(vocabulary.split())}
        size, raw = len(top), np.frombuffer(bits, np.uint8)
        each = len(raw) // self.levels
        self.zeros, self.first, self.impact = [], [], [top]
        for k in range(self.levels):
            one = np.unpackbits(raw[k * each : (k + 1) * each], count=size).view(bool)
            before = np.zeros(size + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)  # zeros before each place
            self.first.append(int(before[-1]))  # where the ones begin
            was = self.impact[-1]
            self.impact.append(np.concatenate([was[~one], was[one]]))

    def _bounds(self, level: int, low: np.ndarray, high: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The weighted impacts of the first posting of each range, summed up by node."""
        at = self.impact[level]
        return np.where(low < high, at[np.minimum(low, len(at) - 1)], 0).astype(np.int64) @ weight

    def search(self, query: list[tuple[bytes, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the best k documents and those that tie with the last of them, of scores over 0 that reach least."""
        known = [(self.number[t], w) for t, w in query if w > 0 and t in self.number]
        none = np.empty(0, np.int64)
        if not known:
            return none, none
        term, weight = np.array([t for t, _ in known]), np.array([w for _, w in known], np.int64)
        low, high = self.starts[term][None, :], self.starts[term + 1][None, :]
        # open nodes of each level: bound, number of the node, and the terms' ranges
        still = [(none, none, low[:0], high[:0]) for _ in range(self.levels + 1)]
        still[0] = (self._bounds(0, low, high, weight), np.zeros(1, np.int64), low, high)
        found, score, bar = none, none, max(least, 1)
        while True:
            tops = [int(x[0].max()) if len(x[0]) else 0 for x in still[: self.levels]]
            best = max(tops)
            if best < bar:
                break
            level = len(tops) - 1 - tops[::-1].index(best)
            bound, node, low, high = still[level]
            fits = bound >= bar
            if not fits.all():
                bound, node, low, high = bound[fits], node[fits], low[fits], high[fits]
            take = np.ones(len(bound), bool) if len(bound) <= BATCH else np.zeros(len(bound), bool)
            if len(bound) > BATCH:
                take[np.argpartition(-bound, BATCH)[:BATCH]] = True
            still[level] = (bound[~take], node[~take], low[~take], high[~take])
            node, low, high = node[take], low[take], high[take]
            zl, zh = self.zeros[level][low], self.zeros[level][high]
            node, low, high = np.concatenate([2 * node, 2 * node + 1]), np.concatenate([zl, self.first[level] + low - zl]), np.concatenate([zh, self.first[level] + high - zh])
            bound = self._bounds(level + 1, low, high, weight)
            fits = bound >= bar
            bound, node, low, high = bound[fits], node[fits], low[fits], high[fits]
            if level + 1 < self.levels:
                was = still[level + 1]
                still[level + 1] = tuple(np.concatenate([a, b]) for a, b in zip(was, (bound, node, low, high), strict=True))
            elif len(bound):
                found, score = np.concatenate([found, node]), np.concatenate([score, bound])
                if len(score) >= k:
                    bar = max(bar, int(np.partition(score, len(score) - k)[-k]))
                    found, score = found[score >= bar], score[score >= bar]
        return found, score


def _query_blocks(queries: DataFrame) -> Iterator[DataFrame]:
    """The queries in blocks of about QUERY_BYTES of text; their number is found by summing sizes by a hash, with no query on the driver."""
    size = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = size // QUERY_BYTES + 1
    for k in range(n):
        yield queries.where(F.pmod(F.xxhash64("_q"), F.lit(n)) == k) if n > 1 else queries


def search(index: DataFrame, queries: DataFrame, docs: int, k: int = TOP) -> DataFrame:
    """(_q, rank, doc_id, score): the best k documents of the index for each query (_q, a number, and text)."""
    out = None
    kind = index.schema["ids"].dataType.elementType
    spark = index.sparkSession
    for block in _query_blocks(queries):
        asked = {r["_q"]: Counter(terms(r["text"])) for r in block.collect()}  # a block of QUERY_BYTES
        wanted = {t for c in asked.values() for t in c}
        sent = spark.sparkContext.broadcast(wanted)

        def holding(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            wanted, n = sent.value, Counter()
            for b in batches:
                for vocabulary, starts in zip(b.column("terms").to_pylist(), b.column("starts").to_pylist(), strict=True):
                    sizes = np.diff(np.frombuffer(starts, np.int64)).tolist()
                    for t, size in zip(vocabulary.split(), sizes, strict=True):
                        if t in wanted:
                            n[t] += size
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(n), pa.binary()), "n": pa.array(list(n.values()), pa.int64())})

        held = index.select("terms", "starts").mapInArrow(holding, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
        weight = {bytes(r["term"]): term_weight(docs, r["n"]) for r in held.collect()}  # terms of the block
        plans = {q: [(t, n * weight[t]) for t, n in c.items() if t in weight] for q, c in asked.items()}
        plan = spark.sparkContext.broadcast(plans)

        def run(batches: Iterator[pa.RecordBatch], plan=plan) -> Iterator[pa.RecordBatch]:
            best: dict[int, list] = {q: [] for q in plan.value}
            for b in batches:
                for i in range(b.num_rows):
                    ids = b.column("ids")[i].values
                    tree = Tree(len(ids), *(b.column(c)[i].as_py() for c in ("terms", "starts", "bits", "impacts")))
                    for q, asks in plan.value.items():
                        was = best[q]
                        found, score = tree.search(asks, k, was[k - 1][0] if len(was) >= k else 1)
                        if len(found):
                            # of equal scores the smallest ids; a shard's documents are ordered by id
                            order = np.lexsort((found, -score))[:k]
                            rows = [(int(score[j]), ids[int(found[j])].as_py()) for j in order]
                            best[q] = sorted(was + rows, key=_rank)[:k]
            rows = [(q, s, d) for q, x in best.items() for s, d in x]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], to_arrow_type(kind)), pa.array([r[1] for r in rows], pa.int64())], names=["_q", "doc_id", "score"])

        rows = index.select("ids", "terms", "starts", "bits", "impacts").mapInArrow(run, f"_q long, doc_id {kind.simpleString()}, score long")
        out = rows if out is None else out.union(rows)
    order = Window.partitionBy("_q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("_q", "rank", "doc_id", "score")


def _rank(row: tuple) -> tuple:
    score, key = row
    return (-score, key is None, key if key is not None else 0)


def build(documents: DataFrame) -> tuple[Written, int]:
    """The index of all documents, and how many hold a term. Terms are read once; the shards' postings go when their trees are written."""
    first = Written(postings(spread(documents.select("doc_id", "text"))), "search-postings")
    docs, length = totals(first.df)
    index = Written(with_trees(first.df, docs, length), "search-index")
    first.drop()
    return index, docs


def ranked(documents: DataFrame, queries: DataFrame, key: str = "item_id", k: int = TOP) -> DataFrame:
    """key, rank, doc_id, score: the best k documents for the text of each row of queries."""
    numbered = Written(queries.select(F.col(key).alias("_key"), "text").withColumn("_q", F.monotonically_increasing_id()), "search-queries").df
    index, docs = build(documents)
    out = Written(search(index.df, numbered.select("_q", "text"), docs, k), "search-results")
    index.drop()
    return out.df.join(numbered.select("_q", "_key"), "_q").select(F.col("_key").alias(key), "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


ORACLE = r"""
WITH words AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
), found AS (
  SELECT r, doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), lengths AS (
  SELECT r, sum(tf)::BIGINT AS n FROM found GROUP BY r
), totals AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM found, totals GROUP BY term
), asked AS (
  SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), scores AS (
  SELECT item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len))))::BIGINT AS score
  FROM asked JOIN found USING (term) JOIN weights USING (term) JOIN lengths USING (r), totals GROUP BY ALL
), placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
