"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ
in two bits or fewer have one segment that differs in one bit at most, so they share a
variant of that segment with one bit wiped out. Every distinct fingerprint is indexed
under its 64 variants, an equality join finds the candidates and the whole distance is
verified in the join; a pair is emitted at one of its shared variants only. Equal
fingerprints are one node, so copies are never expanded into pairs.

A variant that very many fingerprints share is cut again: its members are indexed under
the one-bit variants of the two halves of the other segment. Which variants are cut
again follows from a sample, but not the result: both ways find the same pairs.

near_groups() serves a similarity bound instead of a distance of two bits. A Jaccard
similarity of 0.8 is about 9 of 64 differing bits, which no segment of useful width
survives, so there the fingerprint is WIDE x 64 bits and candidates meet under min-wise
pairs of shingles. The fingerprints' distance only leaves out hopeless candidates; every
link is verified on the two sets of shingles.

Defined results: a null or empty text has no words and the fingerprint zero; a text of
fewer words than a shingle is one shingle; a repeated or null id stays a row of its own;
an empty table gives an empty result; further columns are ignored, and deduplicated() lets
them pass, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..storage import Written, scope, written
from .common import free_name, slices, table

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 2
#: One fingerprint in so many is sampled to find the variants to be cut again, ...
SAMPLE = 64
#: ... those with at least so many sampled members.
HOT = 16

#: near_groups(): words of a fingerprint, pairs of least shingles, tolerance of the estimate in standard deviations.
WIDE, PAIRS, TOLERANCE = 8, 6, 3.0
#: Rounds of leaders, and leaders of a key in each.
ROUNDS, LEADERS = 4, 8
#: The distance says little about sets of fewer shingles, so these are always verified.
FEW = 32
#: Sets of shingles held while pairs are verified.
HELD = 256

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only; space and \x09-\x0d only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[width - 1 :], strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half the hashes."""
    n = len(hashes)
    if not n:
        return 0
    cells = hashes.astype("<u8").view(np.uint8).reshape(n, 8) + _BYTE
    counts = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits((counts * 2 > n).ravel(), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            fp = np.array([fingerprint(shingle_hashes(t, width)) for t in s.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([s.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _first_shared(low: Column, high: Column, width: int) -> Column:
    """The number of the first one-bit variant under which two values with these differences meet."""
    one = lambda x: F.when(x == 0, F.lit(0)).otherwise(F.bit_count(x - 1))
    return F.when(F.bit_count(low) <= 1, one(low)).otherwise(one(high) + width)


def _variants(low: Column, high: Column, width: int) -> Column:
    """(number, value) of the one-bit variants of two values of width bits."""
    number = F.sequence(F.lit(0), F.lit(2 * width - 1))

    def of(i: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(i, F.lit(width)))
        part = F.when(i < width, low).otherwise(high)
        return F.struct(i.alias("number"), part.bitwiseAND(F.bitwise_not(bit)).alias("value"))

    return F.transform(number, of)


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def links(prints: DataFrame) -> DataFrame:
    """(a, b) with a < b: all pairs of distinct fingerprints within MAX_DISTANCE bits. prints: distinct values of fp."""
    low, high = _low(F.col("fp"), 32), F.shiftrightunsigned("fp", 32)
    each = prints.select("fp", F.explode(_variants(low, high, 32)).alias("x")).select(
        "fp", F.col("x.number").alias("number"), F.call_function("shiftleft", F.col("x.number").cast("long"), F.lit(32)).bitwiseOR(F.col("x.value")).alias("key")
    )
    hot = (
        each.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0)
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= HOT)
        .select("key", F.lit(True).alias("hot"))
    )
    hot = written(hot, "hot-variants")
    marked = each.join(F.broadcast(hot) if hot.count() <= 100_000 else hot, "key", "left")
    other = F.when(F.col("number") < 32, F.shiftrightunsigned("fp", 32)).otherwise(_low(F.col("fp"), 32))
    whole = F.array(F.struct(F.lit(-1).alias("number"), F.lit(0).cast("long").alias("value")))
    indexed = marked.select(
        "fp", "number", "key", F.explode(F.when(F.col("hot"), _variants(_low(other, 16), F.shiftrightunsigned(other, 16), 16)).otherwise(whole)).alias("x")
    ).select("fp", "key", "number", F.col("x.number").alias("sub"), F.col("x.value").alias("rest"))
    a, b = indexed.alias("a"), indexed.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    rest = F.when(F.col("a.number") < 32, F.shiftrightunsigned(x, 32)).otherwise(_low(x, 32))
    # Spark takes exploded rows for as small as the fingerprints, so it would broadcast all variants
    return a.join(
        b.hint("merge"),
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.sub") == F.col("b.sub"))
        & (F.col("a.rest") == F.col("b.rest"))
        & (F.col("a.fp") < F.col("b.fp"))
        & (F.bit_count(x) <= MAX_DISTANCE)
        & (F.col("a.number") == _first_shared(_low(x, 32), F.shiftrightunsigned(x, 32), 32))
        & ((F.col("a.sub") < 0) | (F.col("a.sub") == _first_shared(_low(rest, 16), F.shiftrightunsigned(rest, 16), 16))),
    ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def grouped(prints: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest id reachable through links, for each row of (doc_id, fp)."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp")))
    own = roots.join(distinct, roots["node"] == distinct["fp"])
    smallest = own.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = own.join(smallest, "root").select("fp", "component_id")
    # written, so that the last join has two plain sides and a fingerprint with very many rows can be split
    named = written(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "components")
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def most_bits(similarity: float) -> int:
    """Differing bits of WIDE words that texts of this Jaccard similarity have, with the tolerance."""
    n, p = 64 * WIDE, math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(n * p + TOLERANCE * math.sqrt(n * p * (1 - p)))


def _shingle_set(text: str | None, width: int) -> tuple[int, np.ndarray]:
    """The node of a text, which is the digest of its set of shingles, and the set, sorted."""
    h = np.unique(shingle_hashes(text, width))
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes(), SEED)).view(np.int64)), h


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sets of shingles; two empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "hash", "node", "size", *(f"f{i}" for i in range(WIDE)), "keys"]
    for s in slices(batches):
        prints, keys, nodes, sizes = np.zeros((s.num_rows, WIDE), np.uint64), [], [], []
        for i, t in enumerate(s.column("text").to_pylist()):
            node, h = _shingle_set(t, width)
            nodes.append(node)
            sizes.append(len(h))
            if not len(h):
                keys.append([])
                continue
            each = [_mixed(h, k) for k in range(2 * PAIRS)]
            prints[i] = [fingerprint(x) for x in each[:WIDE]]
            least = np.array([x.min() for x in each])
            keys.append(_mixed(least[:PAIRS] ^ (least[PAIRS:] << np.uint64(1)), 99).view(np.int64).tolist())
        cols = [s.column("doc_id"), s.column("hash"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), *(pa.array(prints[:, k].view(np.int64)) for k in range(WIDE)), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=names)


def _node_texts(documents: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text): one text of each of these nodes, found again by the id and hash of one of its rows."""
    first = rows.groupBy("node").agg(F.min(F.struct("doc_id", "hash")).alias("r")).join(nodes, "node", "left_semi")
    one = written(first.select("node", F.col("r.doc_id").alias("id"), F.col("r.hash").alias("h")), "near-rows")
    found = documents.select("doc_id", "text").join(one, (F.xxhash64("text") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id")))
    return found.groupBy("node").agg(F.first("text").alias("text"))  # equal rows


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for s in slices(batches):
        found = [_shingle_set(t, width)[1].view(np.int64) for t in s.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([s.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=["node", "shingles"])


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets of shingles are as similar as that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def of(node: int, text: str | None) -> np.ndarray:
            if node not in held:
                if len(held) >= HELD:
                    held.clear()
                held[node] = _shingle_set(text, width)[1]
            return held[node]

        for s in slices(batches, "text_a"):
            rows = zip(*(c.to_pylist() for c in s.columns), strict=True)
            ok = [jaccard(of(a, x), of(b, y)) >= similarity for a, b, x, y in rows]
            yield s.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _near_nodes(documents: DataFrame, similarity: float, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, hash of the text, node) of each row, and (node, root) of the nodes that have near ones; nothing else stays written."""
    kept: list[Written] = []
    with scope(kept):
        kept += _linked_nodes(documents, similarity, width)
    rows, roots = kept
    return rows.df.select("doc_id", "hash", "node"), roots.df


def _linked_nodes(documents: DataFrame, similarity: float, width: int) -> tuple[Written, Written]:
    """The signatures of all rows, and the root of each node that has near ones.

    Rows with the same set of shingles are one node. Under each key some nodes, chosen by a
    hash, lead: those verified to be near one are linked to it and leave with the leaders, and
    the next round goes on with the rest, so a group of n copies costs n comparisons with each
    leader. Once all rounds are done, those that left are compared with all others of their
    round, and what is left at last in pairs, except where both are connected already. So any
    two nodes of a key that are similar enough end in one group.
    """
    prints = [f"f{i}" for i in range(WIDE)]
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, hash long, node long, size int, " + ", ".join(f"{f} long" for f in prints) + ", keys array<long>"
    rows = Written(documents.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(lambda b: _signatures(b, width), schema), "signatures")
    nodes = rows.df.groupBy("node").agg(F.first("size").alias("size"), *(F.first(f).alias(f) for f in prints), F.first("keys").alias("keys"))
    each = Written(nodes.select("node", "size", *prints, F.explode("keys").alias("key")), "near-keys")
    most = most_bits(similarity)
    shared = Written(each.df.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared-keys")
    left = Written(each.df.join(shared.df, "key", "left_semi"), "near-keys")
    each.drop()
    shared.drop()
    texts = Written(_node_texts(documents, rows.df, left.df.select("node").distinct()), "near-texts")

    def close(a: str, b: str) -> Column:
        bits = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}"))) for f in prints))
        small, large = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
        return (small / large >= similarity) & ((small < FEW) | (bits <= most))

    links, rounds = [], []
    own = ["node", "size", *prints]
    for k in range(ROUNDS):
        # written, so that the join below has two plain sides and a key with very many nodes can be split
        lot = F.pmod(F.xxhash64("node", F.lit(k)), F.lit(LEADERS))
        leader = Written(left.df.groupBy("key", lot.alias("lot")).agg(F.min(F.struct(F.xxhash64("node", F.lit(-1 - k)).alias("o"), *own)).alias("l")).select("key", *(f"l.{c}" for c in own)), "near-leaders")
        joined = left.df.alias("m").join(leader.df.alias("l"), (F.col("m.key") == F.col("l.key")) & (F.col("m.node") != F.col("l.node")) & close("m", "l"))
        met = Written(joined.select("m.key", F.col("m.node").alias("node"), F.col("l.node").alias("leader")), "near-met")
        pairs = Written(met.df.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct(), "near-pairs")
        found = Written(_verified(pairs.df, texts.df, similarity, width), "near-links")
        links.append(found.df)
        of = (F.least("node", "leader") == F.col("a")) & (F.greatest("node", "leader") == F.col("b"))
        near = Written(met.df.join(found.df, of, "left_semi").select("key", "node").distinct(), "near-linked")
        stay = left.df.join(leader.df.select("key", "node"), ["key", "node"], "left_anti")
        gone = Written(stay.join(near.df, ["key", "node"], "left_semi"), "near-gone")
        stayed = Written(stay.join(near.df, ["key", "node"], "left_anti"), "near-keys")
        for t in (leader, met, pairs, near, *([left] if not rounds else [])):  # what stayed in a round is read again below
            t.drop()
        left = stayed
        rounds.append((gone.df, gone.df.union(left.df)))
        if not left.df.limit(1).count():
            break
    else:
        rounds.append((left.df, left.df))
    # compared once all rounds are known, so that nodes connected under another key are left out
    known = Written(components(reduce(DataFrame.union, links)), "near-roots")

    # these joins carry the sets themselves and verify inside, so that only links come out of them
    sides = [written(reduce(DataFrame.union, (r[side].withColumn("round", F.lit(k)) for k, r in enumerate(rounds))), "near-sides") for side in (0, 1)]
    needed = sides[0].select("node").union(sides[1].select("node")).distinct()
    sets = written(texts.df.join(needed, "node", "left_semi").mapInArrow(lambda b: _sets(b, width), "node long, shingles array<long>"), "near-sets")

    def rooted(side: int) -> DataFrame:
        rows = sides[side].join(known.df, "node", "left").withColumn("root", F.coalesce("root", "node"))
        return written(rows.join(sets, "node"), "near-sides").alias("ab"[side])

    both = F.size(F.array_intersect("a.shingles", "b.shingles"))
    alike = both * (1 + similarity) >= similarity * (F.col("a.size") + F.col("b.size")) - 1e-9
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.round") == F.col("b.round"))
    rest = rooted(0).join(rooted(1), same & (F.col("a.root") != F.col("b.root")) & close("a", "b") & alike)
    links.append(written(rest.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct(), "near-links"))
    return rows, Written(components(reduce(DataFrame.union, links)), "near-roots")


def near_groups(documents: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id and component_id, the smallest id of the group of near-duplicates, for each row."""
    rows, roots = _near_nodes(documents, similarity, width)
    least = rows.groupBy("node").agg(F.min("doc_id").alias("least"))
    own = roots.join(least, "node")
    smallest = own.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = own.join(smallest, "root").select("node", "component_id")
    named = written(least.join(linked, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id")), "near-names")
    return rows.join(named, "node", "left").select("doc_id", "component_id")


def deduplicated(documents: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, of equal ids that of the smallest text hash, of equal rows any.

    Rows are near by the deletion variants of their fingerprints (links()), or by the
    similarity of their sets of shingles; groups are connected by both. They are made of rows, so rows that share an id but not their text are judged apart;
    rows without an id all stay. All columns pass, whatever their names.
    """
    at, named = free_name(documents, "hash"), documents.where("doc_id is not null")
    rows, roots = _near_nodes(named, similarity, width)
    # one small row a node and then a group; a node with very many rows is summed up where it is read
    first = rows.groupBy("node").agg(F.min(F.struct("doc_id", "hash")).alias("first"))
    best = first.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    best = written(best, "near-first")
    # the fingerprints' groups, too, are named by their first row, so both kinds of name are rows that components() connects
    marked_rows = named.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("doc_id"), "text")
    alike = grouped(written(fingerprints(marked_rows), "fingerprints")).select("doc_id.doc_id", "doc_id.hash", F.col("component_id").alias("b")).distinct()
    of_row = rows.join(roots, "node", "left").select("doc_id", "hash", F.coalesce("root", "node").alias("root")).join(best, "root").select("doc_id", "hash", F.col("first").alias("a")).distinct()
    merged = components(of_row.join(alike, ["doc_id", "hash"]).select("a", "b"))
    best = best.join(merged, best["first"] == merged["node"], "left").select(F.coalesce(merged["root"], "first").alias("first"))
    keep = written(best.select(F.col("first.doc_id").alias("doc_id"), F.col("first.hash").alias(at)).distinct(), "near-kept")
    marked = named.withColumn(at, F.xxhash64("text"))
    kept = marked.join(keep, ["doc_id", at], "left_semi")
    again = rows.groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.col("hash").alias(at))
    again = written(again.join(keep, ["doc_id", at], "left_semi"), "repeated-rows")
    if again.limit(1).count():  # equal rows
        one = kept.join(again, ["doc_id", at], "left_semi").dropDuplicates(["doc_id", at])
        kept = kept.join(again, ["doc_id", at], "left_anti").unionByName(one)
    return kept.select(*documents.columns).unionByName(documents.where("doc_id is null"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(fingerprints(table(spark, sf_dir, "documents")), "fingerprints")
    return grouped(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
