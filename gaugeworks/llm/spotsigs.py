"""SpotSigs document fingerprints.

A signature is an anchor (a common word) with the CHAIN content words that follow it;
a document's fingerprint is the digest of its set of signatures, and two documents are
compared by the Jaccard similarity of their sets. Likenesses are exact. Where only those of
a least likeness are wanted, sets whose lengths differ too much are not compared at all, and
a running bound stops hopeless comparisons.

Documents are dealt to buckets, ranges of ids of about BUCKET_BYTES of text, one to a
partition; each bucket gets a copy of the row that follows its last. The driver holds the
buckets' bounds and first rows, by id and hash only.

Words are runs of letters (the ranges below), lower-cased.

Defined results: null counts as the empty text; a text with words but without an anchor
uses every word as one; a text without words has its own content as its one signature, and
the empty text has none (two empty sets are alike, an empty and another set are not).
Documents of equal id follow each other in the descending order of their text's hash, null
ids come last, and a lone document is its own follower. Ids may be numbers or strings. An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, NumericType, StringType, StructField, StructType

from .common import slices, table

CHAIN = 2
#: Text of one bucket, about, and keys sampled for each to find its bounds.
BUCKET_BYTES, SAMPLED = 32 << 20, 50

# Common words of English, German, French and Spanish, which serve as anchors.
COMMON = frozenset(
    "a about all an and are as at be been but by can for from had has have he her his i if in is it its more no not of on or one our she so that the their there they this to up was we were what when which who will with would you "
    "aber als am auch auf aus bei bin bis das dass dem den der des die du ein eine einem einen einer er es für hat hier ich ihr im ist ja kein man mit nach nicht noch nur oder sein sich sie sind so um und uns vom von vor war was wie wir zu zum zur über "
    "au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais me même mes moi mon ne nos notre nous on ou où par pas pour qu que qui sa se ses son sur ta te tu un une vos votre vous y "
    "al algo como con cual cuando del desde donde el ella entre era eres esta este ha hay la las lo los me mi muy más ni nos o os otra para pero poco por porque que quien se ser si sin sobre su sus también te tiene todo un una uno ya".split()
)

# Ranges of code points that are letters here.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0370-\u1fff\u3040-\ud7ff\uf900-\ufdff\U00020000-\U0003ffff"
_WORD = re.compile(f"[{LETTERS}]+")


def signatures(text: str | None) -> frozenset[str]:
    """The set of spot signatures of a text."""
    if not text:
        return frozenset()
    words = _WORD.findall(text.lower())
    if not words:
        return frozenset([f"={text}"])
    content, anchors = [], []
    for w in words:
        if w in COMMON:
            anchors.append((w, len(content)))
        else:
            content.append(w)
    found = {f"{w}:{' '.join(content[k : k + CHAIN])}" for w, k in anchors if k < len(content)}
    if not found:
        found = {" ".join(words[i : i + 1 + CHAIN]) for i in range(len(words))}
    return frozenset(found)


def digest(sigs: frozenset[str]) -> str:
    return hashlib.md5("\n".join(sorted(sigs)).encode("utf-8", "replace")).hexdigest()


def similarity(a: frozenset[str], b: frozenset[str], at_least: float = 0.0) -> float:
    """Jaccard similarity; 0 as soon as it is sure to be under at_least."""
    if a is b or not a and not b:
        return 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not small or len(small) < at_least * len(large):  # the partition by length
        return 0.0
    if not at_least:
        both = len(small & large)
        return both / (len(small) + len(large) - both)
    need = at_least * (len(small) + len(large)) / (1 + at_least)
    both, left = 0, len(small)
    for s in small:
        left -= 1
        both += s in large
        if both + left < need - 1e-9:
            return 0.0
    return both / (len(small) + len(large) - both)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of the following text, or all of it."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _compared(rows: Iterator[tuple]) -> Iterator[tuple]:
    """rows: (bucket, copied, id, text) in order; each bucket ends with the copied row that follows its last."""
    waiting = None
    for bucket, copied, ident, text in rows:
        text = text or ""
        if waiting is not None:
            was, its, own, sigs, print_ = waiting
            if was == bucket:
                mine = (sigs, print_) if text == own else ((s := signatures(text)), digest(s))
                new = edited(own, text)
                new_sigs = sigs if new == own else signatures(new)
                yield (
                    its,
                    len(own),
                    hashlib.sha256(new.encode("utf-8", "replace")).hexdigest(),
                    print_,
                    print_ if new_sigs is sigs else digest(new_sigs),
                    similarity(sigs, new_sigs),
                    similarity(sigs, mine[0]),
                )
                waiting = (bucket, ident, text, *mine)
            else:
                waiting = None
        if copied:
            waiting = None
        elif waiting is None:
            sigs = signatures(text)
            waiting = (bucket, ident, text, sigs, digest(sigs))


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def with_followers(documents: DataFrame) -> DataFrame:
    """(bucket, copied, doc_id, text): ranges of descending ids, each with a copy of the row that follows its last."""
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType
    none = F.lit(0 if isinstance(kind, NumericType) else "").cast(kind)
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text"), F.col("doc_id").isNotNull().alias("_there"), F.coalesce("doc_id", none).alias("_id"), F.xxhash64(text).alias("_h"))
    key = ["_there", "_id", "_h"]
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
    rate = max(1, n // (SAMPLED * parts))
    sample = sorted(map(tuple, rows.select(*key).where(F.pmod(F.xxhash64(*key), F.lit(rate)) == 0).collect()))  # about SAMPLED keys a bucket
    bounds = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    numbered = rows.withColumn("b", _bucket(bounds, {})(*key).getField("bucket"))
    largest = {r["b"]: tuple(r["top"]) for r in numbered.groupBy("b").agg(F.max(F.struct(*key)).alias("top")).collect()}  # a key a bucket
    order = sorted(largest)
    # the row after the last of a bucket is the first of the next lower one, and of the highest after the lowest
    goals = {largest[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    own = F.struct(F.col("x.bucket").alias("bucket"), F.lit(False).alias("copied"))
    copy = F.struct(F.col("x.goal").alias("bucket"), F.lit(True).alias("copied"))
    placed = rows.withColumn("x", _bucket(bounds, goals)(*key)).select("doc_id", "text", "_h", F.explode(F.when(F.col("x.goal") >= 0, F.array(own, copy)).otherwise(F.array(own))).alias("y"))
    dealt = placed.select("y.bucket", "y.copied", "doc_id", "text", "_h").repartitionById(parts, "bucket")
    return dealt.sortWithinPartitions("bucket", "copied", F.col("doc_id").desc_nulls_last(), F.col("_h").desc()).drop("_h")


def _bucket(bounds: list[tuple], goals: dict[tuple, int]):
    """bucket: how many bounds are at or below the key; goal: the bucket that needs a copy of the row, or -1."""

    def of(there: pd.Series, ids: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        keys = list(zip(there.tolist(), ids.tolist(), hashes.tolist(), strict=True))
        return pd.DataFrame({"bucket": [bisect_right(bounds, k) for k in keys], "goal": [goals.get(k, -1) for k in keys]}).astype("int32")

    return F.pandas_udf(of, "bucket int, goal int")


def fingerprints(documents: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and both likenesses."""
    kind = documents.schema["doc_id"].dataType
    kinds = [LongType(), StringType(), StringType(), StringType(), DoubleType(), DoubleType()]
    schema = StructType([StructField(n, k) for n, k in zip(_NAMES, [kind, *kinds], strict=True)])
    arrow = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for s in slices(batches):
                yield from zip(*(c.to_pylist() for c in s.columns), strict=True)

        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, arrow, strict=True)], names=_NAMES)

        for row in _compared(rows()):
            held.append(row)
            if len(held) >= 4096:
                yield flush()
        if held:
            yield flush()

    return with_followers(documents).mapInArrow(run, schema)


def op4_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


_RANGES = re.sub("[^\\x00-\\x7f]", lambda m: f"\\x{{{ord(m[0]):x}}}", LETTERS)
_COMMON = ", ".join(f"'{w}'" for w in sorted(COMMON))
ORACLE = f"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(text) OVER (ORDER BY doc_id DESC), CASE WHEN lead(doc_id) OVER (ORDER BY doc_id DESC) IS NULL THEN coalesce(first(text) OVER (ORDER BY doc_id DESC), '') ELSE '' END) AS f FROM documents),
both_ AS (SELECT doc_id, t, f, left(t, length(t) - length(t) // 3) || left(f, length(t) // 3) AS e FROM own),
texts AS (SELECT doc_id, 0 AS k, t FROM both_ UNION ALL SELECT doc_id, 1, e FROM both_),
lists AS (SELECT doc_id, k, regexp_extract_all(lower(t), '[{_RANGES}]+') AS l FROM texts),
words AS (SELECT doc_id, k, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM lists),
marked AS (SELECT *, w IN ({_COMMON}) AS anchor FROM words),
ranked AS (SELECT *, coalesce(sum((NOT anchor)::INT) OVER (PARTITION BY doc_id, k ORDER BY i), 0) AS c FROM marked),
content AS (SELECT doc_id, k, c, w, lead(w) OVER (PARTITION BY doc_id, k ORDER BY c) AS w2 FROM ranked WHERE NOT anchor),
spots AS (SELECT r.doc_id, r.k, r.w || ':' || concat_ws(' ', x.w, x.w2) AS s FROM ranked r JOIN content x ON x.doc_id = r.doc_id AND x.k = r.k AND x.c = r.c + 1 WHERE anchor),
chains AS (SELECT doc_id, k, concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p) AS s FROM words ANTI JOIN spots USING (doc_id, k) WINDOW p AS (PARTITION BY doc_id, k ORDER BY i)),
wordless AS (SELECT doc_id, k, '=' || t AS s FROM texts ANTI JOIN words USING (doc_id, k) WHERE t <> ''),
sets AS (SELECT doc_id, k, list_sort(list(DISTINCT s)) AS l FROM (SELECT * FROM spots UNION ALL SELECT * FROM chains UNION ALL SELECT * FROM wordless) GROUP BY ALL),
sides AS (SELECT doc_id, t, e, coalesce(a.l, []) AS a, coalesce(b.l, []) AS b FROM both_ LEFT JOIN (SELECT * FROM sets WHERE k = 0) a USING (doc_id) LEFT JOIN (SELECT * FROM sets WHERE k = 1) b USING (doc_id)),
three AS (SELECT *, coalesce(lead(a) OVER (ORDER BY doc_id DESC), first(a) OVER (ORDER BY doc_id DESC)) AS n FROM sides),
shared AS (SELECT *, len(list_intersect(a, b)) AS ab, len(list_intersect(a, n)) AS an FROM three),
likely AS (SELECT *, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE ab / (len(a) + len(b) - ab) END AS je, CASE WHEN len(a) + len(n) = 0 THEN 1.0 ELSE an / (len(a) + len(n) - an) END AS jn FROM shared)
SELECT doc_id, length(t) AS n_chars, sha256(e) AS edited_sha256, md5(array_to_string(a, chr(10))) AS fingerprint, md5(array_to_string(b, chr(10))) AS edited_fingerprint,
  je AS near_edited, jn AS near_next FROM likely
"""
