"""Importance resampling of documents towards a target distribution.

Every run of one or two words of a text falls into one of BUCKETS buckets. Higher-order
functions make the array of a document's buckets, so scoring never explodes a row: the
gains of all buckets are one literal array, and a document's weight is an aggregate over
its own array. The only thing that is shuffled is how often each bucket occurs, in all
documents and in the target. Weights are perturbed by Gumbel numbers of the ids, so the
highest scores are a sample without replacement.

Defined results: a null or empty text has no words, no features and the weight 0; a null
id is the empty text for its Gumbel number and comes first among equal scores; rows that
share an id are scored each for itself and tie in any order if they are equal; an empty
target gives gains from the documents' counts alone; an empty table gives an empty
result. Further columns pass resampled(), whatever their names, and are ignored otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ranked
from ..storage import Written, written
from .common import free_name, table

# Fixed values of the query's contract: what a word is, buckets, seed, least words, share drawn.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SEED = 7
LEAST_WORDS = 20
PERCENT = 25

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text in order, of which A-Z alone are lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0))


def buckets(w: Column, n: int = BUCKETS) -> Column:
    """The bucket of every run of one or two words of an array of words."""
    cell = lambda x: (F.crc32(x) % n).cast("int")
    rest = F.greatest(F.size(w) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(w, F.lit(1), rest), F.slice(w, F.lit(2), rest), lambda a, b: cell(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(w, cell), pairs)


def featured(texts: DataFrame, columns: list[str], n: int = BUCKETS) -> DataFrame:
    """The named columns with n_words and the array cells of each row's text."""
    split = texts.select(*columns, words(F.col("text")).alias("_words"))
    return split.select(*columns, F.size("_words").cast("long").alias("n_words"), buckets(F.col("_words"), n).alias("cells"))


def bucket_counts(features: DataFrame) -> DataFrame:
    """(bucket, n): summed up where the arrays are read, so that a task sends one row a bucket at most."""
    return features.select(F.explode("cells").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(features: DataFrame, target: DataFrame, n: int = BUCKETS) -> list[int]:
    """The gain of each bucket, in thousandths of a natural logarithm: n whole numbers, however large the tables are."""
    s, t = bucket_counts(features).withColumnRenamed("n", "s"), bucket_counts(target).withColumnRenamed("n", "t")
    full = features.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)
    rows = full.collect()  # a row a bucket
    all_s, all_t = (float(sum(r[c] for r in rows)) for c in "st")
    gain = {r["bucket"]: math.floor(1000 * math.log((r["t"] + 1) * (all_s + n) / ((r["s"] + 1) * (all_t + n)))) for r in rows}
    return [gain[k] for k in range(n)]


def gain_sum(cells: Column, gain: list[int]) -> Column:
    """The sum of the gains of a document's features."""
    of = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one literal
    return F.aggregate(cells, F.lit(0).cast("long"), lambda s, c: s + F.element_at(of, c + 1))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel number of an id, in thousandths, floored."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def scored(documents: DataFrame, target: DataFrame, columns: list[str] | None = None, seed: int = SEED, n: int = BUCKETS) -> DataFrame:
    """columns (doc_id if none are named), n_words, n_features, weight and score of each document.

    The arrays are written once, so that texts are cut into words a single time for both
    the counts and the scores.
    """
    columns = columns or ["doc_id"]
    features = written(featured(documents, columns, n), "importance-cells")
    gain = gains(features, featured(target, [], n), n)
    summed = features.select(*columns, "n_words", F.size("cells").cast("long").alias("n_features"), gain_sum(F.col("cells"), gain).alias("_total"))
    n = F.greatest("n_features", F.lit(1))  # a document without features has the sum 0
    mean = ((F.col("_total") - F.pmod("_total", n)) / n).cast("long")  # floored; the division has no remainder
    weighed = summed.select(*columns, "n_words", "n_features", mean.alias("weight"))
    return weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def drawn(scores: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """The rows with rank: 1, 2, 3 ... for the given share of those with enough words, by falling score and then rising id, null for all others.

    Ranks come from range partitions, so no task sorts the whole table; rows that may not be drawn are ranked behind the rest.
    """
    at = Written(scores.withColumn("_fit", F.col("n_words") >= least), "importance-scores").df  # read twice by the ranges
    wanted = at.where("_fit").count() * percent // 100
    placed = ranked(at, [F.col("_fit").desc(), F.col("score").desc(), F.col("doc_id").asc()], "_place")
    return placed.withColumn("rank", F.when(F.col("_fit") & (F.col("_place") <= wanted), F.col("_place"))).drop("_fit", "_place")


def resampled(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The documents drawn, with all their columns; those that share an id and a text are drawn together if the first of them is."""
    key = free_name(documents, "text_hash")
    hashed = documents.withColumn(key, F.xxhash64("text"))
    scores = scored(hashed.select("doc_id", "text", F.col(key).alias("text_hash")), target, ["doc_id", "text_hash"], seed)
    keep = written(drawn(scores, percent, least).where("rank is not null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "importance-drawn")
    return hashed.join(keep, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(key) == F.col("_hash")), "left_semi").select(*documents.columns)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn(scores).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 is computed byte by byte from its table of 256 remainders, once for each different feature.
ORACLE = r"""
WITH remainders AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) t(i))
), both_tables AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), numbered AS (
  SELECT row_number() OVER () AS r, side, doc_id, w FROM both_tables
), runs AS (
  SELECT r, side, unnest(w) AS f FROM numbered
  UNION ALL
  SELECT r, side, w[i] || ' ' || w[i + 1] FROM (SELECT r, side, w, unnest(range(1, len(w))) AS i FROM numbered)
), per_row AS (
  SELECT r, side, f, count(*) AS n FROM runs GROUP BY ALL
), cells AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(h), 2), lambda i: 16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS cell
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM per_row)), remainders
), placed AS (
  SELECT r, side, cell, sum(n) AS n FROM per_row JOIN cells USING (f) GROUP BY ALL
), totals AS (
  SELECT cell, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::DOUBLE AS t FROM placed GROUP BY cell
), gains AS (
  SELECT cell, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM totals, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM totals)
), sums AS (
  SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM placed JOIN gains USING (cell) WHERE side = 'd' GROUP BY r
), weighed AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, CASE WHEN n_features > 0 THEN ((total - ((total % n_features) + n_features) % n_features) // n_features)::BIGINT ELSE 0::BIGINT END AS weight FROM numbered LEFT JOIN sums USING (r) WHERE side = 'd'
), scores AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score FROM weighed
), places AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS n FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END::BIGINT AS rank FROM places
"""
