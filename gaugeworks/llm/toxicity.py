"""Toxic passages by maximum-scoring segment search.

Tokens are words, of which the first STEM letters tell. Their scores are signed log-odds of
the labelled classes under a Dirichlet prior that shares MASS occurrences of each token
between the classes in proportion to their pooled counts. A token keeps that bound of its
confidence interval that is nearer to zero, if it is surely twice as likely in toxic texts
or surely a quarter less likely; every other token counts BACKGROUND. One linear scan finds
all maximal scoring segments of a text. Segment scores become extreme-value
(Karlin-Altschul) scores lambda*S - ln(K*n): lambda solves E[exp(lambda*score)] = 1 over
the tokens of clean texts, and K is fitted to the best segments of clean texts whose tokens
have been shuffled, so it doesn't depend on what clean texts say. Documents aggregate
their segments into three features, calibrated to a probability by logistic regression.

The model learns from a documented, bounded sample of labelled rows (TRAIN_DOCS whole
texts, chosen by a hash of the id). Each of FOLDS parts of it is searched with scores
learnt from the others, and the calibration is fitted to all of these. The sample is
written once and counted and searched by the executors: the driver sees the tokens that
score, and a few numbers for each document of the sample. Every text is scored whole.

Defined results: a null or empty text has no segment and gets the calibrated score of
"no toxic passage"; with no labels to learn from every score is 0; repeated rows score
alike; a null id is never held out and never learnt from; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import Written
from .common import id_crc, slices, table

#: Bound of the labelled training sample: the expected number of documents.
TRAIN_DOCS = 16_000
#: Letters of a word that tell, parts of the cross-fit, and occurrences of the prior.
STEM, FOLDS, MASS = 6, 4, 2.0
#: Bounds of log-odds lie so many standard errors off.
BOUND_Z = 1.645
#: Tokens that are surely this much likelier or less likely in toxic texts score; limits of scores.
LIKELIER, LESS_LIKELY = 0.7, 0.3
MAX_SCORE, MIN_SCORE = 6.0, -2.0
BACKGROUND = -0.05
#: A segment is reported if its extreme-value score is at least this.
SIGNIFICANT = 0.0
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return [w[:STEM] for w in _WORD.findall(text.lower())] if text else []


class Model(NamedTuple):
    scores: dict[str, float]
    lam: float
    log_k: float
    weights: tuple[float, ...] | None  # bias first; None: nothing was learnt


def maximal_segments(at: list[int], value: list[float], background: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last token, score); at: positions of tokens with a score of their own.

    Every other position counts background (< 0). Linear in the number of such tokens:
    a candidate list is kept and merged from its end, as each candidate is merged once.
    """
    out: list[list[float]] = []  # first, last, left cumulative, right cumulative, nearest candidate with a smaller left
    total, before = 0.0, -1
    for p, v in zip(at, value, strict=True):
        total += background * (p - before - 1)
        before = p
        left = total
        total += v
        if v <= 0:
            continue
        first, right = p, total
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = int(out[j][4])
            if j < 0 or out[j][3] >= right:
                out.append([first, p, left, right, j])
                break
            first, left = int(out[j][0]), out[j][2]
            del out[j:]
    return [(int(a), int(b), right - left) for a, b, left, right, _ in out]


def _search(words: list[str], model: Model) -> list[tuple[int, int, float]]:
    got = list(map(model.scores.get, words))
    at = [i for i, s in enumerate(got) if s is not None]
    return maximal_segments(at, [got[i] for i in at], BACKGROUND)


def _extreme(words: list[str], model: Model) -> list[tuple[int, int, float]]:
    shift = model.log_k + math.log(max(1, len(words)))
    return [(a, b, model.lam * s - shift) for a, b, s in _search(words, model)]


def segments(text: str | None, model: Model) -> tuple[list[tuple[int, int, float]], int]:
    """Maximal segments in token positions with extreme-value scores, and the number of tokens."""
    words = tokens(text)
    return _extreme(words, model), len(words)


def _features(words: list[str], model: Model) -> tuple[float, float, float]:
    found, n = _extreme(words, model), len(words)
    if not found:
        return 0.0, 0.0, 0.0
    best = max(s for _, _, s in found)
    mass = sum(s - SIGNIFICANT for _, _, s in found if s > SIGNIFICANT)
    return math.log1p(max(0.0, best + 5.0)), math.log1p(mass), math.log1p(mass * 100 / max(n, 20))


def features(text: str | None, model: Model) -> tuple[float, float, float]:
    """Best extreme-value score, mass of the significant segments, and the density of scoring tokens in them."""
    return _features(tokens(text), model)


def score(text: str | None, model: Model) -> float:
    if model.weights is None:
        return 0.0
    z = sum(w * x for w, x in zip(model.weights, (1.0, *features(text, model)), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def log_odds(t: Column, c: Column, n_t: float, n_c: float) -> Column:
    """The score of a token with t occurrences in toxic and c in clean texts, of n_t and n_c; null if it has none of its own."""
    a, b = t + MASS * n_t / (n_t + n_c), c + MASS * n_c / (n_t + n_c)
    odds = F.log(a / n_t) - F.log(b / n_c)
    off = BOUND_Z * F.sqrt(1 / a + 1 / b)
    return F.when(odds - off > LIKELIER, F.least(F.lit(MAX_SCORE), odds - off)).when(odds + off < -LESS_LIKELY, F.greatest(F.lit(MIN_SCORE), odds + off))


def karlin(scores: list[float], times: list[int], total: float, background: float = BACKGROUND) -> float:
    """lambda > 0 with E[exp(lambda*score)] = 1 over total clean tokens; scores that occur so many times, all others background."""
    values, share = np.array(scores), np.array(times, np.float64) / max(total, 1.0)
    rest = 1 - share.sum()

    def f(lam: float) -> float:
        return rest * math.exp(lam * background) + float((share * np.exp(lam * values)).sum()) - 1

    if rest * background + float((share * values).sum()) >= 0 or not (values[share > 0] > 0).any():
        return 1.0  # what log-odds that need no bounds would have
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights (bias first) by Newton steps with a small ridge."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """token, part, toxic, clean: how often a token occurs in the texts of each part and label."""
    found: dict[int, tuple[Counter, Counter]] = {k: (Counter(), Counter()) for k in range(FOLDS)}
    for s in slices(batches):
        for y, part, t in zip(s.column("toxic").to_pylist(), s.column("part").to_pylist(), s.column("text").to_pylist(), strict=True):
            found[part][1 if y else 0].update(t.split())
    rows = [(w, k, toxic[w], clean[w]) for k, (clean, toxic) in found.items() for w in sorted(toxic.keys() | clean.keys())]
    cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["token", "part", "toxic", "clean"])


def _shuffled_best(rows: DataFrame, models: list[Model]) -> list[float]:
    """ln K of each model: by the best segments of clean texts (toxic, part, text) that it hasn't learnt from or, the last one, of all, shuffled."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            got = []
            for part, t in zip(s.column("part").to_pylist(), s.column("text").to_pylist(), strict=True):
                words = t.split()
                mixed = np.array(words, object)[np.random.default_rng(zlib.crc32(t.encode())).permutation(len(words))].tolist()
                for k in (part, FOLDS):
                    if found := _search(mixed, sent.value[k]):
                        got.append((k, max(v for _, _, v in found) * sent.value[k].lam - math.log(len(mixed))))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.float64())], names=["model", "best"])

    means = rows.where("toxic = 0").select("part", "text").mapInArrow(run, "model int, best double").groupBy("model").agg(F.sum(F.col("best").cast("decimal(28,12)")).cast("double").alias("s"), F.count(F.lit(1)).alias("n"))
    # the mean of a standard Gumbel variable is Euler's constant
    found = {r["model"]: r["s"] / r["n"] - 0.5772 for r in means.collect()}
    return [found.get(k, found.get(FOLDS, 0.0)) for k in range(FOLDS + 1)]


def _sought(rows: DataFrame, models: list[Model]) -> np.ndarray:
    """toxic and the features of each row, by the model that hasn't learnt from it, sorted."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            got = [(float(y), *_features(t.split(), sent.value[part])) for y, part, t in zip(*(s.column(c).to_pylist() for c in ("toxic", "part", "text")), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*got, strict=True)], names=_SOUGHT)

    got = rows.select("toxic", "part", "text").mapInArrow(run, ", ".join(f"{n} double" for n in _SOUGHT)).toPandas().to_numpy(np.float64)
    return got[np.lexsort(got.T[::-1])]


_SOUGHT = ["toxic", "x0", "x1", "x2"]


def train(documents: DataFrame, labels: DataFrame, keep=None) -> Model:
    """Fit on a bounded sample of the labelled rows; equal texts are learnt from once, and are in one part."""
    named = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    named = named if keep is None else named.where(keep)
    share = min(1.0, TRAIN_DOCS / max(1, named.count()))
    if share < 1:
        named = named.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003)))
    named = named.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).hint("broadcast")  # at most about TRAIN_DOCS rows
    part = F.pmod(F.xxhash64("text"), F.lit(FOLDS))
    rows = documents.select("doc_id", "text").join(named, "doc_id").select("toxic", part.alias("part"), "text").mapInArrow(_words, "toxic int, part int, text string")
    sample = Written(rows, "labelled")
    once = Written(sample.df.groupBy("toxic", "part", F.xxhash64("text")).agg(F.first("text").alias("text")).select("toxic", "part", "text"), "labelled-once")
    each = once.df.mapInArrow(_counted, "token string, part int, toxic long, clean long")
    of = lambda c, k: F.sum(F.when(F.col("part") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}")
    counts = Written(each.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), *(of(c, k) for k in range(FOLDS) for c in ("toxic", "clean"))), "tokens")
    sums = counts.df.agg(*(F.sum(c).alias(c) for c in counts.df.columns[1:])).first()

    def learnt(c: str, k: int):
        """What a model has learnt from: all but its own part, and all of it for the last one."""
        return lambda x: x[c] if k == FOLDS else x[c] - x[f"{c}{k}"]

    totals = [(float(learnt("toxic", k)(sums) or 0), float(learnt("clean", k)(sums) or 0)) for k in range(FOLDS + 1)] if sums["toxic"] is not None else []
    if not totals or not all(totals[-1]):
        sample.drop()
        once.drop()
        counts.drop()
        return Model({}, 1.0, 0.0, None)
    col = {c: F.col(c) for c in counts.df.columns}
    scored = counts.df.select("token", *(learnt("clean", k)(col).alias(f"c{k}") for k in range(FOLDS + 1)), *(log_odds(learnt("toxic", k)(col), learnt("clean", k)(col), *totals[k]).alias(f"s{k}") if all(totals[k]) else F.lit(None).cast("double").alias(f"s{k}") for k in range(FOLDS + 1)))
    table_ = sorted(scored.where(F.coalesce(*(f"s{k}" for k in range(FOLDS + 1))).isNotNull()).collect())
    models = []
    for k in range(FOLDS + 1):
        own = [(r["token"], r[f"s{k}"], r[f"c{k}"]) for r in table_ if r[f"s{k}"] is not None]
        models.append(Model({w: x for w, x, _ in own}, karlin([x for _, x, _ in own], [n for *_, n in own], totals[k][1]), 0.0, None))
    models = [m._replace(log_k=x) for m, x in zip(models, _shuffled_best(once.df, models), strict=True)]
    got = _sought(sample.df, models)
    for t in (sample, once, counts):
        t.drop()
    if got[:, 0].min() == got[:, 0].max():
        return models[-1]
    return models[-1]._replace(weights=logistic(got[:, 1:], got[:, 0]))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for s in slices(batches):
        yield pa.RecordBatch.from_arrays([s.column("toxic").cast(pa.int32()), s.column("part").cast(pa.int32()), pa.array([" ".join(tokens(t)) for t in s.column("text").to_pylist()], pa.string())], names=["toxic", "part", "text"])


def with_scores(documents: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """The documents with one more column, the calibrated probability of label 1."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    sent = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            got = pa.array([score(t, sent.value) for t in s.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*s.columns, got], names=[*names, column])

    schema = StructType([f for f in documents.schema.fields] + [StructField(column, DoubleType())])
    return documents.mapInArrow(run, schema)


def passages(documents: DataFrame, model: Model) -> DataFrame:
    """Every significant toxic passage: doc_id, first and last token, extreme-value score."""
    kind = documents.schema["doc_id"].dataType
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            rows = [(i, a, b, v) for i, t in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True) for a, b, v in segments(t, sent.value)[0] if v > SIGNIFICANT]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], to_arrow_type(kind)), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())], names=["doc_id", "first_token", "last_token", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, first_token int, last_token int, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(documents, labels, keep=id_crc("doc_id", 4) != 2)
    out = with_scores(documents.select("doc_id", "text"), model)
    return out.select(
        "doc_id",
        F.coalesce(id_crc("doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )
