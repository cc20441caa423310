"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, UTF-8 encoded, and every ASCII byte that is no letter becomes a
space. All n-grams of ORDERS bytes are hashed into BUCKETS buckets. The log-probability
matrix (buckets x languages) is broadcast; a batch of texts is scored as one sparse matrix
in numpy: the flat bucket indices and the row offsets. A matrix of more than MATRIX_BYTES
is cut by language, and its parts score the texts one after the other.

Training counts come from a documented, bounded sample of labelled rows (about
TRAIN_DOCS whole texts, chosen by a hash of the id); every row is predicted.

Defined results: a null text or one without a letter is ``und`` with score 0; ties go
to the language first in the alphabet; with nothing to learn from, every row is
``und``; a null id is never held out and never learnt from; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_crc, slices, table

ORDERS = (2, 4)
BUCKETS = 1 << 15
SMOOTHING = 0.5
#: Bound of the training sample: the expected number of documents.
TRAIN_DOCS = 16_000
MATRIX_BYTES = 256 << 20

_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)
_LETTER = re.compile(r"[^\W\d_]")


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Bucket indices of all n-grams, one array per order, and the byte offsets of the texts.

    Each text is padded so that no n-gram reaches into the next one.
    """
    pad = b" " * max(ORDERS)
    data = [b" " + t.lower().encode("utf-8", "replace") + pad for t in texts]
    starts = np.zeros(len(data) + 1, np.int64)
    np.cumsum([len(d) for d in data], out=starts[1:])
    b = _CLEAN[np.frombuffer(b"".join(data) + pad, np.uint8)].astype(np.uint32)
    n = int(starts[-1])
    out, code = [], np.zeros(n, np.uint32)
    for k in range(max(ORDERS)):
        code |= b[k : k + n] << np.uint32(8 * k)
        if k + 1 in ORDERS:
            out.append(((code * np.uint32(2654435761)) ^ np.uint32(k * 0x9E37)) >> np.uint32(17))
    return out, starts


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for s in slices(batches):
        texts, langs = s.column(0).to_pylist(), s.column(1).to_pylist()
        index, starts = grams(texts)
        for i, lang in enumerate(langs):
            into = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for g in index:
                into += np.bincount(g[starts[i] : starts[i + 1]], minlength=BUCKETS)
    for lang, c in total.items():
        at = np.nonzero(c)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bucket", "n"])


#: Languages and their rows of the log-probability matrix (languages x buckets).
Part = tuple[list[str], np.ndarray]


def train(documents: DataFrame, keep=None) -> list[Part]:
    """The matrix in parts, from labelled rows only; no part where there is nothing to learn from."""
    rows = documents.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows if keep is None else rows.where(keep)
    share = min(1.0, TRAIN_DOCS / max(1, documents.count()))
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003)))
    cells = rows.select("text", "lang").mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs, most = sorted(cells["lang"].unique()), max(1, MATRIX_BYTES // (4 * BUCKETS))
    out = []
    for k in range(0, len(langs), most):
        own = langs[k : k + most]
        of = cells[cells["lang"].isin(own)]
        counts = np.full((len(own), BUCKETS), SMOOTHING)
        np.add.at(counts, (np.searchsorted(own, of["lang"].to_numpy(object)), of["bucket"].to_numpy(int)), of["n"].to_numpy(float))
        out.append((own, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)))
    return out


def log_probabilities(texts: list[str | None], logp: np.ndarray) -> np.ndarray:
    """Sums of the log-probabilities of each text's n-grams (texts x languages)."""
    index, starts = grams([t or "" for t in texts])
    sums = np.zeros((len(texts), len(logp)))
    for g in index:
        for j in range(len(logp)):
            sums[:, j] += np.add.reduceat(logp[j][g], starts[:-1], dtype=np.float64)
    return sums


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def identify(documents: DataFrame, model: list[Part]) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (the posterior probability); only the text is looked at."""
    ids = documents.schema["doc_id"]
    out = documents.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit(float("-inf")).alias("top"), F.lit(float("-inf")).alias("all"))
    for i, part in enumerate(model):
        sent = documents.sparkSession.sparkContext.broadcast(part)
        # the last part needn't hand the text on
        names = ["doc_id", "text", "lang", "top", "all"] if i + 1 < len(model) else ["doc_id", "lang", "top", "all"]

        def run(batches: Iterator[pa.RecordBatch], sent=sent, names=names) -> Iterator[pa.RecordBatch]:
            langs, logp = sent.value
            for s in slices(batches):
                texts = s.column("text").to_pylist()
                sums = log_probabilities(texts, logp)
                best, known = sums.argmax(1), np.array([has_letter(t) for t in texts])
                was, mine = s.column("top").to_numpy(zero_copy_only=False), sums[np.arange(len(texts)), best]
                better = known & (mine > was)  # earlier parts hold earlier languages, so a tie stays
                lang = [langs[b] if x else y for b, x, y in zip(best, better, s.column("lang").to_pylist(), strict=True)]
                whole = np.logaddexp(s.column("all").to_numpy(zero_copy_only=False), np.logaddexp.reduce(sums, axis=1))
                got = {"lang": pa.array(lang, pa.string()), "top": pa.array(np.maximum(was, mine)), "all": pa.array(whole)}
                yield pa.RecordBatch.from_arrays([got[n] if n in got else s.column(n) for n in names], names=names)

        kinds = {"text": "string", "lang": "string", "top": "double", "all": "double"}
        out = out.mapInArrow(run, f"doc_id {ids.dataType.simpleString()}, " + ", ".join(f"{n} {kinds[n]}" for n in names[1:]))
    known = F.col("lang").isNotNull()
    return out.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang_pred"), F.when(known, F.exp(F.col("top") - F.col("all"))).otherwise(F.lit(0.0)).alias("score"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = train(documents, keep=id_crc("doc_id", 5) != 0)
    out = identify(documents, model)
    return out.select("doc_id", F.coalesce(id_crc("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
