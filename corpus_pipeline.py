"""The corpus pipeline: five stages over documents, each taking all that its predecessor kept.

Defined results: a null text is the empty one for every stage and stays null; rows without
an id are never held to be copies; of rows that share an id but not their text each is
judged for itself; ties go to the smallest text hash; columns of documents may have any
names besides doc_id and text and pass all stages but the last; empty tables, empty labels
or an empty benchmark drop nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import decontaminate, pii, segment, simhash, toxicity
from gaugeworks.llm.common import free_name, id_crc, table
from gaugeworks.storage import written


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), keep=id_crc("doc_id", 4) != 2)
    score = free_name(docs, "toxicity")
    return toxicity.with_scores(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest id."""
    return simhash.deduplicated(docs, similarity=0.8, width=5)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by surrogates; n_chars follows the text."""
    out = pii.pseudonymised(docs, counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document, checked by decoding."""
    return segment.sampled(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("simhash_dedup", near_copies_out),
    ("decontamination", benchmark_out),
    ("pii", private_data_out),
    ("sentencepiece", pieces),
]

#: No stage is expressible in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
