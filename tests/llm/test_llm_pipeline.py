"""The pipeline stage by stage: each takes what its predecessor kept, and its decisions take effect."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import decontaminate, pii

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, []
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    n = len(seen)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append((name, docs.count()))
        if k < 4:
            assert docs.columns == columns
            assert docs.select("doc_id").distinct().count() == sizes[-1][1]
    assert [s for s, _ in sizes] == ["toxicity", "simhash_dedup", "decontamination", "pii", "sentencepiece"]
    counts = [c for _, c in sizes]
    assert n >= counts[0] >= counts[1] >= counts[2] == counts[3] > n // 2
    kept = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
    assert all(kept[i]["text"] == pii.replaced(seen[i])[0] for i in kept)
    # exact copies leave one document
    assert len({r["text"] for r in kept.values()}) == len(kept)
    # no kept document holds an item word for word
    items = [" ".join(w.decode() for w in decontaminate.words(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = [" ".join(w.decode() for w in decontaminate.words(r["text"])) for r in kept.values()]
    assert not any(i in p for i in items for p in plain)
    assert spark.read.parquet(str(tmp_path / "4")).where("not decoded_ok").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_empty_documents_pass(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("clash", ["toxicity", "toxicity_", "score", "_toxicity", "n_entities", "entity_types", "hash", "_id", "first", "ids", "item_id", "n"])
def test_columns_of_any_name_pass_all_stages(spark, clash):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn(clash, F.col("doc_id") * 3)
    docs = docs.union(docs.limit(20)).union(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long"))).union(docs.limit(3).withColumn("text", F.lit(None).cast("string")))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    assert docs.where(f"{clash} <> doc_id * 3").count() == 0
    assert docs.where("doc_id is null").count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(20), SF).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_empty_benchmark_and_labels_drop_nothing(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert stages["toxicity"](spark, docs, str(tmp_path)).count() == docs.count()
    assert stages["decontamination"](spark, docs, str(tmp_path)).count() == docs.count()
