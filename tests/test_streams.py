"""The dashboard as a stream against the batch one, with late rows and restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gaugeworks.operators import rollup
from gaugeworks.streaming import hourly

SEEN = "inspection_id long, timestamp timestamp, overall_result string, inference_ms double"
FOUND = "inspection_id long, timestamp timestamp, class_name string, confidence double"


def test_both_grains_equal_the_batch_dashboard(spark, tmp_path):
    rnd = random.Random(2)
    start = datetime(2024, 3, 1)
    seen = [(i, start + timedelta(minutes=3 * i + rnd.randrange(40)), rnd.choice(["PASS", "FAIL"]), rnd.randrange(1000) / 8) for i in range(400)]
    found = [(i, t + timedelta(seconds=rnd.randrange(60)), rnd.choice(["dent", "scratch"]), rnd.randrange(100) / 100) for i, t, _, _ in seen for _ in range(rnd.randrange(3))]
    late = [(1000, start, "FAIL", 1.0)]  # comes when its hour has been written
    parts = [(seen, found), (late, [(1000, start, "dent", 1.0)])]
    read = lambda: (hourly.read(spark, str(tmp_path / "seen"), spark.createDataFrame([], SEEN).schema), hourly.read(spark, str(tmp_path / "found"), spark.createDataFrame([], FOUND).schema))
    for a, b in parts:
        spark.createDataFrame(a, SEEN).repartition(2).write.mode("append").parquet(str(tmp_path / "seen"))
        spark.createDataFrame(b, FOUND).repartition(2).write.mode("append").parquet(str(tmp_path / "found"))
        out = hourly.drained(hourly.dashboard(*read()), str(tmp_path / "run"))  # goes on from where it stopped
    got = {(r["start"], r["defect_class"]): tuple(r)[1:5] + tuple(r)[6:] for r in out.collect()}
    assert out.count() == len(got)
    mark = min(max(t for _, t, _, _ in seen), max(t for _, t, _, _ in found)) - timedelta(hours=3)
    batch = rollup.dashboard(spark.createDataFrame(seen, SEEN), spark.createDataFrame(found, FOUND).drop("timestamp"), {"start": F.date_trunc("hour", F.col("timestamp"))}, rounded=False).collect()
    want = {
        (r["start"], r["defect_class"]): (r["total_inspections"], r["passes"], r["fails"], round(r["average_inference_ms"] * r["total_inspections"], 6), r["defect_count"], r["average_confidence"] and round(r["average_confidence"] * r["defect_count"], 6))
        for r in batch
        if r["start"] + timedelta(hours=1) <= mark
    }
    assert {k: (*v[:3], round(v[3], 6), v[4], v[5] and round(v[5], 6)) for k, v in got.items()} == want and len(want) > 20
