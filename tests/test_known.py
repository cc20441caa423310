"""Duplicates across batches through the index, and near hashes under hot keys."""

from __future__ import annotations

import random

import pytest

from gaugeworks.operators import dedup
from gaugeworks.operators.known import KnownFiles

SCHEMA = "id long, sha256 string, dhash long, status string"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def files(rnd, n=160):
    bases = [rnd.getrandbits(64) for _ in range(25)]
    out = []
    for i in range(n):
        h = rnd.choice(bases)
        for _ in range(rnd.choice([0, 0, 1, 3, 5, 8])):
            h ^= 1 << rnd.randrange(64)
        out.append((i, f"{h:x}" if rnd.random() < 0.9 else "", signed(h), "ok" if rnd.random() < 0.9 else "corrupt"))
    return out + [(n, None, None, "ok"), (n + 1, "x", None, "ok"), (n + 2, "x", None, "ok"), (n + 3, "y", 5, None)]


def test_batches_get_the_verdicts_of_one_run(spark, tmp_path):
    rows = files(random.Random(8))
    whole = {r["id"]: r["verdict"] for r in dedup.greedy(spark.createDataFrame(rows, SCHEMA)).collect()}
    got = {}
    for k, (i, j) in enumerate([(0, 70), (70, 71), (71, 130), (130, len(rows))]):
        index = KnownFiles(spark, str(tmp_path / "index"), buckets=8)
        index.take(spark.createDataFrame(rows[i:j], SCHEMA), k)  # a first try that is run again
        again = index.take(spark.createDataFrame(rows[i:j], SCHEMA).repartition(2), k)
        got |= {r["id"]: r["verdict"] for r in again.collect()}
        index.drop()  # the next batch may come in another session
    assert got == whole


def test_only_the_batch_is_shuffled(spark, tmp_path):
    index = KnownFiles(spark, str(tmp_path / "index"), buckets=8)
    rows = spark.createDataFrame(files(random.Random(9)), SCHEMA)
    index.take(rows, 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (index.same_digests(rows), index.near_hashes(rows)):
            lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
            depth = lambda x: len(x) - len(x.lstrip(" :+-"))
            scans = [i for i, x in enumerate(lines) if "FileScan parquet" in x]
            assert len(scan := [i for i in scans if "Bucketed: true" in lines[i]]) == 1 == len(scans), lines
            at = depth(lines[scan[0]])
            for x in reversed(lines[: scan[0]]):  # from the index's scan up to its join nothing is dealt anew
                if depth(x) < at:
                    at = depth(x)
                    assert "Exchange" not in x, lines
                    if "Join" in x:
                        break
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("hot", [2, 10, 10_000])
def test_hot_keys_find_the_same_links(spark, monkeypatch, hot):
    monkeypatch.setattr(dedup, "HOT", hot)
    rnd = random.Random(3)
    hashes = sorted({signed(sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 7)))) for _ in range(300)} | {signed(rnd.getrandbits(64)) for _ in range(50)})
    want = {(a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for a in hashes for b in hashes if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 6}
    got = dedup.hash_links(spark.createDataFrame([(h,) for h in hashes], "h long").repartition(3)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert dedup.hash_links(spark.createDataFrame([], "h long")).count() == 0
