"""Matching at ten overlaps, average precision and suppression against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import matching, suppress
from gaugeworks.schemas import CLASS_NAMES

BOXES = "array<struct<class:string,bbox:array<double>>>"
PREDICTIONS = "array<struct<class:string,confidence:double,bbox:array<double>>>"


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def made(rnd, images=40, classes=3):
    out = []
    for k in range(images):
        box = lambda: (lambda x, y: [x, y, x + rnd.randrange(8, 13), y + rnd.randrange(8, 13)])(rnd.randrange(20), rnd.randrange(20))
        gt = [(CLASS_NAMES[rnd.randrange(classes)], [float(v) for v in box()]) for _ in range(rnd.randrange(0, 6))]
        pred = [(c, rnd.randrange(10) / 10, [v + rnd.randrange(-2, 3) for v in b]) for c, b in gt if rnd.random() < 0.8]
        pred += [(CLASS_NAMES[rnd.randrange(classes)], rnd.randrange(10) / 10, [float(v) for v in box()]) for _ in range(rnd.randrange(0, 4))]
        rnd.shuffle(pred)
        out.append((k, gt, pred))
    return out


def plain_hits(gt, pred):
    order = sorted(range(len(pred)), key=lambda i: -pred[i][1])
    hits = {i: 0 for i in order}
    for k, least in enumerate(matching.LEVELS):
        used = set()
        for i in order:
            scored = [(iou(b, pred[i][2]), -j) for j, (c, b) in enumerate(gt) if c == pred[i][0] and j not in used]
            best = max((s for s in scored if s[0] >= least), default=None)
            if best:
                used.add(-best[1])
                hits[i] |= 1 << k
    return [(pred[i][0], pred[i][1], hits[i]) for i in order]


def plain_metrics(rows):
    found = [h for _, gt, pred in rows for h in plain_hits(gt, pred)]
    out = {}
    for c in {c for _, gt, _ in rows for c, _ in gt}:
        n = sum(x == c for _, gt, _ in rows for x, _ in gt)
        own = [(s, h) for x, s, h in found if x == c]
        sure = sorted({s for s, _ in own}, reverse=True)
        aps = []
        for k in range(10):
            curve = [(sum(h >> k & 1 for s, h in own if s >= t) / n, sum(h >> k & 1 for s, h in own if s >= t) / sum(s >= t for s, _ in own)) for t in sure]
            aps.append(sum(max((p for r, p in curve if r * 100 >= x - 1e-9), default=0.0) for x in range(101)) / 101)
            if not k:
                best = max(((2 * p * r / (p + r) if p + r else 0.0, t, p, r) for (r, p), t in zip(curve, sure, strict=True)), default=(0, 0, 0.0, 0.0))
        out[c] = (n, best[2], best[3], aps[0], sum(aps) / 10)
    return out


def test_hits_at_all_levels_and_metrics_equal_plain_loops(spark):
    rows = made(random.Random(11))
    images = spark.createDataFrame(rows, f"image int, gt {BOXES}, pred {PREDICTIONS}").repartition(3)
    got = {r["image"]: [tuple(h) for h in r["h"]] for r in images.select("image", matching.level_hits(F.col("gt"), F.col("pred")).alias("h")).collect()}
    assert got == {k: plain_hits(gt, pred) for k, gt, pred in rows}
    want = plain_metrics(rows)
    metrics = {r["class_name"]: (r["n_truths"], r["precision"], r["recall"], r["ap50"], r["ap50_95"]) for r in matching.detection_metrics(images).collect()}
    assert set(metrics) == {*want, "all"}
    for c, w in want.items():
        assert metrics[c] == pytest.approx(w, abs=2e-6)
    assert metrics["all"][0] == sum(w[0] for w in want.values())
    for k in range(1, 5):
        assert metrics["all"][k] == pytest.approx(sum(w[k] for w in want.values()) / len(want), abs=2e-6)
    vectors = matching.metric_vectors(matching.detection_metrics(images))
    assert all(r["precision"] is None for r in matching.metrics_by_class(vectors).collect())  # three of seven classes
    three = matching.metrics_by_class(matching.metric_vectors(matching.detection_metrics(images), CLASS_NAMES[:3]), CLASS_NAMES[:3])
    assert {r["class"]: r["ap50_95"] for r in three.collect()} == {c: metrics[c][4] for c in want}


def test_metrics_of_odd_images(spark):
    box = [0.0, 0.0, 9.0, 9.0]
    rows = [(None, None), ([], [("dent", 0.5, box)]), ([("dent", box)], None), ([("dent", box)], [("dent", float("nan"), box), ("dent", 0.9, box), ("scratch", 0.95, box)]), ([("scratch", box)], [])]
    got = {r["class_name"]: tuple(r)[1:] for r in matching.detection_metrics(spark.createDataFrame(rows, f"gt {BOXES}, pred {PREDICTIONS}")).collect()}
    assert got["scratch"] == (1, 0.0, 0.0, 0.0, 0.0) and got["dent"][:3] == (2, 1.0, 0.5) and got["dent"][3] == pytest.approx(51 / 101, abs=1e-6)
    assert matching.detection_metrics(spark.createDataFrame([], f"gt {BOXES}, pred {PREDICTIONS}")).count() == 0


# ---- suppression ----


def plain_suppressed(boxes, overlap):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b[3], b[0])):
        if not any(k[1:3] == b[1:3] and iou(k[4:], b[4:]) > overlap for k in kept):
            kept.append(b)
    return sorted(b[0] for b in kept)


@pytest.mark.parametrize(("overlap", "few"), [(0.5, 0), (0.5, 1000), (0.5, 40), (0.3, 0), (0.7, 0)])
def test_suppression_equals_a_plain_loop(spark, overlap, few):
    rnd = random.Random(4)
    boxes = []
    for k in range(600):
        side = 2 ** rnd.uniform(1, 6)
        x, y = rnd.uniform(-30, 100), rnd.uniform(-30, 100)
        boxes.append((k, rnd.choice("ab"), rnd.choice(["dent", "scratch"]), rnd.randrange(20) / 20, x, y, x + side, y + side * rnd.uniform(0.6, 1.6)))
    schema = "key int, image string, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"
    df = spark.createDataFrame(boxes, schema).repartition(3)
    assert sorted(r["key"] for r in suppress.suppress(df, overlap, few=few).collect()) == plain_suppressed(boxes, overlap)


def test_suppression_of_odd_boxes(spark):
    schema = "key int, image string, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double, extra string"
    rows = [(1, "a", "dent", 0.5, 0.0, 0.0, 9.0, 9.0, "x"), (2, "a", "dent", 0.5, 0.0, 0.0, 9.0, 9.0, "y"), (3, "a", "dent", None, 0.0, 0.0, 9.0, 9.0, "z"), (4, "a", "dent", float("nan"), 0.0, 0.0, 9.0, 9.0, "z"), (5, "a", "dent", 0.9, 3.0, 3.0, 3.0, 9.0, None), (6, "b", "dent", 0.1, 0.0, 0.0, 9.0, 9.0, None)]
    for few in (0, 100):
        got = suppress.suppress(spark.createDataFrame(rows, schema), few=few).collect()
        assert sorted((r["key"], r["extra"]) for r in got) == [(1, "x"), (5, None), (6, None)] or sorted(r["key"] for r in got) == [1, 5, 6]
    assert suppress.suppress(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        suppress.suppress(spark.createDataFrame(rows, schema), overlap=0)


def test_an_array_is_folded(spark):
    df = spark.createDataFrame([([("dent", 0.2, [0.0, 0.0, 9.0, 9.0]), ("dent", 0.8, [0.0, 0.0, 9.0, 8.0]), ("scratch", 0.1, [0.0, 0.0, 9.0, 9.0]), ("dent", float("nan"), [0.0, 0.0, 1.0, 1.0])],), ([],)], f"pred {PREDICTIONS}")
    got = [[(p["class"], p["confidence"]) for p in r[0]] for r in df.select(suppress.suppressed(F.col("pred"))).collect()]
    assert got == [[("dent", 0.8), ("scratch", 0.1)], []]
