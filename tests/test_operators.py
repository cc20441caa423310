"""Literal cases of the operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import geometry, hashing, naming
from gaugeworks.operators import dedup, graph, matching, ordered, policy, quality, splits, validation
from gaugeworks.schemas import CLASS_NAMES


def decision(spark, boxes):
    kind = "array<struct<class:string,confidence:double,bbox:array<double>>>"
    df = spark.createDataFrame([([(c, v, [0.0, 0.0, 1.0, 1.0]) for c, v in boxes],)], f"d {kind}")
    return df.select(policy.decide_nested(F.col("d")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("boxes", "result", "failing"),
    [
        ([("corrosion", 0.50)], "PASS", []),
        ([], "PASS", []),
        ([("corrosion", 0.51)], "FAIL", ["corrosion"]),
        ([("scratch", 0.54)], "PASS", []),
        ([("weld_crack", 0.41)], "FAIL", ["weld_crack"]),
        ([("weld_crack", float("nan"))], "PASS", []),
        ([("scratch", 0.9), ("dent", 0.9), ("dent", 0.8)], "FAIL", ["dent", "scratch"]),
    ],
)
def test_decision(spark, boxes, result, failing):
    got = decision(spark, boxes)
    assert (got["result"], got["failing_classes"]) == (result, failing)


def test_threshold_is_echoed(spark):
    assert decision(spark, [("scratch", 0.54)])["detections"][0]["threshold"] == 0.55


@pytest.mark.parametrize("bad", [-0.1, 1.1, float("nan"), float("inf")])
def test_thresholds_are_checked(bad):
    with pytest.raises(ValueError):
        policy.checked_thresholds({"scratch": bad}, 0.5)
    with pytest.raises(ValueError):
        policy.checked_thresholds({}, bad)
    with pytest.raises(ValueError):
        policy.checked_thresholds({"rust": 0.5}, 0.5)


@pytest.mark.parametrize(
    ("label", "rules"),
    [
        ((0, 0.5, 0.5, 0.2, 0.2), []),
        ((9, 0.5, 0.5, 0.0, 0.2), ["class_id", "zero_area"]),
        ((0, 1.2, 0.5, 0.2, 0.2), ["outside_unit", "below_or_right"]),
        ((0, float("nan"), 0.5, 0.2, 0.2), ["outside_unit"]),
        ((-1, 0.05, 0.5, 0.2, 0.2), ["class_id", "above_or_left"]),
    ],
)
def test_label_rules(spark, label, rules):
    df = spark.createDataFrame([label], "c int, x double, y double, w double, h double")
    assert df.select(geometry.label_problems(*map(F.col, "cxywh")).alias("p")).first()["p"] == rules


def test_flip_and_clip(spark):
    df = spark.createDataFrame([(0.2, 0.5, 0.2, 0.4)], "cx double, cy double, w double, h double")
    got = df.select(geometry.clipped(geometry.flipped(F.col("cx")), F.col("cy"), F.col("w"), F.col("h")).alias("b")).first()["b"]
    assert [round(got[k], 6) for k in ("cx", "cy", "w", "h")] == [0.8, 0.5, 0.2, 0.4]
    may = spark.createDataFrame([([0, 4],), ([5],), ([],), (None,)], "ids array<int>").select(geometry.flip_allowed(F.col("ids")).alias("f"))
    assert [r["f"] for r in may.collect()] == [True, False, True, True]


def test_hex_round_trip(spark):
    df = spark.createDataFrame([(-1,), (0,), (1 << 62,), (-(1 << 63),)], "h long").withColumn("x", hashing.hex16(F.col("h"))).withColumn("y", hashing.from_hex16(F.col("x")))
    assert all(r["h"] == r["y"] and len(r["x"]) == 16 for r in df.collect())


def test_slug(spark):
    cases = {"http://a/b/My%20File+1.jpeg?x=1": "My_File_1", "http://a/": "a", "": "image", "http://a/..": "image", "x" * 90 + ".png": "x" * 80}
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", naming.url_slug(F.col("u")).alias("s"))
    assert {r["u"]: r["s"] for r in df.collect()} == cases


def test_labels_dir(spark):
    df = spark.createDataFrame([("data/val/images",), ("x/images/test",), ("images/a/images/b",)], "d string")
    assert [r[0] for r in df.select(naming.labels_dir(F.col("d"))).collect()] == ["data/val/labels", "x/labels/test", "images/a/labels/b"]


def test_apportioned():
    assert splits.apportioned(22) == [16, 3, 3]
    assert splits.apportioned(3) == [1, 1, 1]
    assert splits.apportioned(1) == [1, 0, 0]
    assert splits.percent_cuts(700) == (490, 105)
    assert all(sum(splits.apportioned(n)) == n for n in range(60))


def test_balanced_plan():
    plan, counts = splits.balanced_plan()
    assert len(plan) == 700
    assert counts.tolist() == [196, 197, 193, 194, 195, 195, 197]


def straight_match(gt, pred):
    def iou(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        if w <= 0 or h <= 0:
            return 0.0
        return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)

    used = set()
    for c, box in gt:
        scored = [(iou(box, p[2]), i) for i, p in enumerate(pred) if i not in used and p[0] == c]
        best = max((s for s in scored if s[0] >= 0.5), default=None)
        if best:
            used.add(best[1])
    return len(used)


def test_matching_equals_the_plain_rule(spark):
    rnd = random.Random(3)

    def box():
        x, y = rnd.randrange(4) * 5.0, rnd.randrange(4) * 5.0
        return [x, y, x + 20, y + 20]

    images = [([(rnd.choice("ab"), box()) for _ in range(rnd.randrange(4))], [(rnd.choice("ab"), rnd.random(), box()) for _ in range(rnd.randrange(5))]) for _ in range(150)]
    schema = "gt array<struct<class:string,bbox:array<double>>>, pred array<struct<class:string,confidence:double,bbox:array<double>>>"
    got = spark.createDataFrame(images, schema).select("gt", "pred", matching.matched(F.col("gt"), F.col("pred")).alias("n")).collect()
    assert all(r["n"] == straight_match([tuple(g) for g in r["gt"]], [tuple(p) for p in r["pred"]]) for r in got)


def test_sweep_is_zero_filled(spark):
    schema = "gt array<struct<class:string,bbox:array<double>>>, pred array<struct<class:string,confidence:double,bbox:array<double>>>"
    got = matching.sweep(spark.createDataFrame([], schema)).collect()
    assert len(got) == 72
    assert all(r["precision"] == 0 and r["false_rejects"] is None for r in got)


def straight_greedy(rows, bits):
    shas, kept, out = {}, [], {}
    for i, sha, h, status in rows:
        if status != "ok":
            out[i] = (status, None)
        elif sha and sha in shas:
            out[i] = ("duplicate_sha256", shas[sha])
        else:
            near = next((j for j, g in kept if h is not None and bin((g ^ h) & (1 << 64) - 1).count("1") <= bits), None)
            if near is not None:
                out[i] = ("near_duplicate", near)
                continue
            if h is not None:
                kept.append((i, h))
            if sha:
                shas[sha] = i
            out[i] = ("ok", None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_equals_the_scan(spark, seed):
    rnd = random.Random(seed)
    seeds = [rnd.getrandbits(63) for _ in range(6)]
    rows = []
    for i in range(120):
        h = rnd.choice(seeds)
        for _ in range(rnd.randrange(9)):
            h ^= 1 << rnd.randrange(63)
        sha = rnd.choice(["", None, f"s{rnd.randrange(40)}", f"u{i}"])
        rows.append((i, sha, h if rnd.random() < 0.9 else None, "ok" if rnd.random() < 0.9 else "corrupt"))
    df = spark.createDataFrame(rows, "id long, sha256 string, dhash long, status string")
    got = {r["id"]: (r["verdict"], r["match"]) for r in dedup.greedy(df).collect()}
    assert got == straight_greedy(rows, 6)


def test_greedy_against_earlier_runs(spark):
    kept = spark.createDataFrame([("a", 7)], "sha256 string, dhash long")
    new = spark.createDataFrame([(1, "a", -1, "ok"), (2, "b", 5, "ok"), (3, "c", 255 << 40, "ok")], "id long, sha256 string, dhash long, status string")
    got = {r["id"]: r["verdict"] for r in dedup.greedy(new, kept=kept).collect()}
    assert got == {1: "duplicate_sha256", 2: "near_duplicate", 3: "ok"}


def test_near_pairs_equal_brute_force(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(63) for _ in range(20)]
    rows = [(i, rnd.choice(base) ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) ^ rnd.getrandbits(3)) for i in range(150)]
    first, sizes = {}, {}
    for i, x in rows:
        first.setdefault(x, i)
        sizes[x] = sizes.get(x, 0) + 1
    df = spark.createDataFrame(rows, "id long, dhash long")
    got = {tuple(r) for r in dedup.near_pairs(df).collect()}
    near = lambda x, y: bin(x ^ y).count("1") <= 6
    assert got == {(i, j, bin(x ^ y).count("1"), sizes[x], sizes[y]) for x, i in first.items() for y, j in first.items() if i < j and near(x, y)}
    members = {r["id"]: (r["representative"], r["n_links"]) for r in dedup.near_members(df).collect()}
    assert members == {i: (first[x], sum(near(x, y) for _, y in rows) - 1) for i, x in rows}
    none = dedup.near_members(spark.createDataFrame([(1, None)], "id long, dhash long")).first()
    assert (none["representative"], none["n_links"]) == (1, 0)


def test_links_equal_all_pairs(spark):
    rnd = random.Random(15)
    hashes = set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        for _ in range(8):
            y = x
            for k in rnd.sample(range(64), rnd.randrange(9)):
                y ^= 1 << k
            hashes.add(y - (1 << 64) if y >> 63 else y)
    got = [tuple(r) for r in dedup.hash_links(spark.createDataFrame([(h,) for h in hashes], "h long")).collect()]
    bits = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1")
    assert len(got) == len(set(got))
    assert set(got) == {(x, y, bits(x, y)) for x in hashes for y in hashes if x < y and bits(x, y) <= 6}


def test_ranks_and_running_columns_of_large_groups(spark):
    rnd = random.Random(25)
    rows = [(rnd.choice([None, "a", "a", "a", "b"]), i, rnd.randrange(100)) for i in rnd.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = {r["k"]: (r["rank"], r["_n"]) for r in ordered.ranked_within(df, ["g"], [F.col("k")]).collect()}
    groups = {g: sorted(k for x, k, _ in rows if x == g) for g in (None, "a", "b")}
    assert got == {k: (groups[g].index(k) + 1, len(groups[g])) for g, k, _ in rows}
    named = [r for r in rows if r[0]]
    value = {k: v for _, k, v in rows}
    for how, plain in ((F.sum, sum), (F.max, max)):
        out = {r["k"]: r["x"] for r in ordered.accumulated(df.where("g is not null"), "g", [F.col("k").desc()], how, ["v"], ["x"]).collect()}
        assert out == {k: plain(value[j] for j in groups[g] if j >= k) for g, k, _ in named}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chain_is_one_cluster_but_two_are_kept(spark):
    rows = [(1, "a", 0, "ok"), (2, "b", 0b111111, "ok"), (3, "c", 0b111111111111, "ok")]
    df = spark.createDataFrame(rows, "id long, sha256 string, dhash long, status string")
    assert {r["id"] for r in dedup.greedy(df).where("verdict = 'ok'").collect()} == {1, 3}
    assert {r["cluster"] for r in splits.near_clusters(df).collect()} == {1}


def test_quality_precedence(spark):
    cases = [("my_Diagram.png", True, True, 10, 10, 0.0, 0.0), ("a.png", False, False, 0, 0, 0.0, 0.0), ("a.png", True, False, 0, 0, 0.0, 0.0), ("a.png", True, True, 95, 700, 0.0, 0.0), ("a.png", True, True, 100, 601, 0.0, 0.0), ("a.png", True, True, 200, 200, 0.95, 0.01), ("a.png", True, True, 200, 200, 0.95, 0.2)]
    df = spark.createDataFrame(cases, "n string, r boolean, d boolean, w int, h int, wf double, ef double")
    got = [r[0] for r in df.select(quality.status(*map(F.col, ("n", "r", "d", "w", "h", "wf", "ef")))).collect()]
    assert got == ["screenshot_or_diagram", "unreadable", "corrupt", "too_small", "extreme_aspect", "screenshot_or_diagram", "ok"]


def test_validation_reports_leakage_and_pairs(spark):
    images = spark.createDataFrame([("train", "a", "a.png", "s1", 5, "ok"), ("val", "b", "b.png", "s1", 5, "ok"), ("val", "c", "c.png", "s3", -1, "ok")], "split string, stem string, filename string, sha256 string, dhash long, status string")
    files = spark.createDataFrame([("train", "a", True), ("val", "b", True), ("test", "z", True)], "split string, stem string, valid boolean")
    labels = spark.createDataFrame([("train", "a", 0, 9, 0.5, 0.5, 0.2, 0.2)], "split string, stem string, line_no int, class_id int, cx double, cy double, w double, h double")
    rules = sorted(r["rule"] for r in validation.validate(images, files, labels).collect())
    assert rules == ["duplicate_sha256", "image_without_label", "label_geometry", "label_without_image", "near_duplicate_leakage"]
    assert validation.class_warnings(labels).count() == len(CLASS_NAMES)


def test_mask_bounds(spark):
    df = spark.range(200, 220).selectExpr("id as x").crossJoin(spark.range(100, 110).selectExpr("id as y"))
    got = df.agg(*geometry.mask_bounds()).select(geometry.bounds_to_box(960, 640).alias("b")).first()["b"]
    assert (round(got["cx"] * 960, 6), round(got["cy"] * 640, 6), round(got["w"] * 960, 6), round(got["h"] * 640, 6)) == (210.0, 105.0, 20.0, 10.0)


def test_classes_without_annotations_are_counted_and_told(spark):
    rows = spark.createDataFrame([(0,), (0,), (9,), (-1,)], "class_id int")
    got = {r["class_id"]: r["n_annotations"] for r in validation.class_counts(rows).collect()}
    assert got == {0: 2, **dict.fromkeys(range(1, 7), 0)}
    least = validation.class_minimum(spark.createDataFrame([([0, 1],), ([0],)], "class_ids array<int>"))
    assert {r["class_id"]: (r["n_annotations"], r["is_least"]) for r in least.collect()} == {0: (2, False), 1: (1, False), **dict.fromkeys(range(2, 7), (0, True))}
