"""Decoding, scoring of pictures and the inspection log."""

from __future__ import annotations

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import raster
from gaugeworks.functions.naming import fixed
from gaugeworks.operators import detect, rollup
from gaugeworks.plans import inspect
from gaugeworks.sources import log


def spotted(h, w, boxes, dark=20):
    a = np.full((h, w, 3), 200.0)
    for x1, y1, x2, y2 in boxes:
        a[y1:y2, x1:x2] = dark
    return a


# ---- numbers ----


def test_numbers_are_formatted_as_the_double_rounds(spark):
    rnd = random.Random(5)
    xs = [0.44375, 0.48125, 7.1 / 16, 0.00005, -0.00005, 0.0, -0.0, 2.5, 0.125, -0.03125, 1e-300, 99.99995, 0.99995, 4503599627.37049605, float("nan"), float("inf"), float("-inf")]
    xs += [rnd.uniform(-2, 2) for _ in range(2000)] + [round(rnd.uniform(0, 100), 5) for _ in range(2000)] + [rnd.randrange(10**5) / 2 ** rnd.randrange(30) for _ in range(2000)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1)
    for digits in (1, 3, 4, 6):
        assert [r[0] for r in df.select(fixed(F.col("x"), digits)).collect()] == [f"{x:.{digits}f}" for x in xs]
    assert spark.sql("SELECT cast(null AS double) AS x").select(fixed(F.col("x"), 4)).first()[0] == ""
    with pytest.raises(ValueError):
        fixed(F.lit(1.0), 0)


def test_means_do_not_depend_on_the_order(spark):
    rnd = random.Random(3)
    values = [round(rnd.uniform(0, 1), 6) for _ in range(997)] + [1e9, float("nan")]
    seen = set()
    for parts in (1, 3, 8):
        rnd.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts)
        seen.add(tuple(df.agg(rollup.exact_mean("v"), rollup.rounded_mean("v")).first()))
    assert len(seen) == 1
    half = spark.createDataFrame([(0.130912,), (0.130913,)], "v double").agg(rollup.rounded_mean("v")).first()[0]
    assert half == 0.130913
    assert spark.createDataFrame([], "v double").agg(rollup.rounded_mean("v")).first()[0] is None
    assert spark.createDataFrame([(-0.130912,), (-0.130913,)], "v double").agg(rollup.rounded_mean("v")).first()[0] == -0.130913


# ---- decoding ----


def bmp(a, bits=24):
    h, w, _ = a.shape
    body = a[::-1, :, ::-1].astype(np.uint8)
    if bits == 32:
        body = np.concatenate([body, np.zeros((h, w, 1), np.uint8)], axis=2)
    lines = b"".join(r.tobytes().ljust((w * bits // 8 + 3) // 4 * 4, b"\0") for r in body)
    return b"BM" + struct.pack("<IHHI", 54 + len(lines), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, len(lines), 0, 0, 0, 0) + lines


def test_colours_are_read():
    a = np.random.default_rng(0).integers(0, 256, (7, 5, 3)).astype(float)
    for content in (raster.encode_color(a), bmp(a), bmp(a, 32)):
        assert (raster.decode_color(content) == a).all()
    grey = raster.encode(a[:, :, 0])
    assert (raster.decode_color(grey) == a[:, :, :1]).all() and (raster.decode(grey) == a[:, :, 0]).all()
    assert np.allclose(raster.decode(bmp(a)), a @ raster.GREY)


def test_broken_bytes_are_null_but_unreadable_kinds_are_an_error():
    for content in (None, b"", b"broken", raster.encode(np.zeros((9, 9)))[:-30], b"P6 9 9 255\nabc", bmp(np.zeros((4, 4, 3)))[:60]):
        assert raster.decode_color(content) is None
    try:
        import PIL  # noqa: F401
    except ImportError:
        for content in (b"\xff\xd8\xff\xe0rest", b"RIFF....WEBPVP8 ", b"II*\0rest", b"GIF89a"):
            with pytest.raises(raster.MissingDecoder):
                raster.decode(content)


# ---- scoring ----


@pytest.mark.parametrize(("h", "w"), [(50, 80), (333, 100), (64, 64), (1, 900)])
def test_letterbox_and_back(h, w):
    rnd = np.random.default_rng(1)
    boxed, scale, left, top = detect.letterbox(rnd.integers(0, 256, (h, w, 3)).astype(float), 128)
    assert boxed.shape == (128, 128, 3) and boxed.dtype == np.uint8
    assert (boxed[:top] == detect.PADDING).all() and (boxed[:, :left] == detect.PADDING).all()
    a = np.array([[w * 0.1, h * 0.2, w * 0.5, h * 0.9, 0.5, 1]])
    there = a.copy()
    there[:, [0, 2]] = a[:, [0, 2]] * scale + left
    there[:, [1, 3]] = a[:, [1, 3]] * scale + top
    assert np.allclose(detect.restored(there, scale, left, top, w, h), a)
    outside = np.array([[left - 20.0, top - 20.0, left - 1.0, top - 1.0, 0.5, 1]])
    assert len(detect.restored(outside, scale, left, top, w, h)) == 0


def test_regions_equal_flood_fill():
    rnd = np.random.default_rng(2)
    for density in (0.1, 0.45, 0.6, 0.9):
        mask = rnd.random((23, 31)) < density
        label = detect.regions(mask)
        seen = np.zeros(mask.shape, bool)
        n = 0
        for y, x in zip(*np.nonzero(mask), strict=True):
            if seen[y, x]:
                continue
            n += 1
            todo, members = [(y, x)], []
            seen[y, x] = True
            while todo:
                p, q = todo.pop()
                members.append((p, q))
                for i, j in ((p + 1, q), (p - 1, q), (p, q + 1), (p, q - 1)):
                    if 0 <= i < 23 and 0 <= j < 31 and mask[i, j] and not seen[i, j]:
                        seen[i, j] = True
                        todo.append((i, j))
            assert len({label[m] for m in members}) == 1 and label[y, x] > 0
        assert label.max() == n and (label[~mask] == 0).all()


def test_pictures_reach_the_detector(spark):
    boxes = {"pore.ppm": [(20, 30, 60, 70)], "two.ppm": [(10, 10, 100, 20), (150, 40, 160, 110)], "clean.ppm": []}
    rows = [(k, raster.encode_color(spotted(120, 200, v))) for k, v in boxes.items()] + [("broken.png", b"broken"), ("empty.png", b""), ("none.png", None)]
    table = spark.createDataFrame(rows, "image string, content binary").repartition(2)
    got = {r["image"]: r for r in detect.scored(table, detect.DarkSpots, batch=2).collect()}
    assert set(got) == {r[0] for r in rows} and "content" not in got["pore.ppm"]
    for name, truth in boxes.items():
        assert (got[name]["width"], got[name]["height"], got[name]["model_version"]) == (200, 120, "dark-spots:60")
        found = sorted(tuple(d["bbox"]) for d in got[name]["pred"])
        assert np.allclose(found, sorted(truth), atol=1.0) if truth else found == []
    assert {d["class"] for d in got["two.ppm"]["pred"]} == {"scratch", "weld_crack"} and got["pore.ppm"]["pred"][0]["class"] == "weld_porosity"
    assert all(got[n]["width"] is None and got[n]["pred"] is None for n in ("broken.png", "empty.png", "none.png"))
    floor = detect.scored(table, detect.DarkSpots, floor=0.99).agg(F.sum(F.size("pred"))).first()[0]
    assert floor == 0
    decided = {r["image"]: r["decision"] for r in inspect.judged(detect.scored(table, detect.DarkSpots)).collect()}
    assert decided["pore.ppm"]["result"] == "FAIL" and decided["clean.ppm"]["result"] == "PASS" and decided["broken.png"] is None
    assert detect.scored(table.limit(0), detect.DarkSpots).count() == 0


def test_a_model_is_loaded_once_and_batches_are_bounded(spark):
    def load():
        import uuid

        class Counting(detect.DarkSpots):
            """Tells which of the loaded models it is, and the largest batch so far."""

            def __init__(self):
                super().__init__(side=64)
                self.name, self.most = uuid.uuid4().hex, 0

            def __call__(self, pictures):
                self.most = max(self.most, len(pictures))
                self.version = f"{self.name}:{self.most}"
                return super().__call__(pictures)

        return Counting()

    content = raster.encode_color(spotted(40, 40, []))
    table = spark.createDataFrame([(i, content) for i in range(50)], "i int, content binary").repartition(1)
    scored = detect.scored(table, load, batch=7).collect()
    assert len({r["model_version"].split(":")[0] for r in scored}) == 1 and max(int(r["model_version"].split(":")[1]) for r in scored) == 7


# ---- the log ----


def batch(spark, names, boxes=1):
    box = [("dent", 0.5, 1.0, 2.0, 3.0, 4.0)] * boxes
    rows = [(n, "m", "FAIL", 0.5, 1.0, "cpu", "", None, box) for n in names]
    schema = "image_name string, model_version string, overall_result string, max_confidence double, inference_ms double, device string, threshold_config string, notes string, boxes array<struct<class_name:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>"
    return spark.createDataFrame(rows, schema)


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "log")
    assert log.read(spark, root, "inspections").count() == 0
    log.append(batch(spark, ["b", "a"], 2), root, [F.col("image_name")], block=3)
    with monkeypatch.context() as m:
        m.setattr(log, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            log.append(batch(spark, ["x"]), root, [F.col("image_name")], block=3)
    assert {r["image_name"] for r in log.read(spark, root, "inspections").collect()} == {"a", "b"}
    assert log.read(spark, root, "detections").count() == 4
    log.append(batch(spark, ["c", "d", "e", "f"]), root, [F.col("image_name")], block=3)
    seen = {r["image_name"]: r["inspection_id"] for r in log.read(spark, root, "inspections").collect()}
    assert seen["a"] == 1 and seen["b"] == 2 and len(set(seen.values())) == 6 and seen["c"] > 3 and seen["c"] < seen["d"] < seen["e"] < seen["f"]
    children = log.read(spark, root, "detections").collect()
    assert len({r["detection_id"] for r in children}) == 8 and {r["inspection_id"] for r in children} == set(seen.values())
    assert log.read(spark, root, "inspections").where("notes <> '' or timestamp is null").count() == 0
    log.append(batch(spark, []), root, [F.col("image_name")])
    assert log.read(spark, root, "inspections").count() == 6


def test_writers_never_share_a_block(spark, tmp_path):
    import threading

    got: list[int] = []
    root = str(tmp_path / "log")
    threads = [threading.Thread(target=lambda: got.extend(log.reserve(spark, root, "inspections", 25, 10))) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(got) == 12 and len(set(got)) == 12


def test_inspect_scores_and_logs(spark, tmp_path, capsys):
    from gaugeworks.__main__ import main

    (tmp_path / "in").mkdir()
    for name, boxes in {"a.ppm": [(5, 5, 40, 40)], "b.ppm": []}.items():
        (tmp_path / "in" / name.replace(".ppm", ".png")).write_bytes(raster.encode(spotted(90, 90, boxes)[:, :, 0]))
    (tmp_path / "in" / "c.png").write_bytes(b"broken")
    first = str(tmp_path / "in" / "b.png")
    args = ["inspect", str(tmp_path / "out"), "--image", first, "--dir", str(tmp_path / "in"), "--detector", "gaugeworks.operators.detect:DarkSpots", "--log", str(tmp_path / "log")]
    assert main(args, spark) == 0
    lines = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*.json")) for x in f.read_text().splitlines()]
    assert [x["image"] for x in lines] == ["b.png", "a.png", "b.png", "c.png"]
    assert [x.get("decision", {}).get("result") for x in lines] == ["PASS", "FAIL", "PASS", None]
    logged = log.read(spark, str(tmp_path / "log"), "inspections").orderBy("inspection_id").collect()
    assert [(r["image_name"], r["overall_result"], r["model_version"]) for r in logged] == [("b.png", "PASS", "dark-spots:60"), ("a.png", "FAIL", "dark-spots:60"), ("b.png", "PASS", "dark-spots:60")]
    found = log.read(spark, str(tmp_path / "log"), "detections").collect()
    assert [(r["inspection_id"], r["class_name"]) for r in found] == [(2, "weld_porosity")]
    assert main(["dashboard", str(tmp_path / "dash"), "--log", str(tmp_path / "log")], spark) == 0
    assert spark.read.option("header", "true").csv(str(tmp_path / "dash")).where("total_inspections = 3 and failure_rate = '0.3333'").count() == 1
    assert main(["recent", "--log", str(tmp_path / "log"), "-n", "2"], spark) == 0
    assert "a.png" in capsys.readouterr().out
