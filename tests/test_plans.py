"""Whole jobs on small pictures and configuration files."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import raster
from gaugeworks.plans import inspect
from gaugeworks.sources import config, images, web


def pgm(a):
    return b"P5 %d %d 255\n" % (a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()


def test_clean_a_folder(spark, tmp_path):
    rnd = np.random.default_rng(0)
    a = rnd.integers(0, 200, (128, 160))
    b = a.copy()
    b[:3, :3] = 0
    for name, content in {"a.png": pgm(a), "b.png": pgm(a), "c.png": pgm(b), "d.png": pgm(a[:50]), "e.png": b"broken", "diagram1.png": pgm(a), "f.png": pgm(np.full((200, 200), 255)), "g.png": pgm(a.T)}.items():
        (tmp_path / name).write_bytes(content)
    got = {r["filename"]: (r["status"], r["match_name"]) for r in inspect.cleaned(inspect.assessed(images.scan(spark, str(tmp_path)))).collect()}
    assert got == {
        "a.png": ("ok", None),
        "b.png": ("duplicate_sha256", "a.png"),
        "c.png": ("near_duplicate", "a.png"),
        "d.png": ("too_small", None),
        "e.png": ("corrupt", None),
        "diagram1.png": ("screenshot_or_diagram", None),
        "f.png": ("screenshot_or_diagram", None),
        "g.png": ("ok", None),
    }


def test_area_resize_keeps_the_mean():
    a = np.random.default_rng(1).random((37, 53))
    assert np.isclose(raster.area_resized(a, 8, 9).mean(), a.mean(), atol=1e-9)
    ramp = np.tile(np.arange(90.0), (16, 1))
    assert raster.difference_hash(ramp) == -1
    assert raster.difference_hash(ramp[:, ::-1]) == 0


def test_mock_inspection(spark):
    r = inspect.inspected(spark.createDataFrame([("x", 200, 100)], "image string, width int, height int")).first()
    assert r["decision"]["result"] == "FAIL" and r["decision"]["failing_classes"] == ["corrosion"] and r["mock"]
    assert r["decision"]["detections"][0]["bbox"] == [70.0, 40.0, 130.0, 60.0]


def test_evaluation_records(spark):
    im = spark.createDataFrame([("val", "a", 100, 100), ("val", "b", 100, 100)], "split string, stem string, width int, height int")
    lb = spark.createDataFrame([("val", "a", 0, 9, 0.5, 0.5, 0.2, 0.2)], "split string, stem string, line_no int, class_id int, cx double, cy double, w double, h double")
    sc = im.select("split", "stem", F.array().cast("array<struct<class:string,confidence:double,bbox:array<double>>>").alias("pred"))
    got = {r["image"]: r["gt"] for r in inspect.evaluation_records(im, lb, sc).collect()}
    assert got["b"] == [] and got["a"][0]["class"] == "9" and [round(x, 6) for x in got["a"][0]["bbox"]] == [40.0, 40.0, 60.0, 60.0]


def test_configuration(tmp_path):
    p = tmp_path / "t.yaml"
    p.write_text("# limits\ndefault: 0.5\nstatus: EXAMPLE\nthresholds:\n  scratch: 0.55\n  weld_crack: .4  # low\n")
    assert config.thresholds(str(p)) == (0.5, {"scratch": 0.55, "weld_crack": 0.4}, "EXAMPLE")
    assert config._plain(p.read_text())["thresholds"] == {"scratch": 0.55, "weld_crack": 0.4}
    d = tmp_path / "d.yaml"
    d.write_text("path: data\nval: val/images\ntest: test.txt\n")
    assert config.image_dir(str(d), "val") == str(tmp_path / "data" / "val/images")
    with pytest.raises(ValueError):
        config.image_dir(str(d), "test")
    assert config.database_options({"DATABASE_URL": "x"}) == {"url": "x"}


def test_command_line(spark, tmp_path, capsys):
    import json

    from gaugeworks.__main__ import main

    rnd = np.random.default_rng(7)
    shot = lambda: rnd.integers(0, 200, (120, 140))
    a = shot()
    for split, names in {"train": ["a", "b"], "val": ["c"], "test": ["d"]}.items():
        for kind in ("images", "labels"):
            (tmp_path / "set" / split / kind).mkdir(parents=True)
        for n in names:
            (tmp_path / "set" / split / "images" / f"{n}.png").write_bytes(raster.encode(a if n in "ac" else shot()))
            (tmp_path / "set" / split / "labels" / f"{n}.txt").write_text("0 0.5 0.5 0.2 0.2\n")
    (tmp_path / "set" / "test" / "images" / "empty.png").write_bytes(b"")
    (tmp_path / "set" / "test" / "labels" / "empty.txt").write_text("")
    assert main(["validate", str(tmp_path / "set")], spark) == 1
    got = json.loads(capsys.readouterr().out)
    assert (got["train_count"], got["val_count"], got["test_count"]) == (2, 1, 2)
    assert got["annotations_per_class"]["scratch"] == 4 and len(got["warnings"]) == 6
    assert any(e.startswith("duplicate sha256") for e in got["errors"]) and any(e.startswith("near-duplicate leakage: train/a.png and val/c.png differ by 0 bits") for e in got["errors"])
    assert "test/empty: corrupt" in got["errors"]

    assert main(["clean", str(tmp_path / "set"), str(tmp_path / "report"), str(tmp_path / "kept")], spark) == 0
    assert len(list((tmp_path / "kept").rglob("*.png"))) == 3
    assert main(["split", str(tmp_path / "kept"), str(tmp_path / "manifest")], spark) == 0
    assert spark.read.option("header", "true").csv(str(tmp_path / "manifest")).select("split").distinct().count() == 3
    predictions = tmp_path / "p.json"
    predictions.write_text(json.dumps([{"image": "a", "gt": [{"class": "dent", "bbox": [0, 0, 1, 1]}], "pred": [{"class": "dent", "confidence": 0.7, "bbox": [0, 0, 1, 1]}]}]))
    assert main(["sweep", str(predictions), str(tmp_path / "sweep")], spark) == 0
    assert spark.read.option("header", "true").csv(str(tmp_path / "sweep")).where("recall = '1.0000'").count() == 12
    picture = str(tmp_path / "kept" / "train" / "images" / "a.png")
    assert main(["inspect", str(tmp_path / "seen"), "--image", picture, "--dir", str(tmp_path / "set" / "test" / "images")], spark) == 0
    seen = {r["image"]: r["decision"] and r["decision"]["result"] for r in spark.read.json(str(tmp_path / "seen")).collect()}
    assert seen == {"a.png": "FAIL", "d.png": "FAIL", "empty.png": None}
    assert main(["plan", str(tmp_path / "plan"), "--limit", "20"], spark) == 0
    assert spark.read.option("header", "true").csv(str(tmp_path / "plan")).groupBy("split").count().where("split = 'train'").first()["count"] == 14


def test_urls_are_fetched(spark, tmp_path):
    import http.server
    import threading

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/a" else 404)
            self.send_header("Content-Type", "IMAGE/PNG; q=1")
            self.end_headers()
            self.wfile.write(b"bytes")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    rows = spark.createDataFrame([(f"{at}/a", "dent", "p"), (f"{at}/b", "dent", "p"), ("nothing", "dent", "p")], "url string, target_class string, source_page string")
    got = {r["url"].split("/")[-1]: r for r in web.fetched(rows, delay=0).collect()}
    server.shutdown()
    assert (got["a"]["mime"], bytes(got["a"]["content"]), got["a"]["error"]) == ("image/png", b"bytes", None)
    assert "404" in got["b"]["error"] and got["nothing"]["error"] and got["b"]["content"] is None
