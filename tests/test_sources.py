"""Readers, writers and streams over small folders."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeworks.functions import raster
from gaugeworks.operators import matching, rollup, splits
from gaugeworks.plans import inspect
from gaugeworks.sources import config, files, images, sinks
from gaugeworks.streaming import hourly


def test_label_parsing(spark, tmp_path):
    d = tmp_path / "train" / "labels"
    d.mkdir(parents=True)
    (d / "a.txt").write_text("0 0.5 0.5 0.2 0.2\n\n  4   0.1 0.1 0.1 0.1  \n")
    (d / "b.txt").write_text("1.0 0.5 0.5 0.2 0.2\n")
    (d / "c.txt").write_text("")
    (d / "d.txt").write_text("0 0.5 0.5 0.2\n1 0.5 0.5 0.2 0.2")
    files = images.label_files(spark, str(d), "train")
    rows, marked = images.labels(files)
    assert sorted((r["stem"], r["line_no"], r["class_id"]) for r in rows.collect()) == [("a", 0, 0), ("a", 2, 4)]
    assert {r["stem"]: r["valid"] for r in marked.collect()} == {"a": True, "b": False, "c": True, "d": False}
    assert images.labels(files, "lines")[0].count() == 3


def test_image_scan(spark, tmp_path):
    (tmp_path / "x").mkdir()
    for n in ("a.JPG", "b.tif", "c.txt"):
        (tmp_path / n).write_bytes(b"1" + n.encode())
    (tmp_path / "x" / "d.png").write_bytes(b"2")
    assert {r["filename"] for r in images.scan(spark, str(tmp_path)).collect()} == {"a.JPG", "b.tif"}
    assert {r["stem"] for r in images.scan(spark, str(tmp_path), images.SPLIT_SUFFIXES, recursive=True).collect()} == {"a", "d"}
    assert images.scan(spark, str(tmp_path / "none")).count() == 0
    assert images.with_digests(images.scan(spark, str(tmp_path))).select("sha256").distinct().count() == 2


def test_predictions(spark, tmp_path):
    p = tmp_path / "p.json"
    p.write_text(json.dumps([{"image": "a", "split": "val", "dataset": "s", "gt": [{"class": "dent", "bbox": [0, 0, 1, 1]}], "pred": []}, {"image": "b", "gt": []}], indent=1))
    assert images.predictions(spark, str(p)).select("image", F.size("gt").alias("n")).collect() == [("a", 1), ("b", 0)]


def test_log_round_trip(spark):
    for t in ("log_i", "log_d"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    sinks.init_tables(spark, "log_i", "log_d")
    box = "array<struct<class_name:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>"
    schema = f"n int, image_name string, model_version string, overall_result string, max_confidence double, inference_ms double, device string, threshold_config string, boxes {box}"
    row = (1, "a.png", "m", "FAIL", 0.87, 12.5, "cpu", "t", [("corrosion", 0.87, 1.0, 2.0, 30.0, 40.0)])
    for _ in range(2):
        sinks.log_inspections(spark, spark.createDataFrame([row], schema), "n", "log_i", "log_d")
    assert [r[0] for r in spark.table("log_i").orderBy(F.desc("inspection_id")).select("inspection_id").collect()] == [2, 1]
    assert sorted((r["detection_id"], r["inspection_id"], r["x2"]) for r in spark.table("log_d").collect()) == [(1, 1, 30.0), (2, 2, 30.0)]
    for t in ("log_i", "log_d"):
        spark.sql(f"DROP TABLE {t}")


def test_hourly_stream(spark, tmp_path):
    src = spark.range(100).selectExpr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 5 as int), 0) as timestamp", "if(id % 4 = 0, 'FAIL', 'PASS') as overall_result", "cast(id as double) as inference_ms")
    src.write.parquet(str(tmp_path / "in"))
    stream = hourly.hourly_rollup(hourly.read(spark, str(tmp_path / "in"), src.schema))
    q = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("rolled")
    assert got.agg(F.sum("total_inspections"), F.sum("fails")).first() == (100, 25)
    assert got.count() == 9


def test_incremental_collection(spark, tmp_path):
    schema = "id long, sha256 string, dhash long, status string"
    for k, rows in enumerate([[(1, "a", 0, "ok"), (2, "a", 0, "ok")], [(3, "b", 1, "ok"), (4, "c", -1, "ok")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = hourly.collect_incrementally(hourly.read(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema), str(tmp_path / "kept"), str(tmp_path / "cp")).start()
        q.awaitTermination(120)
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "kept")).collect()} == {1, 4}


def test_pictures_without_bytes_are_corrupt_rows(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "a.png").write_bytes(raster.encode(np.random.default_rng(0).integers(0, 255, (100, 120))))
    (tmp_path / "b.jpg").write_bytes(b"")
    (tmp_path / "x" / "c.jpg").write_bytes(b"")
    (tmp_path / "d.txt").write_bytes(b"")
    got = {r["filename"]: r["status"] for r in inspect.assessed(images.scan(spark, str(tmp_path))).collect()}
    assert got == {"a.png": "ok", "b.jpg": "corrupt"}
    counts = {r["parent"]: r["n_images"] for r in images.folder_counts(spark, str(tmp_path)).collect()}
    assert counts == {tmp_path.name: 2, "x": 1}
    assert images.split_count(spark, str(tmp_path)) == 2
    (tmp_path / "list.txt").write_text("a\n\nb\n")
    assert images.split_count(spark, str(tmp_path / "list.txt")) == 2 and images.split_count(spark, str(tmp_path / "none.txt")) == 0


def test_label_files_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("train", "a", 0, 4, 0.5, 0.25, 0.125, 0.0625), ("train", "a", 1, 0, 0.1, 0.2, 0.3, 0.4)], "split string, stem string, line_no int, class_id int, cx double, cy double, w double, h double")
    files = spark.createDataFrame([("train", "a"), ("train", "none")], "split string, stem string")
    texts = {r["stem"]: r["text"] for r in sinks.label_text(rows, files).collect()}
    assert texts == {"a": "0 0.100000 0.200000 0.300000 0.400000\n4 0.500000 0.250000 0.125000 0.062500\n", "none": ""}
    for stem, text in texts.items():
        (tmp_path / f"{stem}.txt").write_text(text)
    back, marked = images.labels(images.label_files(spark, str(tmp_path), "train"))
    assert {r["class_id"]: r["cx"] for r in back.collect()} == {0: 0.1, 4: 0.5}
    assert {r["stem"]: r["valid"] for r in marked.collect()} == {"a": True, "none": True}


def test_targets_are_in_order(spark, tmp_path):
    for n in ("b.png", "a.png", "c.txt"):
        (tmp_path / n).write_bytes(b"1")
    got = [r["path"].split("/")[-1] for r in images.targets(spark, ["z.png"], str(tmp_path)).orderBy("place").collect()]
    assert got == ["z.png", "a.png", "b.png"]
    assert images.targets(spark, []).count() == 0


def test_kept_files_are_copied(spark, tmp_path):
    (tmp_path / "raw" / "k").mkdir(parents=True)
    for n in ("a.png", "k/b.png", "c.png"):
        (tmp_path / "raw" / n).write_bytes(n.encode())
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "old.png").write_bytes(b"")
    rows = spark.createDataFrame([("a.png", "ok"), ("k/b.png", "ok"), ("c.png", "corrupt")], "relative_path string, status string")
    with pytest.raises(FileExistsError):
        sinks.guarded(spark, str(tmp_path / "out"))
    sinks.guarded(spark, str(tmp_path / "new"))
    kept = files.under(spark, str(tmp_path / "raw")).join(rows.where("status = 'ok'"), "relative_path", "left_semi")
    assert files.dealt(kept, str(tmp_path / "out")) == 2
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.png")) == ["a.png", "k/b.png"]


def read_csv(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*.csv"))).splitlines()


def test_report_files(spark, tmp_path):
    schema = "gt array<struct<class:string,bbox:array<double>>>, pred array<struct<class:string,confidence:double,bbox:array<double>>>"
    sinks.sweep_file(matching.sweep(spark.createDataFrame([([("dent", [0.0, 0.0, 1.0, 1.0])], [("dent", 0.95, [0.0, 0.0, 1.0, 1.0])])], schema)), str(tmp_path / "sweep"))
    lines = read_csv(tmp_path / "sweep")
    assert lines[0] == "threshold,class_name,precision,recall,false_positives,false_negatives,false_rejects,note" and len(lines) == 73
    assert "0.9,all,1.0000,1.0000,0,0,,false reject not estimable: no confirmed-good images in this file" in lines
    sinks.sweep_file(matching.sweep(spark.createDataFrame([], schema)).limit(0), str(tmp_path / "none"))
    assert read_csv(tmp_path / "none") == lines[:1]
    seen = spark.createDataFrame([(1, "2024-01-01 05:00:00", "FAIL", 12.34567), (2, "2024-01-01 06:00:00", "PASS", 1.0)], "inspection_id long, timestamp string, overall_result string, inference_ms double")
    found = spark.createDataFrame([(1, "dent", 0.87654)], "inspection_id long, class_name string, confidence double")
    sinks.dashboard_file(rollup.dashboard(seen, found, rollup.hourly()), str(tmp_path / "dash"))
    assert read_csv(tmp_path / "dash")[1:] == ["2024-01-01,5,1,0,1,1.0000,12.346,dent,1,0.8765", "2024-01-01,6,1,1,0,0.0000,1.000,,0,"]
    sinks.append_log(spark.createDataFrame([("a", 1)], "f string, n int"), str(tmp_path / "log"))
    sinks.append_log(spark.createDataFrame([("b", 2)], "f string, n int"), str(tmp_path / "log"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "log")).count() == 2
    sinks.json_report(spark.createDataFrame([("a", 1)], "f string, n int"), str(tmp_path / "json"), ["n"])
    assert spark.read.json(str(tmp_path / "json")).columns == ["f"]
    manifest = spark.createDataFrame([("train", "b.png"), ("train", "a.png"), ("val", "c.png")], "split string, relative_path string")
    sinks.path_lists(manifest, str(tmp_path / "lists"))
    assert "".join(p.read_text() for p in (tmp_path / "lists" / "split=train").glob("part-*")) == "a.png\nb.png\n"
    sinks.by_split(manifest, str(tmp_path / "split"))
    assert spark.read.parquet(str(tmp_path / "split")).count() == 3


def test_sidecars(spark, tmp_path):
    plan = splits.planned(spark, prefix=5)
    assert plan.count() == 5 and plan.agg(F.max("seed")).first()[0] == splits.PLAN_SEED + 4
    summary = rollup.render_summary(plan.withColumn("digest", F.col("seed")), ["a", "b", "c", "d", "e", "f", "g"]).first().asDict()
    assert summary["images"] == summary["unique_digests"] == 5 and sum(summary["per_class"].values()) >= 5
    sinks.sidecars(spark, str(tmp_path), summary, ["a", "b"])
    assert (tmp_path / "classes.txt").read_text() == "a\nb\n"
    assert config.load(str(tmp_path / "data.yaml")) == {"path": ".", "train": "images/train", "val": "images/val", "test": "images/test", "names": {0: "a", 1: "b"}}
    assert json.loads((tmp_path / "stats.json").read_text())["first_seed"] == splits.PLAN_SEED
    assert "| images | 5 |" in (tmp_path / "README.md").read_text()
    assert config.database_options({}, f"jdbc:sqlite:{tmp_path}/sub/x.db")["url"].endswith("x.db") and (tmp_path / "sub").is_dir()


def test_png_round_trip_and_filters():
    import struct
    import zlib

    a = np.random.default_rng(3).integers(0, 256, (9, 7))
    for suffix in (".png", ".pgm"):
        assert (raster.decode(raster.encode(a, suffix)) == a).all()
    assert raster.decode(raster.PNG + b"broken") is None
    # a picture of each filter and three planes, made row by row
    rgb = np.random.default_rng(4).integers(0, 256, (5, 6, 3))
    lines, above = [], np.zeros(18, int)
    for y in range(5):
        row = rgb[y].ravel()
        left, corner = np.append([0, 0, 0], row[:-3]), np.append([0, 0, 0], above[:-3])
        p = left + above - corner
        d = np.abs(np.stack([p - left, p - above, p - corner]))
        paeth = np.select([(d[0] <= d[1]) & (d[0] <= d[2]), d[1] <= d[2]], [left, above], corner)
        guess = [0 * row, left, above, (left + above) // 2, paeth][y]
        lines.append(bytes([y]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"\0" * 4
    png = raster.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert np.allclose(raster.decode(png), rgb @ raster.GREY)


def test_edges_are_thin_and_followed():
    a = np.full((60, 60), 255.0)
    assert raster.edge_share(a) == 0
    a[:, 30:] = 0
    e = raster.edge_pixels(a)
    assert e.any(axis=1).all() and e.sum() == 60  # one pixel a row
    weak = np.full((60, 60), 255.0)
    weak[:, 30:] = 255 - 25  # under the weak limit from one side on: no edge starts
    weak[:5, 30:] = 200
    low = raster.edge_pixels(weak)
    assert low[:, 28:32].any(axis=1).all() and low.sum() < 100  # weak pixels next to strong ones belong to the edge
    rnd = np.random.default_rng(5).integers(0, 255, (60, 60)).astype(float)
    assert raster.edge_share(rnd) > 0.1
