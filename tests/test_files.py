"""Files dealt by the executors."""

from __future__ import annotations

import csv
import json

import numpy as np
import pytest

from gaugeworks.functions import raster
from gaugeworks.schemas import CLASS_NAMES
from gaugeworks.sources import files


def test_files_are_written_whole_and_again(spark, tmp_path):
    rows = [(f"a/b{i % 3}/ü {i}.bin", bytes([i]) * i) for i in range(30)]
    df = spark.createDataFrame(rows, "relative_path string, content binary").repartition(4)
    (tmp_path / "out" / "old").mkdir(parents=True)
    (tmp_path / "out" / "old" / "x").write_text("x")
    for _ in range(2):
        assert files.dealt(df, str(tmp_path / "out")) == 30
        found = {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file()}
        assert json.loads(found.pop(files.MARKER)) == {"files": 30, "bytes": sum(range(30))}
        assert found == dict(rows)
    back = {r["relative_path"]: bytes(r["content"]) for r in files.under(spark, str(tmp_path / "out" / "a")).collect()}
    assert back == {k.removeprefix("a/"): v for k, v in rows if v}
    assert files.dealt(df.limit(0), str(tmp_path / "none")) == 0


def test_split_builds_its_folders(spark, tmp_path):
    from gaugeworks.__main__ import main

    rnd = np.random.default_rng(1)
    shot = lambda: rnd.integers(0, 200, (110, 120))
    same = shot()
    for k in range(14):
        kind = CLASS_NAMES[k % 2]
        for d in ("cleaned", "annotated"):
            (tmp_path / d / kind).mkdir(parents=True, exist_ok=True)
        (tmp_path / "cleaned" / kind / f"p{k:02}.png").write_bytes(raster.encode(same if k in (0, 2, 4) else shot()))
        if k != 13:
            (tmp_path / "annotated" / kind / f"p{k:02}.txt").write_text(f"{k % 2} 0.5 0.5 0.2 0.2\n" * (k % 3))
    (tmp_path / "cleaned" / "dent" / "small.png").write_bytes(raster.encode(shot()[:20]))
    (tmp_path / "annotated" / "dent" / "small.txt").write_text("1 0.5 0.5 0.2 0.2\n")
    args = ["split", str(tmp_path / "cleaned"), str(tmp_path / "m"), "--annotated", str(tmp_path / "annotated"), "--target", str(tmp_path / "out"), "--train", "0.6", "--val", "0.2", "--test", "0.2"]
    seen = []
    for _ in range(2):  # a rerun gives the same
        assert main(args, spark) == 0
        rows = [r for f in (tmp_path / "m").glob("part-*.csv") for r in csv.DictReader(f.open())]
        assert list(rows[0]) == ["filename", "split", "cluster_id", "sha256", "class_name", "n_boxes"]
        assert [(r["split"], r["filename"]) for r in rows] == sorted((r["split"], r["filename"]) for r in rows)
        seen.append(rows)
        for r in rows:
            stem = r["filename"].removesuffix(".png")
            picture = tmp_path / "out" / r["split"] / "images" / r["filename"]
            assert picture.read_bytes() == (tmp_path / "cleaned" / r["class_name"] / r["filename"]).read_bytes()
            label = tmp_path / "out" / r["split"] / "labels" / f"{stem}.txt"
            assert len(label.read_text().splitlines()) == int(r["n_boxes"]) == int(stem[1:]) % 3
    assert seen[0] == seen[1]
    # label files without a box have no bytes, and their pictures stay
    assert {r["filename"] for r in seen[0]} == {f"p{k:02}.png" for k in range(13)}
    assert len({r["split"] for r in seen[0] if r["filename"] in ("p00.png", "p02.png", "p04.png")}) == 1 and len({r["split"] for r in seen[0]}) == 3
    with pytest.raises(ValueError):
        main([*args, "--train", "0.9"], spark)
