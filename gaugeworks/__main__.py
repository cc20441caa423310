"""python -m gaugeworks COMMAND ...: the jobs over folders, files and the inspection log."""

from __future__ import annotations

import argparse
import importlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import detect, matching, policy, rollup, splits
from .plans import inspect
from .schemas import SPLITS
from .session import local_session
from .sources import config, files, images, log, sinks, web
from .storage import Written, scope


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gaugeworks", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *places: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        for place in places:
            p.add_argument(place)
        return p

    command("validate", "report on ROOT/{train,val,test}/{images,labels}", "root").add_argument("--near-bits", type=int, default=6)
    clean = command("clean", "judge the pictures of RAW, write REPORT and copy those kept to TARGET", "raw", "report", "target")
    clean.add_argument("--near-bits", type=int, default=6)
    split = command("split", "deal the pictures of FOLDER into splits that share no near-duplicates; write MANIFEST", "folder", "manifest")
    split.add_argument("--seed", type=int, default=42)
    for name, share in zip(SPLITS, splits.RATIOS, strict=True):
        split.add_argument(f"--{name}", type=float, default=share)
    split.add_argument("--near-bits", type=int, default=6)
    split.add_argument("--annotated", help="folder of label files; pictures without one are left out")
    split.add_argument("--target", help="folder that gets SPLIT/images and SPLIT/labels; needs --annotated")
    command("sweep", "precision and recall of PREDICTIONS (JSON) by threshold", "predictions", "output")
    for p in (command("dashboard", "hourly totals of the log", "output"), command("recent", "the newest inspections")):
        p.add_argument("--log", help="folder of the inspection log")
        p.add_argument("--url", help="JDBC url of a database with the tables inspections and detections")
        p.add_argument("-n", type=int, default=20)
    look = command("inspect", "decide on pictures", "output")
    look.add_argument("--detector", help="MODULE:FUNCTION that loads a detector in each worker; without it a deterministic stand-in is used")
    look.add_argument("--log", help="folder of the inspection log that the decisions are added to")
    look.add_argument("--device", default="cpu")
    look.add_argument("--image", action="append", default=[])
    look.add_argument("--dir")
    look.add_argument("--thresholds")
    command("fetch", "fetch the urls of MANIFEST (CSV) into a table at OUTPUT", "manifest", "output").add_argument("--delay", type=float, default=1.0)
    command("plan", "write the balanced plan to OUTPUT", "output").add_argument("--limit", type=int)
    return top


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    _, report = inspect.validated(spark, a.root, a.near_bits)
    found = report.first().asDict()
    print(json.dumps(found, indent=2))
    return 1 if found["errors"] else 0


def _clean(spark: SparkSession, a: argparse.Namespace) -> int:
    judged = inspect.cleaned(inspect.assessed(images.scan(spark, a.raw, recursive=True)), a.near_bits)
    root = spark._jvm.org.apache.hadoop.fs.Path(a.raw).toUri().getPath().rstrip("/")
    records = judged.withColumn("relative_path", F.regexp_replace("path", f"^.*?{root}/", ""))
    sinks.csv_report(records, a.report, ["relative_path", "filename", "sha256", "dhash", "width", "height", "status", "match_name"], ["ord"], "overwrite")
    kept = records.where("status = 'ok'").select("relative_path")
    print(f"kept {files.dealt(files.under(spark, a.raw).join(kept, 'relative_path', 'left_semi'), a.target)}")
    return 0


def _split(spark: SparkSession, a: argparse.Namespace) -> int:
    ratios = (a.train, a.val, a.test)
    splits.checked_ratios(ratios)
    judged = inspect.assessed(images.scan(spark, a.folder, images.SPLIT_SUFFIXES, recursive=True))
    columns = ["filename", "split", "cluster_id", "sha256"]
    if a.annotated:
        items = Written(files.labelled(spark, a.folder, a.annotated, judged), "labelled").df
        if a.target:
            dealt = files.split_folders(spark, items, a.folder, a.annotated, a.target, a.seed, ratios, a.near_bits)
            sinks.csv_report(dealt, a.manifest, [*columns, "class_name", "n_boxes"], ["split", "filename"], "overwrite")
            return 0
        judged = items.withColumns({"hash": F.col("dhash"), "status": F.lit("ok")})
    sound = Written(judged.where("status = 'ok'").select(F.col("path").alias("id"), "filename", "sha256", F.col("hash").alias("dhash")), "sound").df
    dealt = splits.cluster_split(splits.near_clusters(sound, distance=a.near_bits), seed=a.seed, ratios=ratios).join(sound.drop("dhash"), "id").withColumnRenamed("cluster", "cluster_id")
    sinks.csv_report(dealt, a.manifest, columns, ["split", "filename"], "overwrite")
    return 0


def _sweep(spark: SparkSession, a: argparse.Namespace) -> int:
    sinks.sweep_file(matching.sweep(images.predictions(spark, a.predictions)), a.output, "overwrite")
    return 0


def _log(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """Inspections and detections of a log folder, a database, or the session's tables."""
    of = (lambda t: log.read(spark, a.log, t)) if a.log else (lambda t: images.jdbc(spark, a.url, t)) if a.url else spark.table
    return of("inspections"), of("detections")


def _dashboard(spark: SparkSession, a: argparse.Namespace) -> int:
    sinks.dashboard_file(rollup.dashboard(*_log(spark, a), rollup.hourly(), rounded=False), a.output, "overwrite")
    return 0


def _recent(spark: SparkSession, a: argparse.Namespace) -> int:
    rollup.recent(*_log(spark, a), a.n).orderBy(F.desc("inspection_id")).show(a.n, truncate=False)
    return 0


def _inspect(spark: SparkSession, a: argparse.Namespace) -> int:
    default, table, note = config.thresholds(a.thresholds) if a.thresholds else (policy.DEFAULT_THRESHOLD, policy.THRESHOLDS, "")
    seen = inspect.pictures(spark, a.image, a.dir)
    if a.detector:
        module, _, name = a.detector.partition(":")
        scored = detect.scored(seen, getattr(importlib.import_module(module), name), policy.operating_floor(table, default))
    else:
        scored = inspect.mock_scored(seen)
    decided = Written(inspect.judged(scored, not a.detector, table, default).withColumn("threshold_config", F.lit(note)), "decided").df
    sinks.json_report(inspect.in_order(decided), a.output, ["given", "pred"], "overwrite")
    if a.log:
        log.append(inspect.log_rows(decided, a.device, note), a.log, [F.col("given").asc_nulls_last(), F.split("path", "/")])
    return 0


def _fetch(spark: SparkSession, a: argparse.Namespace) -> int:
    web.fetched(images.source_manifest(spark, a.manifest), delay=a.delay).write.mode("overwrite").parquet(a.output)
    return 0


def _plan(spark: SparkSession, a: argparse.Namespace) -> int:
    plan = splits.planned(spark, a.limit)
    dealt = plan.join(splits.plain_split(plan, "seed"), "seed").withColumn("class_ids", F.concat_ws(",", F.sort_array("class_ids")))
    sinks.csv_report(dealt, a.output, ["number", "seed", "split", "class_ids"], ["number"], "overwrite")
    return 0


_JOBS = {"validate": _validate, "clean": _clean, "split": _split, "sweep": _sweep, "dashboard": _dashboard, "recent": _recent, "inspect": _inspect, "fetch": _fetch, "plan": _plan}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    with scope():
        return _JOBS[a.command](spark or local_session(), a)


if __name__ == "__main__":
    raise SystemExit(main())
