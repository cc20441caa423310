"""Whole jobs: assess files, inspect pictures, export evaluations, report on data sets."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import corners
from ..functions.hashing import hex16
from ..functions.naming import class_name
from ..functions.raster import probe
from ..operators import dedup, policy, quality, validation
from ..operators.ordered import ranked
from ..schemas import CLASS_NAMES
from ..sources.images import dataset, exists, qualified, scan, with_digests
from ..storage import written


def assessed(files: DataFrame) -> DataFrame:
    """Quality records of a scan with content: names are judged before pictures are decoded."""
    named = with_digests(files).withColumn("by_name", quality.status(F.col("filename"), F.lit(True), F.lit(True), F.lit(10_000), F.lit(10_000), F.lit(0.0), F.lit(1.0)) != "ok")
    plain = named.where("by_name").select("path", "filename", F.lit("").alias("sha256"), F.lit("").alias("dhash"), F.lit(0).alias("width"), F.lit(0).alias("height"), F.lit("screenshot_or_diagram").alias("status"), F.lit(None).cast("bigint").alias("hash"))
    seen = named.where("not by_name").withColumn("p", probe(F.col("content")))
    rule = quality.status(F.col("filename"), F.col("content").isNotNull(), F.col("p.width").isNotNull(), F.col("p.width"), F.col("p.height"), F.col("p.white"), F.col("p.edges"))
    judged = seen.select(
        "path", "filename", "sha256", F.coalesce(hex16(F.col("p.dhash")), F.lit("")).alias("dhash"), F.coalesce("p.width", F.lit(0)).alias("width"), F.coalesce("p.height", F.lit(0)).alias("height"), rule.alias("status"), F.col("p.dhash").alias("hash")
    )
    return plain.unionByName(judged)


def cleaned(records: DataFrame, near_bits: int = dedup.NEAR_BITS) -> DataFrame:
    """Quality records with duplicates flagged in path order (by parts), and the kept row that each copy matches."""
    numbered = ranked(records, [F.split("path", "/")], "ord")
    verdict = dedup.greedy(numbered.select("ord", "sha256", F.col("hash").alias("dhash"), "status"), "ord", distance=near_bits)
    names = numbered.select(F.col("ord").alias("match"), F.col("filename").alias("match_name"))
    return numbered.drop("status", "hash").join(verdict, "ord").join(names, "match", "left").select(*[c for c in records.columns if c not in ("status", "hash")], F.col("verdict").alias("status"), "match_name", "ord")


def pictures(spark: SparkSession, explicit: list[str], folder: str | None = None) -> DataFrame:
    """given (place among the explicit paths, null for a folder's), path, image and content; the folder is listed and read by its scan."""
    named = spark.createDataFrame([(i, p, qualified(spark, p)) for i, p in enumerate(explicit)], "given int, path string, at string")
    there = [p for p in explicit if exists(spark, p)]
    if there:
        read = spark.read.format("binaryFile").load(there).select(F.col("path").alias("at"), "content")
        # files without bytes don't come from the reader
        first = named.join(read, "at", "left").select("given", "path", "content")
    else:
        first = named.select("given", "path", F.lit(None).cast("binary").alias("content"))
    if folder is not None:
        listed = scan(spark, folder).select(F.lit(None).cast("int").alias("given"), "path", "content")
        first = first.unionByName(listed)
    return first.select("given", "path", F.substring_index("path", "/", -1).alias("image"), "content")


def in_order(decided: DataFrame) -> DataFrame:
    """Explicit paths as given, then a folder's by the parts of their paths."""
    return decided.orderBy(F.col("given").asc_nulls_last(), F.split("path", "/"))


def mock_scored(images: DataFrame) -> DataFrame:
    """What detect.scored() gives, by the deterministic stand-in."""
    p = images.withColumn("p", probe(F.col("content"))).drop("content")
    seen = F.col("p.width").isNotNull()
    return p.withColumns(
        {
            "width": F.col("p.width"),
            "height": F.col("p.height"),
            "pred": F.when(seen, policy.mock_detection(F.col("p.width"), F.col("p.height"))),
            "model_version": F.when(seen, F.lit("mock")),
            "inference_ms": F.when(seen, F.lit(0.0)),
        }
    ).drop("p")


def judged(scored: DataFrame, mock: bool = False, table: Mapping[str, float] = policy.THRESHOLDS, default: float = policy.DEFAULT_THRESHOLD) -> DataFrame:
    """Scored pictures with their decision, null where there was nothing to score."""
    return scored.withColumn("decision", F.when(F.col("pred").isNotNull(), policy.decide_nested(F.col("pred"), table, default))).withColumn("mock", F.lit(mock))


def log_rows(decided: DataFrame, device: str = "cpu", thresholds: str = "", notes: str = "") -> DataFrame:
    """Decisions as the log wants them: the parent's columns, and boxes of its children; pictures without a decision aren't logged."""
    box = lambda d: F.struct(d["class"].alias("class_name"), d["confidence"].alias("confidence"), *(F.get(d["bbox"], F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))))
    return decided.where("decision is not null").select(
        "given",
        "path",
        F.col("image").alias("image_name"),
        "model_version",
        F.col("decision.result").alias("overall_result"),
        F.col("decision.max_confidence").alias("max_confidence"),
        "inference_ms",
        F.lit(device).alias("device"),
        F.lit(thresholds).alias("threshold_config"),
        F.lit(notes).alias("notes"),
        F.transform("decision.detections", box).alias("boxes"),
    )


def inspected(
    images: DataFrame,
    scorer: Callable[[Column, Column], Column] = policy.mock_detection,
    floor: float | None = None,
    mock: bool = True,
    table: Mapping[str, float] = policy.THRESHOLDS,
    default: float = policy.DEFAULT_THRESHOLD,
) -> DataFrame:
    """Decision of each picture (width, height): the scorer gives detections, those under the operating floor go first; null for a picture without a size."""
    least = policy.operating_floor(table, default) if floor is None else floor
    scored = images.withColumn("pred", F.filter(scorer(F.col("width"), F.col("height")), lambda d: d["confidence"] >= least))
    decision = F.when(F.col("width").isNotNull(), policy.decide_nested(F.col("pred"), table, default))
    return scored.withColumn("decision", decision).withColumn("mock", F.lit(mock))


def validated(spark: SparkSession, root: str, near_bits: int = dedup.NEAR_BITS) -> tuple[DataFrame, DataFrame]:
    """All violations of a data set folder, and the report on it."""
    found, rows, marked = dataset(spark, root)
    judged = assessed(found).drop("dhash", "filename").join(found.select("path", "split", "stem", "filename"), "path").withColumnRenamed("hash", "dhash")
    judged = written(judged.select("split", "stem", "filename", "sha256", "dhash", "status"), "judged")
    violations = written(validation.validate(judged, marked, rows, near_bits), "violations")
    return violations, validation.report(violations, judged, rows, near_bits)


def evaluation_records(images: DataFrame, labels: DataFrame, scores: DataFrame) -> DataFrame:
    """image, split, gt, pred as nested arrays: pictures without a label file are confirmed good.

    images: split, stem, width, height; labels: split, stem, line_no, class_id, cx, cy, w, h; scores: split, stem, pred.
    """
    keys = ["split", "stem"]
    size = images.select(*keys, "width", "height")
    b = corners(*(F.col(c) for c in ("cx", "cy", "w", "h")), F.col("width"), F.col("height"))
    truth = labels.join(size, keys).withColumn("b", b)
    box = F.struct("line_no", class_name(F.col("class_id"), CLASS_NAMES).alias("class"), F.array("b.x1", "b.y1", "b.x2", "b.y2").alias("bbox"))
    gt = truth.groupBy(*keys).agg(F.sort_array(F.collect_list(box)).alias("g"))
    joined = images.select(*keys).join(gt, keys, "left").join(scores, keys, "left")
    none = F.array().cast("array<struct<class:string,bbox:array<double>>>")
    return joined.select(F.col("stem").alias("image"), "split", F.coalesce(F.transform("g", lambda g: F.struct(g["class"].alias("class"), g["bbox"].alias("bbox"))), none).alias("gt"), "pred")


def dataset_statistics(folders: DataFrame, labels: DataFrame, manifest: DataFrame) -> DataFrame:
    """(section, name, n): images per folder, annotations per class (all classes and what else is seen), rows per split."""
    names = validation.class_dimension(labels.sparkSession).select(F.col("class_name").alias("name")).union(labels.select(class_name(F.col("class_id"), CLASS_NAMES))).distinct()
    counts = labels.groupBy(class_name(F.col("class_id"), CLASS_NAMES).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    per_class = names.join(counts, "name", "left").select(F.lit("class").alias("section"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    per_folder = folders.select(F.lit("folder").alias("section"), F.col("parent").alias("name"), F.col("n_images").alias("n"))
    per_split = manifest.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select(F.lit("split").alias("section"), F.col("split").alias("name"), "n")
    return per_folder.union(per_class).union(per_split)
