"""Writers: logs, reports, manifests and label files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import fixed
from ..operators.ordered import ranked
from ..schemas import CLASS_NAMES, DASHBOARD, DETECTIONS, INSPECTIONS, SPLITS, SWEEP


def init_tables(spark: SparkSession, inspections: str = "inspections", detections: str = "detections") -> None:
    """Create the two log tables if they aren't there."""
    for name, schema in ((inspections, INSPECTIONS), (detections, DETECTIONS)):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}) USING parquet")


def next_id(spark: SparkSession, name: str, column: str) -> int:
    return (spark.table(name).agg(F.max(column)).first()[0] or 0) + 1


def log_inspections(spark: SparkSession, decided: DataFrame, order: str, inspections: str = "inspections", detections: str = "detections") -> None:
    """Append parents and children under dense ids in the given order.

    decided: the columns of INSPECTIONS but the id, and boxes array<struct<class_name,confidence,x1,y1,x2,y2>>.
    Children go first: a failed run leaves no parent without its children, and ids of orphans are never used again.
    """
    first = next_id(spark, inspections, "inspection_id")
    ids = ranked(decided, [F.col(order)], "_n").withColumn("inspection_id", F.col("_n") + first - 1)
    child_first = next_id(spark, detections, "detection_id")
    boxes = ids.select("inspection_id", F.posexplode("boxes").alias("_p", "b")).select("inspection_id", "_p", "b.*")
    children = ranked(boxes, [F.col("inspection_id"), F.col("_p")], "_n").withColumn("detection_id", F.col("_n") + child_first - 1)
    children.select(*DETECTIONS.names).write.mode("append").insertInto(detections)
    filled = ids.withColumn("notes", F.coalesce("notes", F.lit(""))) if "notes" in ids.columns else ids.withColumn("notes", F.lit(""))
    stamped = filled if "timestamp" in filled.columns else filled.withColumn("timestamp", F.current_timestamp())
    stamped.select(*INSPECTIONS.names).write.mode("append").insertInto(inspections)


def csv_report(df: DataFrame, path: str, columns: list[str], order: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A CSV report of the named columns; empty tables give a header, nulls are blank."""
    out = df.select(*columns)
    out = out.orderBy(*order) if order else out
    out.coalesce(1).write.mode(mode).option("header", "true").option("nullValue", "").option("emptyValue", "").csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", "true").csv(path)


def json_report(df: DataFrame, path: str, without: list[str] | None = None, mode: str = "errorifexists") -> None:
    df.drop(*(without or [])).write.mode(mode).json(path)


def by_split(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.partitionBy("split").mode(mode).parquet(path)


def label_text(labels: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """split, stem and text of each label file: boxes by class id, six decimals, a newline after each.

    files: split and stem of all files that must be there; those without boxes get an empty text.
    """
    line = F.format_string("%d %.6f %.6f %.6f %.6f\n", "class_id", "cx", "cy", "w", "h")
    rows = labels.groupBy("split", "stem").agg(F.sort_array(F.collect_list(F.struct("class_id", F.coalesce("line_no", F.lit(0)).alias("n"), line.alias("line")))).alias("l"))
    texts = rows.select("split", "stem", F.array_join(F.transform("l", lambda x: x["line"]), "").alias("text"))
    if files is None:
        return texts
    return files.select("split", "stem").distinct().join(texts, ["split", "stem"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def path_lists(manifest: DataFrame, path: str, column: str = "relative_path") -> None:
    """A sorted list of paths for each split."""
    manifest.select("split", F.col(column).alias("value")).repartition("split").sortWithinPartitions("split", "value").write.partitionBy("split").mode("overwrite").text(path)


def sweep_cells(sweep: DataFrame) -> DataFrame:
    """The sweep as its file has it: thresholds of one decimal, rates of four, blanks for what isn't known."""
    return sweep.select(
        fixed(F.col("threshold"), 1).alias("threshold"), "class_name", fixed(F.col("precision"), 4).alias("precision"), fixed(F.col("recall"), 4).alias("recall"), "false_positives", "false_negatives",
        F.coalesce(F.col("false_rejects").cast("string"), F.lit("")).alias("false_rejects"), "note",
    )


def dashboard_cells(dashboard: DataFrame) -> DataFrame:
    """The dashboard (not rounded) as its file has it: rates and confidences of four decimals, milliseconds of three."""
    digits = {"failure_rate": 4, "average_inference_ms": 3, "average_confidence": 4}
    return dashboard.withColumns({c: fixed(F.col(c), n) for c, n in digits.items()})


def sweep_file(sweep: DataFrame, path: str, mode: str = "errorifexists") -> None:
    csv_report(sweep_cells(sweep), path, SWEEP.names, mode=mode)


def dashboard_file(dashboard: DataFrame, path: str, mode: str = "errorifexists") -> None:
    csv_report(dashboard_cells(dashboard), path, DASHBOARD.names, ["date", "hour", "defect_class"], mode)


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def guarded(spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """Refuse a target that is there and not empty, unless it may be overwritten."""
    at, fs = _filesystem(spark, path)
    if not overwrite and fs.exists(at) and (not fs.getFileStatus(at).isDirectory() or len(fs.listStatus(at))):
        raise FileExistsError(f"{path} is there already")


def text_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file of its own name, in whatever store the path names."""
    at, fs = _filesystem(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def sidecars(spark: SparkSession, root: str, summary: dict, names: list[str] = CLASS_NAMES) -> None:
    """Class list, data set file, read-me and statistics beside a generated set."""
    text_file(spark, f"{root}/classes.txt", "".join(f"{n}\n" for n in names))
    listed = "".join(f"  {i}: {n}\n" for i, n in enumerate(names))
    text_file(spark, f"{root}/data.yaml", f"path: .\n{''.join(f'{s}: images/{s}{chr(10)}' for s in SPLITS)}names:\n{listed}")
    text_file(spark, f"{root}/stats.json", json.dumps(summary, indent=2, default=str) + "\n")
    table = "".join(f"| {k} | {v} |\n" for k, v in summary.items())
    text_file(spark, f"{root}/README.md", f"# Generated images\n\n| | |\n|---|---|\n{table}")
