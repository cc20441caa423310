"""Files written by the executors, under names of their own.

A file is written beside its place and then moved there in one step, so a task that runs
again, or twice at once, leaves whole files only, and a job that runs again overwrites its
own. A marker at the end tells that all of them are there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import path_parent, path_stem
from ..operators import splits
from ..schemas import SPLITS
from ..storage import Written, remove
from .images import empty_files, exists, labels, qualified

MARKER = "_COMPLETE.json"


def _at(target: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(target if "://" in target else "file://" + target.removeprefix("file:"))


def written_files(rows: DataFrame, target: str) -> DataFrame:
    """relative_path and size of the files written under target: rows has relative_path and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _at(target)
        made: set[str] = set()
        for b in batches:
            sizes = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                folder, _, name = f"{base}/{path}".rpartition("/")
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                beside = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(beside) as out:
                    out.write(content or b"")
                store.move(beside, f"{folder}/{name}")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], names=["relative_path", "size"])

    return rows.select("relative_path", "content").mapInArrow(run, "relative_path string, size long")


def dealt(rows: DataFrame, target: str) -> int:
    """Write the files anew under target, which is wiped first, and then the marker; how many there are."""
    spark = rows.sparkSession
    remove(spark, target)
    n, size = written_files(rows, qualified(spark, target)).agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    marker = spark.createDataFrame([(MARKER, bytearray((json.dumps({"files": n, "bytes": size}) + "\n").encode()))], "relative_path string, content binary")
    written_files(marker, qualified(spark, target)).count()
    return n


def under(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, path and content of all files with bytes under a folder."""
    base = qualified(spark, root).rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.select(F.expr(f"substring(path, {len(base) + 2})").alias("relative_path"), "path", "content")


def labelled(spark: SparkSession, cleaned: str, annotated: str, judged: DataFrame) -> DataFrame:
    """The pictures (of judged: path, filename, sha256, hash, status) that are sound and have a label file under annotated, in the folder of their own folder's name.

    path, filename, stem, class_name (the folder), sha256, dhash, n_boxes and the label file's path.
    """
    named = judged.where("status = 'ok'").select("path", "filename", "sha256", F.col("hash").alias("dhash"), path_parent(F.col("path")).alias("class_name"), path_stem(F.col("path")).alias("stem"))
    if not exists(spark, annotated):
        return named.limit(0).withColumns({"label_path": F.lit(""), "n_boxes": F.lit(0).cast("long")})
    files = under(spark, annotated).where(F.col("path").endswith(".txt"))
    empty = spark.createDataFrame([(p, bytearray()) for p in empty_files(spark, annotated, True) if p.endswith(".txt")], "path string, content binary")
    files = files.select("path", "content").union(empty)
    texts = files.select(path_parent(F.col("path")).alias("split"), path_stem(F.col("path")).alias("stem"), F.decode("content", "UTF-8").alias("text"), F.col("path").alias("label_path"))
    rows, _ = labels(texts)
    boxes = rows.groupBy("split", "stem").agg(F.count(F.lit(1)).alias("n_boxes"))
    counted = texts.select("split", "stem", "label_path").join(boxes, ["split", "stem"], "left").select(F.col("split").alias("class_name"), "stem", "label_path", F.coalesce("n_boxes", F.lit(0)).alias("n_boxes"))
    return named.join(counted, ["class_name", "stem"])


def split_folders(spark: SparkSession, items: DataFrame, cleaned: str, annotated: str, target: str, seed: int = 42, ratios: tuple[float, ...] = splits.RATIOS, near_bits: int = 6) -> DataFrame:
    """Deal labelled() pictures and their label files into target/SPLIT/images and target/SPLIT/labels; the manifest, sorted by split and filename.

    Pictures that are near each other stay together. Only the folders of the splits are wiped.
    """
    files = Written(items.withColumn("id", F.col("path")), "split-items").df
    sides = splits.cluster_split(splits.near_clusters(files, distance=near_bits), seed=seed, ratios=ratios)
    placed = Written(sides.join(files, "id"), "split-sides").df
    goes = placed.select(F.col("path"), F.concat("split", F.lit("/images/"), "filename").alias("relative_path")).union(
        placed.select(F.col("label_path"), F.concat("split", F.lit("/labels/"), "stem", F.lit(".txt")))
    )
    content = reduce(DataFrame.unionByName, (under(spark, d).select("path", "content") for d in sorted({cleaned, annotated})))
    for s in SPLITS:
        remove(spark, f"{target}/{s}")
    # a label file without bytes is not among those read
    written_files(goes.join(content, "path", "left"), qualified(spark, target)).count()
    rows = placed.select("filename", "split", F.col("cluster").alias("cluster_id"), "sha256", "class_name", "n_boxes")
    return rows.orderBy("split", "filename")
