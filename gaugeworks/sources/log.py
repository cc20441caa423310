"""The inspection log: parents and children that become visible together.

A batch writes its inspections and its detections into folders of its own name and then one
marker. Readers take the batches that have a marker, so a run that fails between both
halves leaves nothing to be seen, and may be run again. Ids are reserved in blocks before
anything is written: a block belongs to the writer that made its file, which a store with
exclusive creation (HDFS, or one disk) allows to one only, so writers never share an id.
Blocks that weren't filled leave gaps.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.ordered import ranked
from ..schemas import DETECTIONS, INSPECTIONS
from ..storage import Written

#: Ids of a block.
BLOCK = 10_000


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _claimed(spark: SparkSession, path: str) -> bool:
    """Whether this writer made the file: false if it is there already."""
    at, fs = _store(spark, path)
    if at.toUri().getScheme() in (None, "file") and fs.getUri().getScheme() == "file":
        try:
            os.close(os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL))  # Spark's own local file system looks first and creates then
        except FileExistsError:
            return False
        return True
    try:
        fs.create(at, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def reserve(spark: SparkSession, root: str, table: str, n: int, block: int = BLOCK) -> list[int]:
    """First ids of as many blocks as n rows need, which no other writer has or will get."""
    folder = f"{root}/_ids/{table}"
    at, fs = _store(spark, folder)
    fs.mkdirs(at)
    there = [int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()]
    number, got = max(there, default=-1) + 1, []
    while len(got) < -(-n // block):
        if _claimed(spark, f"{folder}/{number}"):
            got.append(number * block + 1)
        number += 1
    return got


def numbered(rows: DataFrame, order: list[Column], firsts: list[int], name: str, block: int = BLOCK) -> DataFrame:
    """Rows with ids in the given order, from the blocks that begin with firsts."""
    placed = ranked(rows, order, "_n")
    of = F.array(*map(F.lit, firsts)) if firsts else F.array(F.lit(1))
    at = F.col("_n") - 1
    return placed.withColumn(name, (F.get(of, F.floor(at / block).cast("int")) + at % block).cast("long")).drop("_n")


def append(decided: DataFrame, root: str, order: list[Column], block: int = BLOCK) -> str:
    """Log a batch: the columns of INSPECTIONS but its id (timestamp and notes may be missing), and boxes array<struct<class_name,confidence,x1,y1,x2,y2>>; the batch's name.

    decided is written once, so a model that made it runs once.
    """
    spark = decided.sparkSession
    batch = uuid.uuid4().hex
    filled = decided if "timestamp" in decided.columns else decided.withColumn("timestamp", F.current_timestamp())
    filled = filled.withColumn("notes", F.coalesce("notes", F.lit("")) if "notes" in filled.columns else F.lit(""))
    held = Written(filled, "log-rows").df
    n, boxes = held.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.coalesce("boxes", F.array().cast(held.schema["boxes"].dataType)))), F.lit(0))).first()
    parents = Written(numbered(held, order, reserve(spark, root, "inspections", n, block), "inspection_id", block), "log-parents").df
    each = parents.select("inspection_id", F.posexplode("boxes").alias("_p", "b")).select("inspection_id", "_p", "b.*")
    children = numbered(each, [F.col("inspection_id"), F.col("_p")], reserve(spark, root, "detections", boxes, block), "detection_id", block)
    parents.select(*INSPECTIONS.names).write.parquet(f"{root}/inspections/batch={batch}")
    children.select(*(F.col(f.name).cast(f.dataType) for f in DETECTIONS)).write.parquet(f"{root}/detections/batch={batch}")
    commit(spark, root, batch, {"batch": batch, "inspections": n, "detections": boxes})
    return batch


def commit(spark: SparkSession, root: str, batch: str, said: dict) -> None:
    """Make a batch visible: its marker is written beside and then gets its name in one step."""
    made, fs = _store(spark, f"{root}/_commits/_{batch}")
    out = fs.create(made, True)
    out.write(bytearray((json.dumps(said) + "\n").encode()))
    out.close()
    if not fs.rename(made, _store(spark, f"{root}/_commits/{batch}.json")[0]):
        raise OSError(f"batch {batch} could not be committed")


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """inspections or detections of all batches that have been committed."""
    schema = {"inspections": INSPECTIONS, "detections": DETECTIONS}[table]
    at, fs = _store(spark, f"{root}/_commits")
    if not fs.exists(at):
        return spark.createDataFrame([], schema)
    done = spark.read.schema("batch string").json(f"{root}/_commits")
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", StringType())])).parquet(f"{root}/{table}")
    return rows.join(done, "batch", "left_semi").select(*schema.names)
