"""Streaming forms: the inspection log, hourly rollups and deduplication across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import NEAR_BITS
from ..operators.known import BUCKETS, KnownFiles
from ..storage import Written, scope


def read(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def hourly_rollup(inspections: DataFrame, timestamp: str = "timestamp", late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Totals per tumbling window; a window closes once the watermark has passed it."""
    fails = F.count_if(F.col("overall_result") == "FAIL")
    stamped = inspections.withColumn(timestamp, F.col(timestamp).cast("timestamp")).withWatermark(timestamp, late)
    return stamped.groupBy(F.window(timestamp, width)).agg(
        F.count(F.lit(1)).alias("total_inspections"), (F.count(F.lit(1)) - fails).alias("passes"), fails.alias("fails"), F.sum("inference_ms").alias("total_inference_ms")
    ).select(F.col("window.start").alias("start"), "total_inspections", "passes", "fails", "total_inference_ms")


def dashboard(inspections: DataFrame, detections: DataFrame, key: str = "inspection_id", timestamp: str = "timestamp", late: str = "2 hours", within: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Both grains of the dashboard as one stream in append mode: an hour's totals, beside each defect class found in it.

    Detections have a key and a time of their own, up to within after their inspection's, so
    neither side of their join is held for longer than that and the lateness. An hour is
    written once, when the watermark has passed it by within, and its state goes; what comes later
    isn't counted. Sums are decimals, the same in any order of the batches.
    """
    seen = inspections.withColumn(timestamp, F.col(timestamp).cast("timestamp")).withWatermark(timestamp, late)
    at = detections.select(F.col(key).alias("_key"), F.col(timestamp).cast("timestamp").alias("_at"), "class_name", "confidence").withWatermark("_at", late)
    in_time = (F.col("_at") >= F.col(timestamp)) & (F.col("_at") <= F.col(timestamp) + F.expr(f"INTERVAL {within}"))
    total = lambda c: F.sum(F.col(c).cast("decimal(24,8)"))
    fails = F.count_if(F.col("overall_result") == "FAIL")
    totals = seen.groupBy(F.window(timestamp, width).alias("hour")).agg(F.count(F.lit(1)).alias("total_inspections"), fails.alias("fails"), total("inference_ms").alias("total_ms"))
    met = seen.select(key, timestamp).join(at, (F.col(key) == F.col("_key")) & in_time)
    found = met.groupBy(F.window(timestamp, width).alias("found_in"), "class_name").agg(F.count(F.lit(1)).alias("defect_count"), total("confidence").alias("total_confidence"))
    both = totals.join(found, totals["hour"] == found["found_in"], "left_outer")
    return both.select(
        F.col("hour.start").alias("start"),
        "total_inspections",
        (F.col("total_inspections") - F.col("fails")).alias("passes"),
        "fails",
        F.col("total_ms").cast("double").alias("total_inference_ms"),
        F.coalesce("class_name", F.lit("")).alias("defect_class"),
        F.coalesce("defect_count", F.lit(0)).alias("defect_count"),
        F.col("total_confidence").cast("double").alias("total_confidence"),
    )


def drained(df: DataFrame, at: str) -> DataFrame:
    """What a stream in append mode gives by the end of all there is, kept at a path."""
    append(df, f"{at}/out", f"{at}/state").start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/out")


def reject_rate(inspections: DataFrame, timestamp: str = "timestamp", late: str = "2 hours", width: str = "6 hours", slide: str = "1 hour") -> DataFrame:
    """Share of failures over a sliding window, for watching drift."""
    stamped = inspections.withColumn(timestamp, F.col(timestamp).cast("timestamp")).withWatermark(timestamp, late)
    return stamped.groupBy(F.window(timestamp, width, slide)).agg(F.avg((F.col("overall_result") == "FAIL").cast("double")).alias("reject_rate")).select(F.col("window.start").alias("start"), "reject_rate")


def first_digests(files: DataFrame, timestamp: str, late: str = "1 day", sha: str = "sha256") -> DataFrame:
    """Files whose digest wasn't seen within the watermark."""
    return files.withWatermark(timestamp, late).dropDuplicatesWithinWatermark([sha])


def collect_incrementally(files: DataFrame, kept_path: str, checkpoint: str, order: str = "id", distance: int = NEAR_BITS, buckets: int = BUCKETS):
    """Each micro-batch goes through the greedy rule after everything that earlier ones kept; survivors are appended to kept_path by batch.

    Earlier batches are known by an index beside kept_path, of which a batch reads what has
    its keys; a batch that runs again doesn't meet what its first run kept.
    """

    def batch(df: DataFrame, number: int) -> None:
        with scope():
            rows = Written(df, "batch").df
            index = KnownFiles(df.sparkSession, f"{kept_path.rstrip('/')}-index", buckets, distance)
            verdict = index.take(rows, number, order)
            rows.join(verdict.where("verdict = 'ok'").select(order), order, "left_semi").write.mode("overwrite").parquet(f"{kept_path}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def append(df: DataFrame, path: str, checkpoint: str):
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
