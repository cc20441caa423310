"""Dashboards and reports over inspections and detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_mean(c: str) -> Column:
    """The mean of a column's values at eight decimals: their sum is one of whole numbers, so it is the same in any order and under any partitioning."""
    return F.sum(F.col(c).cast("decimal(24,8)")).cast("double") / F.count(F.col(c).cast("decimal(24,8)"))


def rounded_mean(c: str) -> Column:
    """exact_mean() at six decimals, halves away from zero: worked out in whole numbers, so no double decides a half."""
    kept = F.col(c).cast("decimal(24,8)")
    n = F.count(kept)
    total = (F.sum(kept) * 10**8).cast("decimal(38,0)")
    millionths = F.call_function("div", 2 * F.abs(total) + 100 * n, F.nullif(200 * n, F.lit(0).cast("long")))
    return F.signum(total) * millionths / 1e6


def dashboard(inspections: DataFrame, detections: DataFrame, buckets: dict[str, Column], key: str = "inspection_id", rounded: bool = True) -> DataFrame:
    """Totals per time bucket, repeated for each defect class found in it; without rounded the means and rates are as they come, for a file's own decimals.

    inspections: key, the bucket expressions' inputs, overall_result, inference_ms;
    detections: key, class_name, confidence. A bucket without detections has one row with
    an empty class. Averages of inference_ms are per inspection: the sides are aggregated apart;
    means are those of exact_mean(), nan and inf left out.
    """
    names = list(buckets)
    rate, mean = (lambda x: F.round(x, 4), rounded_mean) if rounded else (lambda x: x, exact_mean)
    stamped = inspections.select(key, *(c.alias(n) for n, c in buckets.items()), "overall_result", "inference_ms")
    fails = F.count_if(F.col("overall_result") == "FAIL")
    totals = stamped.groupBy(*names).agg(
        F.count(F.lit(1)).alias("total_inspections"),
        (F.count(F.lit(1)) - fails).alias("passes"),
        fails.alias("fails"),
        rate(fails / F.count(F.lit(1))).alias("failure_rate"),
        mean("inference_ms").alias("average_inference_ms"),
    )
    found = (
        detections.join(stamped.select(key, *names), key)
        .groupBy(*names, "class_name")
        .agg(F.count(F.lit(1)).alias("defect_count"), mean("confidence").alias("average_confidence"))
    )
    return totals.join(found, names, "left").select(
        *names,
        "total_inspections",
        "passes",
        "fails",
        "failure_rate",
        "average_inference_ms",
        F.coalesce("class_name", F.lit("")).alias("defect_class"),
        F.coalesce("defect_count", F.lit(0)).alias("defect_count"),
        "average_confidence",
    )


def hourly(timestamp: str = "timestamp") -> dict[str, Column]:
    return {"date": F.to_date(timestamp), "hour": F.hour(timestamp)}


def recent(inspections: DataFrame, detections: DataFrame, n: int = 20, key: str = "inspection_id") -> DataFrame:
    """The newest n inspections by id with their number of detections; the limit comes before the join."""
    top = inspections.orderBy(F.col(key).desc()).limit(n)
    counts = detections.join(F.broadcast(top.select(key)), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n_detections"))
    return top.join(counts, key, "left").withColumn("n_detections", F.coalesce("n_detections", F.lit(0)))


def largest_per_class(boxes: DataFrame, area: str = "area", seed: str = "seed", group: str = "class_name") -> DataFrame:
    """The largest box of each class; equal areas go to the smallest seed."""
    best = F.max(F.struct(F.col(area), (-F.col(seed)).alias("s"))).alias("best")
    return boxes.groupBy(group).agg(best).select(group, F.col(f"best.{area}").alias(area), (-F.col("best.s")).alias(seed))


def class_split_counts(rows: DataFrame, splits: list[str], group: str = "class_name") -> DataFrame:
    """Class by split contingency; the split values are given, so no extra pass looks for them."""
    return rows.groupBy(group).pivot("split", splits).count().na.fill(0)


def first_per_class(rows: DataFrame, group: str = "class_name", order: str = "seed", keep: tuple[str, ...] = ("filename",)) -> DataFrame:
    """The first row of each class in the given order (unique within a class): group, order and the kept columns."""
    first = F.min(F.struct(order, *keep)).alias("first")
    return rows.groupBy(group).agg(first).select(group, f"first.{order}", *(f"first.{c}" for c in keep))


def render_summary(manifest: DataFrame, names: list[str], seed: str = "seed", ids: str = "class_ids", digest: str = "digest") -> DataFrame:
    """One row on a generated set: images, distinct seeds and digests, first and last seed, images of each class (all classes)."""
    whole = manifest.agg(
        F.count(F.lit(1)).alias("images"), F.count_distinct(seed).alias("unique_seeds"), F.count_distinct(digest).alias("unique_digests"), F.min(seed).alias("first_seed"), F.max(seed).alias("last_seed")
    )
    counts = manifest.select(F.explode(ids).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.agg(F.map_from_entries(F.collect_list(F.struct(F.col("c").cast("int"), "n"))).alias("m"))  # a row a class
    named = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.coalesce(F.try_element_at("m", F.lit(i)), F.lit(0).cast("long")) for i in range(len(names)))))
    return whole.crossJoin(F.broadcast(seen)).withColumn("per_class", named).drop("m")  # one row each


def box_statistics(boxes: DataFrame, image: str = "image") -> DataFrame:
    """Boxes, images with a box of at least 0.25 and 0.50 confidence, and the best box's class (the first by name of equal ones)."""
    per = boxes.groupBy(image, "class_name").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))
    images = per.groupBy(image).agg(F.max("confidence").alias("top"), F.sum("n").alias("n"), F.min_by("class_name", F.struct(-F.col("confidence"), "class_name")).alias("first"))
    return images.agg(
        F.sum("n").alias("boxes"), F.count_if(F.col("top") >= 0.25).alias("images_025"), F.count_if(F.col("top") >= 0.5).alias("images_050"), F.min_by("first", F.struct(-F.col("top"), "first")).alias("best_class")
    )


def difference_statistics(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mean absolute and largest difference, and the share of changed values."""
    d = F.abs(F.col(a) - F.col(b))
    return pairs.agg(F.avg(d).alias("mean_abs"), F.max(d).alias("max_abs"), F.avg((d > 0).cast("double")).alias("changed"))


def harmonic_f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
