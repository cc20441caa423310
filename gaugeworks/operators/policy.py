"""Class thresholds and the PASS/FAIL decision."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CLASS_NAMES

# The example threshold table.
DEFAULT_THRESHOLD = 0.50
THRESHOLDS = {"scratch": 0.55, "dent": 0.55, "weld_porosity": 0.45, "weld_crack": 0.40, "corrosion": 0.50, "misaligned_busbar": 0.45, "missing_or_loose_component": 0.40}


def checked_thresholds(table: Mapping[str, float], default: float) -> None:
    """Classes must be known and limits finite and within 0..1."""
    unknown = sorted(set(table) - set(CLASS_NAMES))
    if unknown:
        raise ValueError(f"thresholds for unknown classes: {unknown}")
    for name, value in [("default", default), *table.items()]:
        if not math.isfinite(value) or not 0 <= value <= 1:
            raise ValueError(f"threshold of {name} is not within 0..1: {value}")


def threshold_of(class_name: Column, table: Mapping[str, float] = THRESHOLDS, default: float = DEFAULT_THRESHOLD) -> Column:
    """The class's limit, or the default; a constant map, so no join."""
    if not table:
        return F.lit(float(default))
    limits = F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))))
    return F.coalesce(F.try_element_at(limits, class_name), F.lit(float(default)))


def operating_floor(table: Mapping[str, float] = THRESHOLDS, default: float = DEFAULT_THRESHOLD) -> float:
    """The lowest confidence that can matter."""
    return max(0.001, min([default, *table.values()]))


def triggered(confidence: Column, threshold: Column) -> Column:
    """Strictly above the limit; NaN triggers nothing."""
    return F.coalesce((confidence > threshold) & ~F.isnan(confidence), F.lit(False))


def decide(inspections: DataFrame, detections: DataFrame, key: str = "inspection_id", table: Mapping[str, float] = THRESHOLDS, default: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One row per inspection: result, max_confidence (0 without detections), failing_classes, n_detections.

    Detections are aggregated before the join, so only one row per inspection is shuffled.
    """
    checked_thresholds(table, default)
    hit = triggered(F.col("confidence"), threshold_of(F.col("class_name"), table, default))
    per = detections.groupBy(key).agg(
        F.max(F.when(~F.isnan("confidence"), F.col("confidence"))).alias("top"),
        F.sort_array(F.collect_set(F.when(hit, F.col("class_name")))).alias("failing"),
        F.count(F.lit(1)).alias("n"),
    )
    joined = inspections.select(key).join(per, key, "left")
    failing = F.coalesce("failing", F.array().cast("array<string>"))
    return joined.select(
        key,
        F.when(F.size(failing) > 0, F.lit("FAIL")).otherwise(F.lit("PASS")).alias("result"),
        F.round(F.greatest(F.coalesce("top", F.lit(0.0)), F.lit(0.0)), 6).alias("max_confidence"),
        failing.alias("failing_classes"),
        F.coalesce("n", F.lit(0)).alias("n_detections"),
    )


def decide_nested(detections: Column, table: Mapping[str, float] = THRESHOLDS, default: float = DEFAULT_THRESHOLD) -> Column:
    """The decision of one image whose detections are an array of struct(class, confidence, bbox)."""
    checked_thresholds(table, default)
    seen = F.transform(
        detections,
        lambda d: F.struct(
            d["class"].alias("class"),
            F.round(d["confidence"], 6).alias("confidence"),
            F.transform(d["bbox"], lambda x: F.round(x, 2)).alias("bbox"),
            threshold_of(d["class"], table, default).alias("threshold"),
            triggered(d["confidence"], threshold_of(d["class"], table, default)).alias("triggered_fail"),
        ),
    )
    failing = F.array_sort(F.array_distinct(F.transform(F.filter(seen, lambda d: d["triggered_fail"]), lambda d: d["class"])))
    top = F.aggregate(detections, F.lit(0.0), lambda acc, d: F.when(F.isnan(d["confidence"]), acc).otherwise(F.greatest(acc, d["confidence"])))
    return F.struct(
        F.when(F.size(failing) > 0, F.lit("FAIL")).otherwise(F.lit("PASS")).alias("result"), F.round(top, 6).alias("max_confidence"), failing.alias("failing_classes"), seen.alias("detections")
    )


def mock_detection(width: Column, height: Column) -> Column:
    """The deterministic stand-in for a detector: one corrosion box in the middle, marked by confidence 0.9."""
    w, h = width.cast("double"), height.cast("double")
    return F.array(
        F.struct(F.lit("corrosion").alias("class"), F.lit(0.90).alias("confidence"), F.array(w * 0.35, h * 0.40, w * 0.65, h * 0.60).alias("bbox"))
    )
